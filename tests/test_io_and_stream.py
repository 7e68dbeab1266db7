import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers, sinks
from tidemark.streaming import live


def test_http_retries_and_cursors():
    calls, waits = [], []

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(request.full_url, 429, "slow", {"Retry-After": "7"}, None)
        return io.BytesIO(json.dumps({"data": [1], "next_cursor": None}).encode())

    assert readers.get_json("http://x", "/y", {"a": 1, "b": None}, opener=opener, sleep=waits.append)["data"] == [1]
    assert calls == ["http://x/y?a=1"] * 2 and 7 <= waits[0] <= 8
    with pytest.raises(ValueError, match="came again"):
        list(readers.pages(lambda c: {"data": [1], "next_cursor": "same"}, 9))
    assert len(list(readers.pages(lambda c: {"data": {"rows": [1]}, "nextCursor": (c or "") + "x"}, 3))) == 3
    with pytest.raises(ValueError, match="list"):
        readers.page({"data": 5})


def test_csv_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(2, None, 0.1234567891), (1, "x", 1.0)], "k int, s string, v double")
    path = str(tmp_path / "out")
    sinks.write_csv(rows.coalesce(1), path, ["k"], 9)
    back = readers.read_training_csv(spark, path, "k int, s string, v double").orderBy("k").collect()
    assert [tuple(r) for r in back] == [(1, "x", 1.0), (2, None, 0.123456789)]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_csv(rows, path)
    sinks.write_manifest(spark, path, cohort="c")
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    assert manifest["cohort"] == "c" and len(manifest["files"][0]["sha256"]) == 64
    assert sinks.markdown(rows.orderBy("k").select("k", "s")) == "| k | s |\n|-|-|\n| 1 | x |\n| 2 |  |\n"


def test_stream_takes_each_trade_once(spark, tmp_path):
    schema = "trade_key string, asset_id string, side string, trade_ts long, notional_microusd long"
    rows = [(f"t{i}", "a", "BUY", 1_700_000_000 + i, 200_000_000) for i in range(50)]
    for n, part in enumerate((rows[:30], rows[20:], [("s", "a", "SELL", 1_700_000_060, 10**9), ("small", "a", "BUY", 1_700_000_060, 1)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n}"))
    got = []
    stream = live.source(spark, str(tmp_path / "in" / "*"), schema, 1)
    q = live.run(stream, lambda df, n: got.extend(r.trade_key for r in df.select("trade_key").collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(got) == sorted(r[0] for r in rows)
    due = live.fan_out(spark.createDataFrame(rows[:1], schema)).collect()
    assert [r.due_at - 1_700_000_000 for r in due] == [900, 3600, 86400]


def test_training_rows_are_one_to_one(spark):
    f = spark.createDataFrame([("a", "train"), ("b", "train")], "trade_key string, split string")
    ok = spark.createDataFrame([("a", "train", 1, 0.5), ("b", "train", 0, 0.4)], "trade_key string, split string, outcome_won int, entry_price_15m double")
    assert readers.training_rows(f, ok, "15m").count() == 2
    for bad in (ok.limit(1), ok.union(ok), ok.withColumn("split", F.lit("test")), ok.withColumn("outcome_won", F.lit(None).cast("int"))):
        with pytest.raises(ValueError):
            readers.training_rows(f, bad, "15m")


def test_pages_that_are_left_are_an_error(monkeypatch):
    fetch = lambda c: {"data": [1], "next_cursor": str(int(c or 0) + 1) if int(c or 0) < 1499 else None}
    assert len(list(readers.pages(fetch))) == len(list(readers.pages(fetch, 1500, whole=True))) == 1500
    monkeypatch.setattr(readers, "get_json", lambda base, path, params: fetch(params["cursor"]))
    read = lambda **o: list(readers._HttpReader({"base": "b", "path": "p", **o}).read(readers._Slice({})))
    assert len(read()) == 1500
    with pytest.raises(readers.HistoryTruncated):
        read(pages="1499")


def test_store_keeps_each_trade_once_for_ever(spark, tmp_path):
    schema = "trade_key string, trade_ts long"
    sink = live.store_once(str(tmp_path / "s"))
    day = 86_400
    for n, rows in ((0, [("a", 0), ("b", day)]), (1, [("c", 2 * day), ("a", 0)]), (1, [("c", 2 * day), ("a", 0)]), (2, [("b", day), ("d", 3 * day)])):
        sink(spark.createDataFrame(rows, schema), n)
    assert sorted(r.trade_key for r in spark.read.parquet(str(tmp_path / "s" / "batch=*")).collect()) == ["a", "b", "c", "d"]
    assert live.poll_window(None, 1000) == (880, 1000) and live.poll_window(500, 1000) == (440, 1000)


def test_scratch_tables_go_with_their_scope(spark):
    from tidemark import scratch

    with scratch.scope(spark):
        t = scratch.cut(spark.createDataFrame([(1, "x"), (2, None)], "`a b` int, `A B` string"))
        assert t.columns == ["a b", "A B"] and t.count() == 2
        path = t.inputFiles()[0].rsplit("/", 1)[0]
        assert scratch.exists(spark, path)
    assert not scratch.exists(spark, path)
