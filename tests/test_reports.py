from tidemark.plans import reports
from tidemark.sources import readers


def test_feature_view_takes_the_latest_versions(spark):
    one = lambda s, *rows: spark.createDataFrame(list(rows), s)
    view = reports.feature_view(
        one("trade_key string, condition_id string, asset_id string, wallet_snapshot_id int", ("t", "m", "a", 1), ("no_features", "m", "a", 1), ("no_market", "x", "a", 1)),
        one("condition_id string, category string", ("m", "finance")),
        one("asset_id string, condition_id string, outcome_index int", ("a", "m", 0)),
        one("trade_key string, feature_version int, ratio int", ("t", 1, 10), ("t", 2, 20)),
        one("wallet_snapshot_id int, prior int", (1, 7)),
        one("trade_key string, score_version int, score int", ("t", 1, 3), ("t", 3, 9), ("t", 2, 4)),
        one("trade_key string, kind string, best_ask long", ("t", "pre_detection", 1), ("t", "post_detection", 2)),
    ).collect()
    assert len(view) == 1
    r = view[0]
    assert (r.trade_key, r.category, r.ratio, r.prior, r.score, r.best_ask) == ("t", "finance", 20, 7, 9, 2)


def test_feed_parameters_reach_the_scan(spark, tmp_path):
    rows = [(f"k{i}", f"w{i % 3}", f"m{i % 2}", "BUY", i, 10**9) for i in range(20)]
    spark.createDataFrame(rows, "trade_key string, proxy_wallet string, condition_id string, side string, trade_ts long, notional_microusd long").write.parquet(str(tmp_path / "t"))
    feed = readers.trade_feed(spark.read.parquet(str(tmp_path / "t")), start=5, end=15, user="w0")
    assert sorted(r.trade_ts for r in feed.collect()) == [6, 9, 12, 15]
    plan = spark._jvm.PythonSQLUtils.explainString(feed._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(trade_ts,5)" in plan and "EqualTo(proxy_wallet,w0)" in plan


def test_bucket_report_uses_the_newest_version_only(spark):
    s = spark.createDataFrame([("low", 1, 1), ("high", 9, 2), ("high", 8, 2)], "bucket string, score int, score_version int")
    assert [tuple(r) for r in reports.bucket_report(s).collect()] == [("high", 2, 8.5, 8)]
