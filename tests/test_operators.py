import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, cohorts, dataset, enrich, ingest, labels, model, sampling


def test_normalized_trades(spark):
    rows = [("t1", "0xABC", "0xC", "a", "buy", "0.25", "400", "1700000000"), (None, "0xABC", "0xC", "a", "buy", "0.250", "400", "1700000000"), ("t2", "", "0xC", "a", "buy", "0.25", "4", "1700000000"), ("t3", "w", "c", "a", "buy", "x", "4", "1")]
    raw = spark.createDataFrame(rows, "id string, proxyWallet string, conditionId string, token_id string, side string, price string, size string, timestamp string")
    got = ingest.normalize_trades(raw).collect()
    assert [r.notional_microusd for r in got] == [100_000_000, 100_000_000, 1_000_000, None]
    assert got[0].trade_key == "t1" and got[1].trade_key == got[1].fingerprint != got[0].fingerprint
    assert [r.is_malformed for r in got] == [False, False, True, True]
    assert (got[0].proxy_wallet, got[0].side) == ("0xabc", "BUY")


def test_pages(spark):
    bodies = [json.dumps({"data": [{"a": 1}], "next_cursor": "n"}), json.dumps({"data": {"items": [{"a": 2}]}}), json.dumps({"data": {"rows": [{"a": 3}]}})]
    got = ingest.page_items(spark.createDataFrame([(b,) for b in bodies], "b string"), "b", "struct<a:int>").collect()
    assert {r.a: r.next_cursor for r in got} == {1: "n", 2: None, 3: None}


def test_upsert_keeps_old_values(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, v int")
    new = spark.createDataFrame([(2, None, None), (3, "c", 3)], "k int, s string, v int")
    assert sorted(map(tuple, ingest.upsert(old, new, ["k"], ["s"]).collect())) == [(1, "a", 1), (2, "b", None), (3, "c", 3)]


def insert_or_ignore(rows, keys):
    kept, seen = [], [set() for _ in keys]
    for r in rows:
        its = [None if any(r[i] is None for i in key) else tuple(r[i] for i in key) for key in keys]
        if not any(k is not None and k in known for k, known in zip(its, seen, strict=True)):
            kept.append(r)
            for k, known in zip(its, seen, strict=True):
                known.add(k) if k is not None else None
    return kept


def test_first_wins_under_several_keys(spark):
    schema = "n int, f string, i string, j string"
    rows = [(1, "a", "x", None), (2, "b", "x", None), (3, "b", "y", None)]  # a row that was rejected does not block another
    assert sorted(r.n for r in ingest.first_wins(spark.createDataFrame(rows, schema), [["f"], ["i"]], ["n"]).collect()) == [1, 3]
    rng = np.random.default_rng(3)
    pick = lambda n: None if rng.random() < 0.1 else f"k{rng.integers(n)}"
    rows = [(n, pick(60), pick(50), pick(40)) for n in range(150)]
    want = [r[0] for r in insert_or_ignore(rows, [(1,), (2,), (1, 3)])]
    assert sorted(r.n for r in ingest.first_wins(spark.createDataFrame(rows, schema), [["f"], ["i"], ["f", "j"]], ["n"]).collect()) == want
    one = ingest.first_wins(spark.createDataFrame(rows, schema), [["f", "i"]], ["n"]).collect()
    assert sorted(r.n for r in one) == [r[0] for r in insert_or_ignore(rows, [(1, 2)])]


def test_point_in_time_summary_never_looks_ahead(spark):
    day = 86_400
    schema = "proxy_wallet string, condition_id string, asset_id string, side string, trade_ts long, notional_microusd long, price_ppm long"
    rows = [("w", "m", "a", "BUY", 100 * day, 10, 5), ("w", "m", "a", "SELL", 100 * day + 1, 30, 5), ("w", "n", "b", "BUY", 130 * day, 50, 5), ("w", "n", "b", "BUY", 130 * day + 1, 70, None)]
    t = spark.createDataFrame(rows, schema)
    got = {r.trade_ts - 100 * day: r for r in enrich.point_in_time_summary(t, t).collect()}
    assert [got[k].observed_trade_count for k in (0, 1, 30 * day, 30 * day + 1)] == [0, 1, 2, 2]
    assert (got[0].median, got[0].seconds_since_last) == (None, None)
    last = got[30 * day + 1]  # the first row is 30 days and a second old by now; the row at the same time and later ones do not count
    assert (last.total, last.median, last.buy_notional, last.distinct_market_count, last.seconds_since_last) == (80, 40, 50, 2, 1)
    cut = {r.trade_ts: r for r in enrich.point_in_time_summary(t, t, cap=1).collect()}[130 * day]
    assert (cut.observed_trade_count, cut.total, cut.history_truncated) == (1, 30, 1)


def test_point_in_time_wallets_keep_every_moment_and_row(spark, tmp_path, monkeypatch):
    import __spark_entry__ as e

    rows = [(0, 0, 1, "a", 1.0, '{"k": 1}'), (1, 60, 1, "a", 2.0, "{}"), (2, 120, 1, "b", 3.0, '{"k": 2}'), (3, 180, 1, None, 4.0, '{"k": 2}'), (4, 240, 1, "b", 5.0, '{"k": 2}'), (5, 60, None, "a", 9.0, '{"k": 1}'), (6, None, 2, "a", 9.0, '{"k": 1}')]
    spark.createDataFrame([(i, *r) for i, *r in rows], "event_id long, ts int, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_700_000_000)).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute("set timezone = 'UTC'")
    duck.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    monkeypatch.setattr(enrich.point_in_time_summary, "__defaults__", (30, 2, "proxy_wallet"))
    got = e.queries()["d10_point_in_time_wallets"](spark, str(tmp_path))
    want = duck.execute(e.oracle_sql()["d10_point_in_time_wallets"])
    names = [x[0] for x in want.description]
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_wallet_summary_bounds(spark):
    rows = [("w", "m1", "o1", "BUY", 200, 100_000_000, 250_000), ("w", "m2", "o2", "SELL", 999_999, 400_000_000, 500_000), ("w", "m1", "o1", "BUY", 1_000_001, 1, 1), ("w", "m1", "o1", "BUY", 300, None, None)]
    t = spark.createDataFrame(rows, "proxy_wallet string, condition_id string, asset_id string, side string, trade_ts long, notional_microusd long, price_ppm long")
    r = enrich.wallet_summary(t, 100, 1_000_000).first()
    assert (r.observed_trade_count, r.total, r.p50, r.buy_count, r.sell_count) == (2, 500_000_000, 250_000_000, 1, 1)
    assert (r.last_7d_trade_count, r.largest_market_share_ppm, r.outside_count, r.malformed_count) == (1 + (200 >= 1_000_001 - 7 * 86400), 800_000, 1, 1)


def test_bursts_include_the_gap(spark):
    rows = [("a", 100, "x"), ("b", 150, "x"), ("c", 210, "x"), ("d", 400, "x"), ("e", 120, "y")]
    t = spark.createDataFrame([(k, "w", a, ts) for k, ts, a in rows], "trade_key string, proxy_wallet string, asset_id string, trade_ts long")
    for slices in (86_400, 61):
        got = {r.trade_key: (r.burst_id, r.burst_size) for r in enrich.bursts(t, slice_seconds=slices).collect()}
        assert got == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 1), "e": ("e", 1)}


def test_bursts_over_slices_against_a_walk(spark):
    rng = np.random.default_rng(5)
    rows = sorted((int(x), f"k{i:04d}") for i, x in enumerate(rng.integers(0, 20_000, 700)))
    want, run = {}, []
    for at, k in [*rows, (10**9, None)]:
        if run and at - run[-1][0] > 60:
            want |= {key: (run[0][1], len(run)) for _, key in run}
            run = []
        run.append((at, k))
    t = spark.createDataFrame([(k, "w", "a", at) for at, k in rows], "trade_key string, proxy_wallet string, asset_id string, trade_ts long")
    assert {r.trade_key: (r.burst_id, r.burst_size) for r in enrich.bursts(t, slice_seconds=100).collect()} == want


def test_trailing_hour_excludes_ties(spark):
    t = spark.createDataFrame([(i, "x", ts, 10) for i, ts in enumerate([0, 0, 3600, 3601, 7200])], "trade_key int, asset_id string, trade_ts long, notional_microusd long")
    for f in (enrich.trailing_activity, enrich.trailing_activity_by_time):
        assert [r.recent_count for r in f(t).orderBy("trade_key").collect()] == [0, 0, 2, 1, 2]


@pytest.mark.parametrize(
    ("change", "quality"),
    [
        ({}, "terminal_outcome_prices"), ({"condition_id": "other"}, "condition_mismatch"), ({"closed": False}, "not_closed"), ({"outcomes": None}, "missing_outcomes"), ({"token_ids": '["yes"]'}, "outcome_length_mismatch"),
        ({"outcomes": '["Yes","yes"]'}, "duplicate_outcomes"), ({"token_ids": '["same","same"]'}, "duplicate_clob_tokens"), ({"outcome_prices": '["1","1"]'}, "ambiguous_outcome_prices"),
        ({"outcome_prices": '["NaN","0"]'}, "invalid_outcome_prices"), ({"status": "disputed"}, "nonterminal_resolution"), ({"outcomes": '["Yes"," "]'}, "empty_outcome"),
    ],
)
def test_resolution_evidence(spark, change, quality):
    row = {"condition_id": "0xC", "closed": True, "status": "resolved", "outcomes": '["Yes","No"]', "outcome_prices": '["1","0"]', "token_ids": '["y","n"]'} | change
    m = spark.createDataFrame([tuple(row.values())], "condition_id string, closed boolean, status string, outcomes string, outcome_prices string, token_ids string")
    r = labels.resolution_evidence(m, F.lit("0xc")).first()
    assert (r.quality, r.winner) == (quality, 0 if quality == "terminal_outcome_prices" else None)


def test_as_of_labels_at_the_bounds(spark):
    t = spark.createDataFrame([("k", "a", 2_000_000, None, True), ("e", "a", 2_000_000, 2_000_900, True)], "trade_key string, asset_id string, trade_ts long, resolved_at long, won boolean")
    points = lambda xs: spark.createDataFrame([("a", *x) for x in xs], "asset_id string, t long, price_ppm long")
    none = points([("0", 0, 0)][:0] or [(0, 0)])
    at = lambda s, p: {r.trade_key: (r.status, r.price_source, r.observed_at, r.entry_price_ppm, r.gross_pnl) for r in labels.labelled(t, s, p, horizons=(900,)).collect()}
    got = at(points([(2_000_899, 100_000), (2_000_960, 500_000), (2_000_960, 400_000)]), none)
    assert got["k"] == ("complete", "historical_price_history", 2_000_960, 400_000, 600_000)
    assert got["e"][0] == "unavailable_before_horizon"
    assert at(points([(2_000_899, 1), (2_001_201, 2)]), none)["k"][0] == "price_unavailable"
    assert at(points([(2_001_200, 7)]), none)["k"][3] == 7
    assert at(none, points([(2_000_930, 300_000)]))["k"][1:4] == ("historical_trade_print", 2_000_930, 300_000)


def test_time_split_and_folds(spark):
    day = 86400
    m = spark.createDataFrame([("train", 10 * day, 20 * day), ("test", 60 * day, 70 * day), ("over", 40 * day, 70 * day), ("open", 10 * day, None)] + [(f"m{i}", day, 2 * day) for i in range(22)], "condition_id string, first_trade_ts long, resolved_at long")
    split = dataset.time_split(m, 50 * day, 0)
    got = {r.condition_id: (r.split, r.split_basis) for r in split.collect()}
    assert got["train"] == ("train", "before_cutoff") and got["test"] == ("test", "after_cutoff")
    assert got["over"][1] == got["open"][1] == "overlap_random"
    folds = dataset.folds(split, 0).collect()
    sizes = [sum(r.cv_fold == k for r in folds) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert all((r.cv_fold is None) == (r.split == "test") for r in folds)


def greedy(rows, quota, threshold):
    out, kept = {}, []
    for k, v, e, s, ok, _ in sorted(rows, key=lambda r: (not r[4], r[5])):
        v = np.array(v) / np.linalg.norm(v)
        if len(kept) >= quota:
            out[k] = ("not_selected", "category_limit" if ok else "random_reject", None)
            continue
        same = next(((n, r) for i, r in ((2, "same_event_id"), (3, "same_event_slug")) for n, x in reversed(kept) if (e, s)[i - 2] and x[i] == (e, s)[i - 2]), None)
        near = max(((float(x[1] @ v), -j, n) for j, (n, x) in enumerate(kept)), default=None)
        if same:
            out[k] = ("redundant", same[1], same[0])
        elif near and round(near[0] * 1e6) >= round(threshold * 1e6):
            out[k] = ("redundant", "semantic_similarity", near[2])
        else:
            out[k] = ("selected", None, None)
            kept.append((k, (k, v, e, s)))
    return out


def test_greedy_choice(spark):
    schema = "k string, category string, v array<double>, event string, slug string, admitted boolean, random_rank string"
    rows = [("a", [1.0, 0.0], "e1", "s"), ("b", [1.0, 0.0], "e1", ""), ("c", [0.95, 0.3122499], "e2", None), ("d", [0.0, 1.0], "e3", "t"), ("f", [-1.0, 0.0], "e4", "t")]
    c = spark.createDataFrame([(k, "x", v, e, s, True, f"{i:064x}") for i, (k, v, e, s) in enumerate(rows)], schema)
    got = {r.k: (r.status, r.reason) for r in sampling.greedy_distinct(c, "category", "k", "v", ["event", "slug"], 0.9, 2).collect()}
    assert got == {"a": ("selected", None), "b": ("redundant", "same_event_id"), "c": ("redundant", "semantic_similarity"), "d": ("selected", None), "f": ("not_selected", "category_limit")}
    rng = np.random.default_rng(1)
    rows = [(f"k{i}", rng.normal(size=3).tolist(), f"e{rng.integers(30)}" if i % 3 else None, f"s{rng.integers(40)}", bool(rng.random() < 0.5), f"{rng.integers(1 << 62):064x}") for i in range(80)]
    c = spark.createDataFrame([(k, "x", v, e, s, ok, r) for k, v, e, s, ok, r in rows], schema)
    for quota in (8, 60):
        found = sampling.greedy_distinct(c, "category", "k", "v", ["event", "slug"], 0.95, quota, batch=7).collect()
        assert {r.k: (r.status, r.reason, r.similar_to) for r in found} == greedy(rows, quota, 0.95)


def test_audit_gate(spark):
    one = lambda s, *rows: spark.createDataFrame(list(rows), s)
    tables = {
        "cohorts": one("cohort_name string, window_start long, window_end long, phase string, discovery_complete int, resolution_required int, resolution_source string, resolution_status string", ("c", 0, 9, "complete", 1, 1, "authority", "complete")),
        "markets": one("cohort_name string, condition_id string, canonical_category string, event_id string, event_slug string, title string, random_rank string, selection_status string, fetch_status string, qualifying_trade_count int", ("c", "m", "x", "e", "s", "t", "0", "selected", "complete", 1), ("c", "n", "x", "e", "s", "t", "1", "rejected", "pending", 0)),
        "resolutions": one("condition_id string, terminal int, source string, winner int", ("m", 1, "authority", 0)),
        "jobs": one("job_key string, cohort_name string, job_kind string, entity_id string, status string", ("j", "c", "verify_resolution", "n", "pending"), ("k", "c", "scan", "m", "succeeded")),
        "trades": one("trade_key string, asset_id string, condition_id string, enrichment_status string, trade_ts long", ("t", "a", "m", "complete", 5)),
        "outcomes": one("asset_id string, condition_id string, outcome_index int", ("a", "m", 0)),
        "labels": one("trade_key string, horizon_seconds int, scheduled_at long, observed_at long, status string, entry_price_ppm long, outcome_won int, gross_pnl long", *[("t", h, 5 + h, 5 + h, "complete", 400_000, 1, 600_000) for h in (900, 3600, 86400)]),
        "features": one("trade_key string", ("t",)),
    }
    run = lambda **x: {r.name: r for r in audit.audit(**(tables | x), cohort="c").collect()}
    got = run()
    assert [n for n, r in got.items() if not r.passed] == ["abandoned_candidate_jobs"] and len(got) == 21
    bad = run(labels=tables["labels"].where("horizon_seconds > 900"), jobs=tables["jobs"].withColumn("status", F.lit("dead")), unreadable=["x"])
    assert {n for n, r in bad.items() if not r.passed} == {"label_900_coverage", "no_dead_jobs", "tables_readable"}
    assert audit.storage({"features": tables["features"], "gone": tables["features"].withColumn("z", F.raise_error(F.lit("x")))}, deep=True) == ["gone"]


def test_baseline_finds_a_signal(spark):
    rng = np.random.default_rng(0)
    rows = []
    for m in range(60):
        for k in range(12):
            p, size = float(rng.uniform(0.05, 0.95)), float(rng.lognormal(0, 1))
            z = math.log(p / (1 - p)) + 1.5 * math.log(size)
            won = int(rng.random() < 1 / (1 + math.exp(-z)))
            rows.append((f"t{m}-{k}", f"m{m}", f"c{m % 4}", m % 5, "train", won, p, None if k == 0 else size, int(k == 0), 1 / 12, 1.0, k % 3, p if k % 2 else None, won - p if k % 2 else None))
    t = spark.createDataFrame(rows, "trade_key string, condition_id string, category string, cv_fold int, split string, label int, price double, notional_usd double, missing_size_vs_median int, market_weight double, sample_weight double, heuristic_score int, entry_price double, gross_pnl double")
    candidates = [model.Candidate("price_only", "market"), model.Candidate("full", "market", 1.0), model.Candidate("full", "market", 1.0, 0.5)]
    result = model.train_baseline(t, None, candidates)
    assert result["chosen"].features == "full" and result["chosen"].l1 == 0
    assert result["coefficients"][0][0] in ("log_notional_usd", "logit_price")
    assert result["deltas"][result["chosen"]][0] < 0 and result["price_only"].key == "all|price_only|market|none|C=inf"
    base = model.with_baselines(result["rows"], 5)
    assert base.where("p_constant is null or p_heuristic is null").count() == 0
    follow = {r["group"]: r for r in model.follow_diagnostic(result["oof"], resamples=200).collect()}
    assert follow["flagged"].trades < follow["all_with_delayed_price"].trades and follow["flagged"].low <= follow["flagged"].mean_pnl_trade <= follow["flagged"].high
    assert model.by_category(result["oof"].withColumn("p_price", F.col("price"))).count() == 4
    with pytest.raises(ValueError, match="two folds"):
        model.train_baseline(t.where("cv_fold = 0"), None, candidates)


def test_simplicity_and_cost():
    c = model.Candidate
    assert model.one_standard_error([(c("full", "none", 1.0, 0.5), 0.50, 0.02), (c("full", "none", 1.0), 0.51, 0.02), (c("full", "none", 0.1), 0.515, 0.02), (c("price_only", "none"), 0.53, 0.02)]) == c("full", "none", 0.1)
    assert len(model.grid()) == 184 and {x.l1 for x in model.grid()} == {0.0, 0.5}
    assert c("full", "none", 1.0, 0.5).cost > c("full", "none", 1.0).cost > c("price_only", "none").cost


def test_quantiles_of_predictions(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(500), 2).tolist() + rng.random(300).tolist() + [1.0, 0.0]
    t = spark.createDataFrame([(x, int(x > 0.4), 1.0, 1.0) for x in p], "p double, label int, sample_weight double, market_weight double")
    assert np.allclose(model.quantile_edges(t, "p", [0.1, 0.5, 0.9]), np.quantile(p, [0.1, 0.5, 0.9]))
    assert model.calibration(t).agg(F.sum("n")).first()[0] == len(p)
    assert model.auc(t).first().auc == 1.0


def test_settings_and_embeddings(spark):
    cohorts.check_settings("c", None, {"seed": 1})
    cohorts.check_settings("c", {"seed": 1, "more": 2}, {"seed": 1})
    with pytest.raises(ValueError, match="seed, days"):
        cohorts.check_settings("c", {"seed": 1, "days": 0}, {"seed": 2, "days": 3})

    def make(device):
        if device != "cpu":
            raise RuntimeError("not here")

        def embed(texts):
            if len(texts) > 2:
                raise MemoryError
            return np.array([[len(t), 1.0] for t in texts])

        return embed

    texts = spark.createDataFrame([(f"h{i}", "x" * i) for i in range(7)], "text_hash string, title string").coalesce(1)
    got = sampling.embedded(texts, make).collect()
    assert len(got) == 7 and {r.generation_device for r in got} == {"cpu"}
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in got)
    with pytest.raises(Exception, match="not here"):
        sampling.embedded(texts, make, devices=("cuda",)).collect()


def test_too_many_categories_are_an_error(spark):
    rows = spark.createDataFrame([(f"c{i % 3}",) for i in range(9)], "category string")
    assert model.categories_of(rows, 3) == ["c0", "c1", "c2"]
    with pytest.raises(ValueError, match="more than 2"):
        model.categories_of(rows, 2)


def test_e36_has_the_default_resamples(spark, sf_dir, monkeypatch):
    from tidemark.plans import queries

    seen, whole = [], model.cluster_bootstrap
    monkeypatch.setattr(model, "cluster_bootstrap", lambda rows, value, cluster, w, resamples=1000, seed=0: seen.append(resamples) or (0.0, 0.0, 0.0))
    monkeypatch.setattr(queries, "_predicted", lambda s, d: None)
    queries.e36_cluster_bootstrap(spark, sf_dir)
    assert seen == [1000] and whole.__defaults__ == (1000, 0)
