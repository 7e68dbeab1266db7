"""Verbs of the command line over folders of Parquet tables.

A store is a folder with one Parquet table for each name: markets, outcomes, trades, wallet_history, prices, resolutions,
jobs, cohorts, cohort_markets, labels, features, scores, and more. A table is written once; an upsert writes its next version
beside it, and readers take the latest. Reports, exports and training sets never overwrite anything.
"""

from __future__ import annotations

import argparse
import json
import math
import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import audit, cohorts, dataset, enrich, ingest, labels, model, sampling
from tidemark.plans import reports
from tidemark.scratch import children, exists
from tidemark.session import session
from tidemark.sources import readers, sinks
from tidemark.streaming import live

CATEGORIES = ("finance", "geopolitics", "politics", "sports")
HORIZONS = {"15m": 900, "1h": 3600, "24h": 86_400}
FEATURE_VERSION, SCORE_VERSION = 1, 2
TEST_START = 1_786_752_000


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, name: str) -> list[str]:
        found = [x for x in children(self.spark, self.path) if x == name or x.startswith(f"{name}@")]
        return sorted(found, key=lambda x: int(x.partition("@")[2] or 0))

    def __contains__(self, name: str) -> bool:
        return bool(self._versions(name))

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{(self._versions(name) or [name])[-1]}")

    def get(self, name: str, schema: str) -> DataFrame:
        return self[name] if name in self else self.spark.createDataFrame([], schema)

    def put(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("errorifexists").parquet(f"{self.path}/{name}")

    def next(self, name: str, rows: DataFrame) -> None:
        """The next version of a table; the one before stays as it was for those who read it."""
        known = self._versions(name)
        self.put(f"{name}@{int(known[-1].partition('@')[2] or 0) + 1}" if known else name, rows)

    def upsert(self, name: str, rows: DataFrame, key: list[str], keep_old_if_null: list[str] = []) -> None:  # noqa: B006
        self.next(name, ingest.upsert(self[name], rows, key, keep_old_if_null) if name in self else rows)


def cohort_window(a: argparse.Namespace, end: int) -> tuple[int, int]:
    """A bounded window of days, or a market's whole life up to now."""
    return (end - a.days * S.DAY, end) if a.days else (1, end)


def backfill(store: Store, a: argparse.Namespace) -> None:
    """raw_trades to trades: normalised, admitted, of markets to scan and not excluded, each once, beside those already there."""
    rows = ingest.normalize_trades(store["raw_trades"]).where("not is_malformed")
    end = rows.agg(F.max("trade_ts")).first()[0] or 0
    excluded = store["market_exclusions"]
    rows = ingest.without_excluded(ingest.admit(rows, *cohort_window(a, end)), excluded, "condition_id")
    if getattr(a, "max_markets", None):
        scan = ingest.backfill_markets(store["markets"].withColumn("created_ts", F.col("start_ts")), excluded, end)
        rows = rows.join(scan.select("condition_id").distinct().orderBy(F.desc("condition_id")).limit(a.max_markets), "condition_id", "left_semi")
    chosen = (F.col("notional_microusd") >= 500 * S.MILLION) | S.hash_sample(F.col("trade_key"))
    rows = rows.drop("is_malformed").withColumns({"enrichment_status": F.when(chosen, "pending").otherwise("not_selected"), "source_mode": F.lit("backfill"), "_new": F.lit(1)})
    if "trades" in store:
        rows = store["trades"].withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    store.next("trades", ingest.first_wins(rows, [["trade_key"], ["fingerprint"], ["source_trade_id"]], ["_new", "trade_ts", "trade_key"]).drop("_new"))


def settings(a: argparse.Namespace) -> dict:
    return {"days": a.days or 0, "category_limit": a.markets_per_category, "seed": a.seed, "admission_rate_ppm": round(a.admission_rate * S.MILLION), "similarity_threshold_ppm": round(a.similarity_threshold * S.MILLION), "device": a.embedding_device}


def sample(store: Store, a: argparse.Namespace) -> None:
    """candidates (condition_id, category, title, event_id, event_slug, embedding) to cohort_markets, under the cohort's settings."""
    saved = store["cohort_settings"].where(F.col("cohort_name") == a.cohort).first() if "cohort_settings" in store else None
    cohorts.check_settings(a.cohort, json.loads(saved["settings"]) if saved else None, settings(a))
    if saved is None:
        store.upsert("cohort_settings", store.spark.createDataFrame([(a.cohort, json.dumps(settings(a)))], "cohort_name string, settings string"), ["cohort_name"])
    rows = sampling.ranked(store["candidates"], a.seed, a.admission_rate, "category", "condition_id").withColumnRenamed("is_admitted", "admitted")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("title", "event_id", "event_slug") if c not in rows.columns})
    chosen = sampling.greedy_distinct(rows, "category", "condition_id", "embedding", ["event_id", "event_slug"], a.similarity_threshold, a.markets_per_category)
    rest = rows.select("condition_id", "title", "event_id", "event_slug", "random_rank")
    found = chosen.join(rest, "condition_id").select(
        F.lit(a.cohort).alias("cohort_name"), "condition_id", F.col("category").alias("canonical_category"), *rest.columns[1:], F.lit(1).alias("eligible"), F.lit(None).cast("string").alias("eligibility_reason"),
        F.col("status").alias("selection_status"), F.col("reason").alias("selection_reason"), F.col("similar_to").alias("duplicate_of_condition_id"), "similarity_ppm",
        F.when(F.col("status") == "selected", "pending").otherwise("not_selected").alias("fetch_status"), F.lit(0).alias("qualifying_trade_count"), F.lit(None).cast("long").alias("discovery_ordinal"),
    )
    store.upsert("cohort_markets", found, ["cohort_name", "condition_id"])


def finish_scans(store: Store, a: argparse.Namespace) -> None:
    """The cohort's row: its window, frozen; its chosen markets count as fetched with the trades they have."""
    trades = store["trades"]
    start, end = cohort_window(a, trades.agg(F.max("trade_ts")).first()[0] or 0)
    row = (a.cohort, start, end, "complete", 1, 1, cohorts.AUTHORITY, "complete", getattr(a, "markets_per_category", None))
    store.upsert("cohorts", store.spark.createDataFrame([row], "cohort_name string, window_start long, window_end long, phase string, discovery_complete int, resolution_required int, resolution_source string, resolution_status string, category_limit int"), ["cohort_name"])
    if "cohort_markets" not in store:
        return
    markets = store["cohort_markets"]
    counts = trades.where(F.col("trade_ts").between(start, end)).groupBy("condition_id").agg(F.count("*").cast("int").alias("_n"))
    mine = (F.col("cohort_name") == a.cohort) & (F.col("selection_status") == "selected")
    rows = markets.join(counts, "condition_id", "left").withColumns({"fetch_status": F.when(mine, "complete").otherwise(F.col("fetch_status")), "qualifying_trade_count": F.when(mine, F.coalesce("_n", F.lit(0))).otherwise(F.col("qualifying_trade_count"))})
    store.next("cohort_markets", rows.select(*markets.columns))


def enriched(store: Store, a: argparse.Namespace) -> None:
    """trades to features: the wallet's 30 days before each trade, activity of the last hour, bursts, and size against the median."""
    trades = store["trades"]
    if a.limit:
        wanted = trades.orderBy("trade_ts", "trade_key").limit(a.limit)
    else:
        wanted = trades
    wallets = enrich.point_in_time_summary(wanted, store["wallet_history"])
    rows = enrich.bursts(enrich.trailing_activity_by_time(trades)).join(wanted.select("trade_key"), "trade_key", "left_semi")
    rows = rows.join(wallets, ["proxy_wallet", "trade_ts"], "left")
    store.next("features", rows.withColumns({"size_vs_median_milli": S.size_ratio_milli(F.col("notional_microusd"), F.col("median")), "feature_version": F.lit(FEATURE_VERSION)}))
    if "enrichment_status" in trades.columns:
        done = store["features"].select("trade_key", F.lit(True).alias("_done")).distinct()
        marked = trades.join(done, "trade_key", "left").withColumn("enrichment_status", F.when(F.col("_done"), "complete").otherwise(F.col("enrichment_status")))
        store.next("trades", marked.select(*trades.columns))


def rescore(store: Store, a: argparse.Namespace) -> None:
    rows = store["features"].join(store["markets"].select("condition_id", "category", "end_ts"), "condition_id", "left")
    none = F.lit(None).cast("long")
    whole = F.coalesce(F.col("history_truncated") == 0, F.lit(False))
    scored = enrich.scored(rows, age=none, prior_trades=F.col("observed_trade_count"), window_complete=whole, notional_=F.col("notional_microusd"), ratio=F.col("size_vs_median_milli"), price=F.col("price_ppm"), remaining=S.seconds_to_resolution(F.col("end_ts"), F.col("trade_ts")), prior=S.category_prior(F.col("category")), young=none)
    store.next("scores", scored.select("trade_key", F.lit(SCORE_VERSION).alias("score_version"), "score", "bucket", "components"))


def label(store: Store, a: argparse.Namespace) -> None:
    """prices and resolutions to labels."""
    t = store["trades"]
    found = store["resolutions"].where(F.col("terminal").cast("boolean")).select("condition_id", "resolved_at", "winner")
    rows = t.join(found, "condition_id", "left").withColumn("won", labels.outcome_won(F.col("outcome_index"), F.col("winner")))
    made = labels.labelled(rows, store["prices"], t.select("asset_id", F.col("trade_ts").alias("t"), "price_ppm"))
    store.next("labels", made.withColumns({"outcome_won": F.col("won").cast("int"), "price_quality": F.when(F.col("price_source").isNotNull(), "approximate"), "fee_source": F.lit(None).cast("string")}))


def report(store: Store, a: argparse.Namespace) -> None:
    scores, trades = store["scores"], store["trades"]
    show = lambda title, rows: print(f"## {title}", sinks.markdown(rows), sep="\n")
    if {"source_mode", "enrichment_status", "ingested_at"} <= set(trades.columns):
        show("Trades", cohorts.totals(trades))
    show("Score buckets", reports.bucket_report(scores).orderBy("least"))
    show("Categories", reports.category_counts(trades.select("condition_id").join(store["markets"].select("condition_id", "category"), "condition_id"), "category"))
    for name in ("books", "fetches"):
        if name in store:
            show(f"Status of {name}", cohorts.counts_by(store[name], "status").orderBy("status"))
    if {"outcome_name"} <= set(store["outcomes"].columns):
        show("High scores", cohorts.high_scores(scores, trades, store["markets"], store["outcomes"], a.high_limit))
    if not a.cohort:
        return
    markets = store["cohort_markets"]
    scoped = cohorts.scope(store["cohorts"], markets, trades, a.cohort)
    show("Funnel", cohorts.funnel(markets, a.cohort).join(cohorts.wallets_by_category(scoped), "canonical_category", "left").orderBy("canonical_category"))
    if "jobs" in store:
        show("Jobs", cohorts.counts_by(cohorts.jobs_of(store["jobs"], a.cohort), "job_kind", "status").orderBy("job_kind", "status"))
        show("Dead jobs", cohorts.dead_jobs(store["jobs"], a.cohort))
    mine = cohorts.resolutions_of(store["resolutions"], markets, a.cohort)
    if "was_disputed" in mine.columns:
        show("Resolutions", cohorts.resolution_totals(mine))
        show("Resolutions by quality", cohorts.counts_by(mine, "status", "quality").orderBy("status", "quality"))
    show("Not eligible", cohorts.ineligible_reasons(markets, a.cohort).orderBy(F.desc("n"), "reason"))
    show("Labels", cohorts.label_report(scoped, store["labels"]).orderBy("horizon_seconds", "status", "price_source", "price_quality"))
    show("Label coverage", cohorts.label_coverage(scoped, store["labels"]).orderBy("horizon_seconds"))


def export(store: Store, a: argparse.Namespace) -> None:
    """Five tables of the store, and seven more of a cohort; tables that the store does not have are left out."""
    tables = {"trades": (store["trades"], ["trade_ts", "trade_key"]), "scores": (store["scores"], ["trade_key", "score_version"])}
    if {"outcomes", "features", "wallets", "books"} <= {n for n in ("outcomes", "features", "wallets", "books") if n in store}:
        view = reports.feature_view(store["trades"], store["markets"], store["outcomes"], store["features"], store["wallets"], store["scores"], store["books"])
        tables["model_features"] = (view, ["trade_ts", "trade_key"])
    else:
        tables["model_features"] = (store["features"], ["trade_ts", "trade_key"])
    if "books" in store:
        tables["order_book_summaries"] = (store["books"].drop("asks", "bids"), ["requested_at", "trade_key"])
    if "fetches" in store and "summaries" in store:
        tables["wallet_summaries"] = (cohorts.wallet_exports(store["fetches"], store["summaries"]), ["fetch_id"])
    if a.cohort:
        if store["cohorts"].where(F.col("cohort_name") == a.cohort).isEmpty():
            raise ValueError(f"unknown cohort {a.cohort}")
        scenarios = store.get("scenarios", "trade_key string, horizon_seconds int, target_notional_microusd long")
        tables |= cohorts.cohort_exports(store["cohorts"], store["cohort_markets"], store["trades"], store["resolutions"], store["labels"], scenarios, a.cohort)
    sinks.export(tables, a.output)


def build_dataset(store: Store, a: argparse.Namespace) -> None:
    """features, train labels and sealed test labels, with a report and a manifest; categories, a cutoff and a seed decide."""
    features = store["features"].where(F.col("feature_version") == FEATURE_VERSION)
    rows = features.join(store["markets"].select("condition_id", "category", "event_slug", "start_ts", "end_ts"), "condition_id") if "event_slug" not in features.columns else features.drop("event_slug").join(store["markets"].select("condition_id", "category", "event_slug", "start_ts", "end_ts"), "condition_id")
    if a.cohort:
        keys = cohorts.scope(store["cohorts"], store["cohort_markets"], store["trades"], a.cohort).select("trade_key", F.col("canonical_category").alias("_c"))
        rows = rows.join(keys, "trade_key").withColumn("category", F.col("_c")).drop("_c")
    found = store["resolutions"].where(F.col("source") == cohorts.AUTHORITY).select("condition_id", "resolved_at", F.col("terminal").cast("boolean").alias("terminal"))
    scores = store["scores"].where(F.col("score_version") == SCORE_VERSION).select("trade_key", "score", "bucket")
    rows = rows.join(found, "condition_id", "left").join(scores, "trade_key", "left").withColumnRenamed("category", "canonical_category")
    reason = dataset.drop_reason(F.coalesce(F.col("canonical_category").isin(*a.categories), F.lit(False)), F.col("terminal"), F.col("burst_id").isNotNull())
    dropped = rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).where("reason is not null")
    rows = rows.where(reason.isNull())
    split = dataset.folds(dataset.time_split(dataset.market_spans(rows), a.test_start, a.seed), a.seed).drop("first_trade_ts", "resolved_at")
    rows = rows.withColumns({"same_asset_buys_1h": F.col("recent_count"), "same_asset_notional_1h_usd": S.dollars(F.col("recent_notional"))})
    rows = dataset.features_of(rows.join(split, "condition_id"))
    wide = dataset.labels_of(rows, store["labels"], {s: n for n, s in HORIZONS.items()})
    leak = dataset.leakage(rows.where("event_slug is not null"), "event_slug").count()
    sinks.write_csv(sinks.flat(rows), f"{a.output}/features", ["trade_ts", "trade_key"], 9)
    for part in ("train", "test"):
        sinks.write_csv(dataset.sealed_labels(wide, part), f"{a.output}/labels_{part}", ["trade_key"], 9)
    facts = {"categories": ", ".join(a.categories), "test start": a.test_start, "seed": a.seed, "events in both splits": leak, "rows": rows.count()}
    sinks.write_text(store.spark, f"{a.output}/report", dataset.report(rows, wide, dropped, list(HORIZONS), facts))
    sinks.write_manifest(store.spark, a.output, dropped=[r.asDict() for r in dropped.collect()], seed=a.seed, test_start=a.test_start, events_in_both_splits=leak)


def run_audit(store: Store, a: argparse.Namespace) -> None:
    """The gate and the figures behind it as JSON, and as Markdown; ends with an error if the gate is shut."""
    names = ("cohorts", "cohort_markets", "resolutions", "jobs", "trades", "outcomes", "labels", "features")
    unreadable = audit.storage({n: store[n] for n in names})
    tables = [store[n] for n in names]
    found = audit.audit(tables[0], tables[1], *tables[2:], a.cohort, a.categories, unreadable=unreadable).cache()
    scoped = cohorts.scope(store["cohorts"], store["cohort_markets"], store["trades"], a.cohort, a.categories)
    scored = scoped.join(store["labels"].where("horizon_seconds = 900 and status = 'complete'").select("trade_key", "outcome_won"), "trade_key")
    sections = {
        "checks": found, "population": audit.population(scoped), "label_coverage": audit.label_audit(scoped, store["labels"], store["outcomes"], store["resolutions"]),
        "label_sources": cohorts.counts_by(store["labels"].join(scoped.select("trade_key"), "trade_key"), "horizon_seconds", "status", "price_source"), "category_summary": cohorts.category_summary(scoped),
        "winner_balance": reports.class_balance(scored, ["canonical_category"], "outcome_won", "condition_id"), "price_bands": reports.band_histogram(scoped).orderBy("least"),
        "top_markets": reports.top_by_trades(scoped, "condition_id", "proxy_wallet"), "top_wallets": reports.top_by_trades(scoped, "proxy_wallet", "condition_id"),
        "queue": cohorts.counts_by(cohorts.jobs_of(store["jobs"], a.cohort), "status", "job_kind"), "audited_skips": cohorts.audited_skips(store["jobs"], a.cohort),
    }
    shut = not found.where("not passed and severity = 'error'").isEmpty()
    figures = {k: [r.asDict() for r in v.collect()] for k, v in sections.items()}
    text = "\n".join([f"# Audit of {a.cohort}: {'FAIL' if shut else 'PASS'}", *[f"\n## {k}\n\n{sinks.markdown(v)}" for k, v in sections.items()]])
    sinks.write_json(store.spark, f"{a.output}/{a.cohort}_audit_json", {"passed": not shut, "cohort": a.cohort, "categories": a.categories, **figures})
    sinks.write_text(store.spark, f"{a.output}/{a.cohort}_audit_md", text)
    print(sinks.markdown(found))
    if shut:
        sys.exit(1)


def training_table(store: Store, path: str, horizon: str) -> DataFrame:
    """The training split of a folder that build-dataset wrote, or a table of the store, with the names that the model uses."""
    if not exists(store.spark, f"{path}/features"):
        return store[path]
    read = lambda name: store.spark.read.options(header=True, nullValue="", inferSchema=True).csv(f"{path}/{name}")
    rows = readers.training_rows(read("features").where("split = 'train'"), read("labels_train"), horizon)
    return rows.select("*", F.col("outcome_won").cast("int").alias("label"), F.col("canonical_category").alias("category"), F.col("delayed_price").alias("entry_price"), F.col(f"gross_pnl_per_share_{horizon}").alias("gross_pnl"))


def train(store: Store, a: argparse.Namespace) -> None:
    """Cross-validation, choice, refit and diagnostics for each trade filter, as tables and a report in a new folder."""
    if exists(store.spark, a.output):
        raise FileExistsError(a.output)
    rows = training_table(store, a.dataset, a.horizon)
    spark, report_, facts, results, oof = store.spark, ["# Logistic baseline", ""], {}, [], []
    for name in a.filters:
        candidates = model.grid(a.c_grid, a.l1_ratios, a.weightings, a.feature_sets, name)
        found = model.train_baseline(rows, None, candidates, jobs=a.jobs if a.jobs > 0 else 4, filter_=name)
        found["model"].write().save(f"{a.output}/model_{name}")
        write = lambda n, t: sinks.write_csv(t, f"{a.output}/{n}")
        write(f"coefficients_{name}", spark.createDataFrame([(x, float(c)) for x, c in found["coefficients"]], "feature string, coefficient_per_sd double"))
        results += [(name, c.features, c.weighting, c.penalty, str(c.c), c.l1, m, s, *(found["deltas"].get(c) or (None, None)), c == found["chosen"], c == found["best"]) for c, m, s in found["results"]]
        price = found["oof_price"].select("trade_key", F.col("p").alias("p_price_only"))
        both = found["oof"].join(price, "trade_key")
        oof.append(both.select(F.lit(name).alias("filter"), "trade_key", "condition_id", "category", "cv_fold", "price", "label", F.round("p", 6).alias("p_chosen"), F.round("p_price_only", 6).alias("p_price_only")))
        tables = {"Calibration": model.calibration(both).orderBy("bin"), "By category": model.by_category(both, "p", "p_price_only").orderBy("category")}
        if {"entry_price", "gross_pnl"} <= set(rows.columns):
            tables["Follow diagnostic"] = model.follow_diagnostic(both)
        if "heuristic_score" in rows.columns:
            base = model.with_baselines(found["rows"], 5)
            tables["Baselines"] = model.metrics(base, [], p="p_constant").select(F.lit("constant").alias("predictor"), "log_loss").unionByName(model.metrics(base, [], p="p_price").select(F.lit("raw_trade_price"), "log_loss").toDF("predictor", "log_loss")).unionByName(model.metrics(base, [], p="p_heuristic").select(F.lit("price_plus_heuristic"), "log_loss").toDF("predictor", "log_loss"))
        report_ += [f"## Filter {name}", "", f"- chosen: {found['chosen'].key}", f"- best: {found['best'].key}", *[f"\n### {k}\n\n{sinks.markdown(v)}" for k, v in tables.items()]]
        facts[name] = {"chosen": found["chosen"].key, "best": found["best"].key, "intercept": found["intercept"], "medians": found["builder"].fill, "means": found["builder"].mean, "scales": found["builder"].scale, "candidates": len(candidates)}
    sinks.write_csv(spark.createDataFrame(results, "filter string, feature_set string, weighting string, penalty string, c string, l1_ratio double, mean_log_loss double, se_log_loss double, delta_vs_price_only double, delta_se double, chosen boolean, best_by_mean boolean"), f"{a.output}/cv_results")
    sinks.write_csv(model._union(oof), f"{a.output}/oof_predictions", ["filter", "trade_key"])
    sinks.write_text(spark, f"{a.output}/report", "\n".join(report_))
    sinks.write_manifest(spark, a.output, experiments=json.loads(json.dumps(facts, default=str)), horizon=a.horizon, seed=a.seed, labels_test_opened=False)


def watch(store: Store, a: argparse.Namespace) -> None:
    """Files of new trades to live_trades, each once, with the work that follows from each batch in live_jobs."""
    incoming = store.spark.read.parquet(f"{store.path}/incoming")
    stream = live.source(store.spark, f"{store.path}/incoming", incoming.schema.simpleString()[7:-1].replace(":", " "), 10)
    cohort = getattr(a, "cohort", None) or "watch"
    markets = store.get("markets", "condition_id string, end_ts long")

    def work(rows: DataFrame, n: int) -> None:
        jobs = cohorts.fan_out(rows, markets, cohort, int(time.time()), live=True)
        jobs.write.mode("overwrite").parquet(f"{store.path}/live_jobs/batch={n}")

    then = work if {"condition_id", "trade_ts", "notional_microusd"} <= set(incoming.columns) else None
    query = live.run(stream, live.store_once(f"{store.path}/live_trades", then=then), f"{store.path}/live_checkpoint", None if a.once else f"{a.interval} seconds")
    query.awaitTermination()


def compact(store: Store, a: argparse.Namespace) -> None:
    """Raw history rows are summarised by fetch and removed; nothing is removed if a summary is missing after that."""
    raw, fetches, summaries = store["wallet_history_raw"], store["wallet_history_fetches"], store["wallet_history_summaries"]
    todo = cohorts.unsummarised(raw, fetches, summaries)
    rows = raw.join(todo.select("fetch_id", F.col("window_start").alias("_a"), F.col("window_end").alias("_b")), "fetch_id")
    if not todo.isEmpty() and {"trade_ts", "notional_microusd"} <= set(raw.columns):
        made = enrich.wallet_summary(rows.where(F.col("trade_ts").between(F.col("_a"), F.col("_b"))), -(1 << 62), (1 << 62) - 1, "fetch_id").drop("seconds_since_last")
        summaries = summaries.unionByName(sinks.flat(made).select("fetch_id", F.to_json(F.struct(*[c for c in made.columns if c != "fetch_id"])).alias("summary_json")), allowMissingColumns=True)
    left = sinks.compacted(raw, summaries, "fetch_id").count()
    if left:
        sys.exit(f"{left} raw rows have no summary; nothing was removed")
    store.next("wallet_history_summaries", summaries)
    store.next("wallet_history_raw", raw.limit(0))
    if "wallets" in store:
        store.next("wallets", store["wallets"].withColumn("missing_reason", F.replace("missing_reason", F.lit("raw_history_fetch_id:"), F.lit("history_fetch_id:"))))


def init(store: Store, a: argparse.Namespace) -> None:
    store.put("market_exclusions", store.spark.createDataFrame([], "condition_id string, reason string"))


def dead(a: argparse.Namespace) -> Column:
    return (F.col("status") == "dead") & (F.lit(a.kind is None) | (F.col("job_kind") == F.lit(a.kind))) & (F.lit(a.entity_id is None) | (F.col("entity_id") == F.lit(a.entity_id)))


def retry_jobs(store: Store, a: argparse.Namespace) -> None:
    store.next("jobs", store["jobs"].withColumn("status", F.when(dead(a), "pending").otherwise(F.col("status"))))


def run(store: Store, a: argparse.Namespace) -> None:
    """The whole way of a cohort: choice of markets, trades, features, scores and labels; then live trades if asked."""
    steps = [sample] if a.cohort and "candidates" in store else []
    for step in (*steps, backfill, *([finish_scans] if a.cohort else []), enriched, rescore, label):
        step(store, a)
    if a.live:
        watch(store, a)


def finish(store: Store, a: argparse.Namespace) -> None:
    """The choice stays as it is; scans, features, scores and labels are finished."""
    for step in (*([finish_scans] if a.cohort else []), enriched, rescore, label):
        step(store, a)


def numbers(text: str) -> tuple[float, ...]:
    return tuple(math.inf if x.strip() == "inf" else float(x) for x in text.split(",") if x.strip())


def names_of(*allowed: str):
    def read(text: str) -> tuple[str, ...]:
        found = tuple(x.strip() for x in text.split(",") if x.strip())
        if not found or set(found) - set(allowed):
            raise argparse.ArgumentTypeError(f"names from {', '.join(allowed)}")
        return found

    return read


def at_least(least: float, kind: type = int):
    def read(text: str):
        value = kind(text)
        if value < least:
            raise argparse.ArgumentTypeError(f"{least} or more")
        return value

    return read


def share(text: str) -> float:
    value = float(text)
    if not 0 < value <= 1:
        raise argparse.ArgumentTypeError("above 0 and at most 1")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--store", required=True)
    verbs = p.add_subparsers(required=True)

    def verb(name: str, f, **options) -> None:
        v = verbs.add_parser(name)
        v.set_defaults(run=f)
        for k, (default, kind) in options.items():
            v.add_argument(f"--{k.replace('_', '-')}", default=default, **({"action": "store_true"} if kind is bool else {"nargs": "*"} if kind is list else {"choices": kind} if isinstance(kind, tuple) else {"type": kind}))

    positive = at_least(1)
    limit = {"limit": (None, positive)}
    window = {"days": (90, positive)}
    workers = {f"{k}_workers": (2, positive) for k in ("market", "enrichment", "resolution", "label")}  # tasks are Spark's to deal out
    sampler = {"cohort": ("main", str), "days": (None, positive), "seed": (0, int), "admission_rate": (0.5, share), "similarity_threshold": (0.9, share), "markets_per_category": (1000, positive), "embedding_device": ("auto", ("auto", "cuda", "mps", "cpu"))}
    verb("init", init)
    verb("compact-wallet-history", compact)
    verb("backfill", backfill, **window, max_markets=(None, positive))
    verb("sampled-backfill", sample, **sampler, **workers)
    verb("run", run, **{**sampler, "cohort": (None, str), "days": (90, positive)}, **limit, **workers, live=(False, bool), interval=(60, positive), once=(False, bool))
    verb("finish-existing", finish, cohort=(None, str), **{**window, "days": (None, positive)}, **limit, **workers)
    verb("watch", watch, once=(False, bool), interval=(60, positive))
    verb("enrich", enriched, **limit)
    verb("rescore", rescore)
    verb("label", label)
    verb("report", report, high_limit=(10, positive), cohort=(None, str))
    verb("export", export, output=("exports", str), cohort=(None, str))
    verb("build-dataset", build_dataset, output=("dataset", str), cohort=(None, str), categories=(list(CATEGORIES), list), test_start=(TEST_START, int), seed=(0, int))
    verb("audit", run_audit, output=("audit", str), cohort=("main", str), categories=(list(CATEGORIES), list))
    verb("train-baseline", train, dataset=("training", str), output=("baseline", str), horizon=("15m", tuple(HORIZONS)), seed=(0, int), jobs=(-1, int), c_grid=(model.C_GRID, numbers), l1_ratios=(model.L1_SHARES, numbers),
         weightings=(model.WEIGHTINGS, names_of(*model.WEIGHTINGS)), filters=(tuple(model.FILTERS), names_of(*model.FILTERS)), feature_sets=(model.FEATURE_SETS, names_of(*model.FEATURE_SETS)))
    verb("retry-jobs", retry_jobs, kind=(None, str), entity_id=(None, str))
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session()
    spark.dataSource.register(readers.HttpJson)
    args.run(Store(spark, args.store), args)


if __name__ == "__main__":
    main()
