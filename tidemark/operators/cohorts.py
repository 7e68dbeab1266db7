"""Cohorts: the trades in their scope, their reports and exports, and the work that is left to do.

Tables: cohorts (cohort_name, window_start, window_end, ...), markets of cohorts (cohort_name, condition_id,
canonical_category, selection_status, fetch_status, ...), trades, outcomes, resolutions, labels, features, scores, jobs,
history fetches and summaries. A cohort is one row, so its window is broadcast; all else is joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.ingest import latest_wins
from tidemark.operators.labels import HORIZONS
from tidemark.operators.numbering import numbered

AUTHORITY = "authority"
_WAITING = ("pending", "leased")


def selected(markets: DataFrame, cohort: str, categories: list[str] | None = None) -> DataFrame:
    """The chosen markets of a cohort, of some categories if they are given."""
    rows = markets.where((F.col("cohort_name") == cohort) & (F.col("selection_status") == "selected"))
    return rows.where(F.col("canonical_category").isin(*categories)) if categories is not None else rows


def scope(cohorts: DataFrame, markets: DataFrame, trades: DataFrame, cohort: str, categories: list[str] | None = None, columns: tuple[str, ...] = ("canonical_category", "event_id", "event_slug", "title", "random_rank")) -> DataFrame:
    """Trades of the cohort's chosen markets in its window, both ends included, with some of the markets' columns."""
    window = cohorts.where(F.col("cohort_name") == cohort).select(F.col("window_start").alias("_from"), F.col("window_end").alias("_to"))
    inside = trades.join(F.broadcast(window), F.col("trade_ts").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
    return inside.join(selected(markets, cohort, categories).select("condition_id", *[c for c in columns if c in markets.columns and c not in trades.columns]), "condition_id")


# Reports


def totals(trades: DataFrame) -> DataFrame:
    """One row: trades by mode and by status of their enrichment, and the time of the freshest."""
    mode = [F.count_if(F.col("source_mode") == x).alias(x) for x in ("live", "backfill")]
    status = [F.count_if(F.col("enrichment_status") == x).alias(x) for x in ("complete", "pending", "failed")]
    return trades.agg(F.count("*").alias("trades"), *mode, *status, F.max("ingested_at").alias("freshest"))


def counts_by(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def funnel(markets: DataFrame, cohort: str) -> DataFrame:
    """Nine measures of each category of a cohort, from eligible markets to unique events."""
    chosen, fetched = F.col("selection_status") == "selected", F.col("fetch_status") == "complete"
    return markets.where(F.col("cohort_name") == cohort).groupBy("canonical_category").agg(
        F.sum("eligible").alias("eligible"), F.count_if(chosen).alias("selected"), F.count_if(F.col("selection_status") == "redundant").alias("redundant"),
        F.count_if((F.col("selection_status") == "not_selected") & (F.col("selection_reason") == "random_reject")).alias("random_rejected"),
        F.count_if(chosen & fetched).alias("fetched"), F.count_if(chosen & (F.col("fetch_status") == "failed")).alias("failed"),
        F.count_if(chosen & fetched & (F.col("qualifying_trade_count") == 0)).alias("zero_trade"),
        F.sum(F.when(chosen, F.col("qualifying_trade_count")).otherwise(0)).alias("trades"), F.count_distinct(F.when(chosen, F.coalesce("event_id", "event_slug"))).alias("unique_events"),
    )


def wallets_by_category(scoped: DataFrame) -> DataFrame:
    return scoped.groupBy("canonical_category").agg(F.count_distinct("proxy_wallet").alias("wallets"))


def jobs_of(jobs: DataFrame, cohort: str) -> DataFrame:
    """The jobs of a cohort and of its live part."""
    return jobs.where(F.col("cohort_name").isin(cohort, f"{cohort}:live"))


def dead_jobs(jobs: DataFrame, cohort: str, k: int | None = 20) -> DataFrame:
    """The jobs that were given up, the latest first."""
    found = jobs_of(jobs, cohort).where("status = 'dead'").select("job_kind", "job_key", "attempts", "last_error", "updated_at", "job_id").orderBy(F.desc("updated_at"), F.desc("job_id"))
    return found.limit(k) if k else found


def audited_skips(jobs: DataFrame, cohort: str) -> DataFrame:
    return jobs_of(jobs, cohort).where((F.col("status") == "succeeded") & F.col("last_error").ilike("skipped%")).groupBy("job_kind").agg(F.count("*").alias("n"))


def next_jobs(jobs: DataFrame, now: int, kinds: list[str], k: int = 1) -> DataFrame:
    """The jobs to take first: by priority, then the time since when they wait, then id."""
    ready = jobs.where((F.col("status") == "pending") & (F.col("available_at") <= now) & F.col("job_kind").isin(*kinds))
    return ready.orderBy(F.desc("priority"), "available_at", "job_id").limit(k)


def resolutions_of(resolutions: DataFrame, markets: DataFrame, cohort: str) -> DataFrame:
    """Resolutions of the markets of a cohort, whether chosen or not."""
    return resolutions.join(markets.where(F.col("cohort_name") == cohort).select("condition_id").distinct(), "condition_id", "left_semi")


def resolution_totals(resolutions: DataFrame) -> DataFrame:
    return resolutions.agg(F.count("*").alias("checked"), F.count_if(F.col("terminal").cast("int") == 1).alias("terminal"), F.count_if(F.col("was_disputed") == 1).alias("disputed"))


def ineligible_reasons(markets: DataFrame, cohort: str) -> DataFrame:
    rows = markets.where((F.col("cohort_name") == cohort) & (F.col("eligible") == 0))
    return rows.groupBy(F.coalesce("eligibility_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def label_report(scoped: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the scope by horizon, status, source and quality of the price, with the mean gross P&L of a share in dollars."""
    rows = labels.join(scoped.select("trade_key"), "trade_key")
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return rows.groupBy("horizon_seconds", "status", none("price_source"), none("price_quality")).agg(
        F.count("*").alias("n"), F.count_if(F.col("fee_source").isNull()).alias("unknown_fees"), F.round(F.avg("gross_pnl") / S.MILLION, 6).alias("mean_gross")
    )


def label_coverage(scoped: DataFrame, labels: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """For each horizon the labels that are there, those expected and those missing; one pass over either table."""
    names = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_seconds")
    expected = scoped.agg(F.count("*").alias("expected")).select("expected", names)
    there = labels.join(scoped.select("trade_key"), "trade_key", "left_semi").groupBy("horizon_seconds").agg(F.count("*").alias("covered"))
    covered = F.coalesce("covered", F.lit(0))
    return expected.join(F.broadcast(there), "horizon_seconds", "left").select("horizon_seconds", covered.alias("covered"), "expected", F.greatest(F.lit(0), F.col("expected") - covered).alias("missing"))


def category_summary(scoped: DataFrame) -> DataFrame:
    event = S.event_of(F.col("event_id"), F.col("event_slug"), F.col("condition_id"))
    return scoped.groupBy("canonical_category").agg(
        F.count("*").alias("trades"), F.count_distinct("proxy_wallet").alias("wallets"), F.count_distinct("condition_id").alias("markets"), F.count_distinct(event).alias("events"),
        F.round(F.avg("price_ppm") / S.MILLION, 6).alias("mean_trade_price"),
    )


def high_scores(scores: DataFrame, trades: DataFrame, markets: DataFrame, outcomes: DataFrame, k: int = 10) -> DataFrame:
    """The latest trades of a high score at the newest version, with their market and outcome; ties by key."""
    newest = scores.agg(F.max("score_version").alias("_v"))
    high = scores.join(F.broadcast(newest), F.col("score_version") == F.col("_v"), "left_semi").where("bucket = 'high'").select("trade_key", "score")
    rows = high.join(trades, "trade_key").join(markets.select("condition_id", "title"), "condition_id").join(outcomes.select("asset_id", "outcome_name"), "asset_id")
    return rows.select("trade_ts", "trade_key", "title", "outcome_name", S.dollars(F.col("notional_microusd")).alias("notional_usd"), "score").orderBy(F.desc("trade_ts"), "trade_key").limit(k)


# Exports


def cohort_exports(cohorts: DataFrame, markets: DataFrame, trades: DataFrame, resolutions: DataFrame, labels: DataFrame, scenarios: DataFrame, cohort: str) -> dict[str, tuple[DataFrame, list[str]]]:
    """The seven tables of a cohort with the columns that order them."""
    scoped = scope(cohorts, markets, trades, cohort)
    keys = scoped.select("trade_key", "canonical_category", "trade_ts")
    mine = markets.where(F.col("cohort_name") == cohort)
    common = ["cohort_name", "condition_id", "title", "canonical_category", "random_rank"]
    return {
        "cohort_markets": (selected(markets, cohort), ["canonical_category", "random_rank", "condition_id"]),
        "cohort_resolutions": (resolutions.join(mine.select("condition_id", "canonical_category", "random_rank"), "condition_id"), ["canonical_category", "random_rank", "condition_id"]),
        "cohort_labels": (labels.join(keys, "trade_key"), ["canonical_category", "trade_ts", "horizon_seconds", "trade_key"]),
        "cohort_label_fill_scenarios": (scenarios.join(keys.drop("canonical_category"), "trade_key"), ["trade_ts", "horizon_seconds", "target_notional_microusd", "trade_key"]),
        "cohort_trades": (scoped.select(*trades.columns, "canonical_category", "random_rank"), ["canonical_category", "random_rank", "trade_ts", "trade_key"]),
        "cohort_similarity_rejections": (mine.where("selection_status = 'redundant'").select(*common, "selection_reason", "duplicate_of_condition_id", "similarity_ppm"), ["canonical_category", "random_rank", "condition_id"]),
        "cohort_admission_rejections": (mine.where("selection_status = 'not_selected' and selection_reason = 'random_reject'").select(*common, "discovery_ordinal", "selection_reason"), ["discovery_ordinal", "condition_id"]),
    }


def wallet_exports(fetches: DataFrame, summaries: DataFrame) -> DataFrame:
    return fetches.join(summaries, "fetch_id")


# Work that is left


def usable_fetches(fetches: DataFrame, summaries: DataFrame) -> DataFrame:
    """The latest fetch that ended well and has a summary, for each wallet and exact window."""
    done = fetches.where(F.col("status").isin("complete", "truncated")).join(summaries, "fetch_id")
    return latest_wins(done, ["proxy_wallet", "window_start", "window_end"], ["fetch_id"])


def pending_enrichment(trades: DataFrame, features: DataFrame, fetches: DataFrame, summaries: DataFrame, version: int, limit: int | None = None) -> DataFrame:
    """Trades to enrich, oldest first: waiting or failed ones, and complete ones without features of the version or without a
    summary of their 30 days."""
    has = features.where(F.col("feature_version") == version).select("trade_key").distinct().withColumn("_f", F.lit(True))
    windows = usable_fetches(fetches, summaries).select("proxy_wallet", F.col("window_start").alias("_from"), F.col("window_end").alias("_to"), F.lit(True).alias("_s"))
    rows = trades.withColumns({"_from": F.greatest(F.lit(1), F.col("trade_ts") - 30 * S.DAY), "_to": F.col("trade_ts") - 1}).join(has, "trade_key", "left").join(windows, ["proxy_wallet", "_from", "_to"], "left")
    wanted = F.col("enrichment_status").isin("pending", "failed") | ((F.col("enrichment_status") == "complete") & (F.col("_f").isNull() | F.col("_s").isNull()))
    found = rows.where(wanted).select("trade_key", "trade_ts", "enrichment_status")
    return found.orderBy("trade_ts", "trade_key").limit(limit) if limit is not None else found


def verified_markets(markets: DataFrame, resolutions: DataFrame, cohort: str, source: str = AUTHORITY) -> DataFrame:
    """Eligible chosen markets with a terminal resolution from the authority."""
    good = resolutions.where((F.col("terminal").cast("int") == 1) & (F.col("source") == source)).select("condition_id")
    return selected(markets, cohort).where("eligible = 1").join(good, "condition_id", "left_semi")


def unverified_candidates(markets: DataFrame, resolutions: DataFrame, cohort: str, source: str = AUTHORITY) -> DataFrame:
    good = resolutions.where((F.col("terminal").cast("int") == 1) & (F.col("source") == source)).select("condition_id")
    return markets.where((F.col("cohort_name") == cohort) & (F.col("eligible") == 1)).join(good, "condition_id", "left_anti")


def scan_targets(markets: DataFrame, resolutions: DataFrame, cohort: str, source: str = AUTHORITY) -> DataFrame:
    """Verified chosen markets whose trades are not fetched yet."""
    good = resolutions.where((F.col("terminal").cast("int") == 1) & (F.col("source") == source)).select("condition_id")
    return selected(markets, cohort).where(F.col("fetch_status").isin("pending", "failed")).join(good, "condition_id")


def needs_enrichment(trades: DataFrame, features: DataFrame, version: int) -> DataFrame:
    has = features.where(F.col("feature_version") == version).select("trade_key").distinct().withColumn("_f", F.lit(True))
    status = F.col("enrichment_status")
    return trades.where(status != "not_selected").join(has, "trade_key", "left").where(status.isin("pending", "failed") | F.col("_f").isNull()).drop("_f")


def needs_label(trades: DataFrame, labels: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(trade_key, horizon_seconds) without a label, or with one that still waits."""
    wanted = trades.select("trade_key", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_seconds"))
    settled = labels.where(~F.col("status").isin("pending", "observed_pending_resolution")).select("trade_key", "horizon_seconds")
    return wanted.join(settled, ["trade_key", "horizon_seconds"], "left_anti")


def abandoned_jobs(jobs: DataFrame, cohorts: DataFrame, markets: DataFrame, cohort: str) -> DataFrame:
    """Checks of markets that a frozen cohort did not choose and that no one will run any more."""
    frozen = cohorts.where((F.col("cohort_name") == cohort) & (F.col("discovery_complete") == 1)).select("cohort_name")
    left = markets.where(F.col("selection_status") != "selected").select("cohort_name", F.col("condition_id").alias("entity_id"), "canonical_category", "selection_status")
    open_ = jobs.where((F.col("cohort_name") == cohort) & F.col("status").isin(*_WAITING) & (F.col("job_kind") == "verify_resolution"))
    return open_.join(F.broadcast(frozen), "cohort_name").join(left, ["cohort_name", "entity_id"])


def unsummarised(raw: DataFrame, fetches: DataFrame, summaries: DataFrame) -> DataFrame:
    """Fetches that have raw rows and no summary."""
    return fetches.join(raw.select("fetch_id").distinct(), "fetch_id", "left_semi").join(summaries.select("fetch_id"), "fetch_id", "left_anti")


def fan_out(trades: DataFrame, markets: DataFrame, cohort: str, now: int, live: bool, version: int = 1, selected_: Column | None = None, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """All work that follows from each new trade: job_kind, job_key, cohort_name, entity_id, priority, available_at.

    Enrichment if the trade is chosen for it, a label for each horizon, and for live trades the order book of large ones
    and the resolution of the market once it is due. A market is one job whatever its trades.
    """
    name = F.lit(f"{cohort}:live" if live else cohort)
    key, ts = F.col("trade_key"), F.col("trade_ts")
    job = lambda kind, id_, entity, priority, at: F.struct(F.lit(kind).alias("job_kind"), id_.alias("job_key"), name.alias("cohort_name"), entity.cast("string").alias("entity_id"), F.lit(priority).alias("priority"), at.cast("bigint").alias("available_at"))
    chosen = selected_ if selected_ is not None else (F.col("notional_microusd") >= 500 * S.MILLION) | S.hash_sample(key)
    work = [F.when(chosen, job("enrich_trade", F.concat(F.lit("enrich_trade:"), key, F.lit(f":v{version}")), key, 0, F.lit(now)))]
    work += [job("observe_entry", F.concat(F.lit("observe_entry:"), key, F.lit(f":{h}")), key, 30 if live else 5, ts + h if live else F.lit(now)) for h in horizons]
    rows = trades
    if live:
        rows = trades.join(markets.select("condition_id", F.col("end_ts").alias("_end")), "condition_id", "left")
        work.append(F.when(F.col("notional_microusd") >= 1000 * S.MILLION, job("capture_book", F.concat(F.lit("capture_book:"), key, F.lit(":post_detection")), key, 40, F.lit(now))))
        due = F.greatest(F.lit(now), F.coalesce("_end", F.lit(now)))
        work.append(job("resolve_market", F.concat(F.lit("resolve_market:"), F.col("condition_id").cast("string")), F.col("condition_id"), 0, due))
    found = rows.select(F.explode(F.array_compact(F.array(*work))).alias("j")).select("j.*")
    rest = [c for c in found.columns if c != "job_key"]
    return found.groupBy("job_key").agg(F.min(F.struct(*rest)).alias("_r")).select("job_key", "_r.*").select(*found.columns)


# Discovery


def discovered(pages: DataFrame, key: str = "condition_id") -> DataFrame:
    """Markets from the pages of several feeds in rounds, one page of each feed a round: the first sight of each, numbered.

    pages: round, feed, position, failed and the market's columns. Feeds come in their order within a round; a page that
    failed brings nothing. discovery_ordinal counts what the pages hold, repeats included, from 1.
    """
    good = pages.where(~F.coalesce("failed", F.lit(False)))
    rows = numbered(good, "discovery_ordinal", F.col("round"), ["feed", "position", key]).withColumn("discovery_ordinal", F.col("discovery_ordinal") + 1)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), "discovery_ordinal").alias("_r")).select(key, "_r.*").drop("failed")


def active_feeds(streams: DataFrame, chosen: DataFrame, quota: int) -> DataFrame:
    """Feeds that still have pages and whose category still has room."""
    full = chosen.groupBy("canonical_category").agg(F.count("*").alias("_n")).where(F.col("_n") >= quota).select("canonical_category")
    return streams.where(F.col("exhausted") == 0).join(F.broadcast(full), "canonical_category", "left_anti")


def changed_settings(saved: dict, wanted: dict) -> list[str]:
    """The names of settings that differ from those a cohort was made with, in order; a cohort keeps its settings for life."""
    return [k for k, v in wanted.items() if saved.get(k) != v]


def check_settings(cohort: str, saved: dict | None, wanted: dict) -> None:
    if saved is not None and (changed := changed_settings(saved, wanted)):
        raise ValueError(f"cohort {cohort!r} already exists with other settings: {', '.join(changed)}")


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys both have, and how many either has."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.count("*").alias("all"))


def devices(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("generation_device").distinct()


def top_n(rows: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n of each group, kept by partial sorts before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
