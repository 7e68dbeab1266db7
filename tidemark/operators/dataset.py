"""Leakage-safe training sets: time splits by market, folds, features, sealed labels and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.cohorts import AUTHORITY, scope
from tidemark.operators.numbering import numbered
from tidemark.sources.sinks import markdown

FOLDS = 5


def drop_reason(category_ok: Column, resolution: Column, enriched: Column) -> Column:
    return F.when(~category_ok, "other_category").when(~F.coalesce(resolution, F.lit(False)), "no_verified_resolution").when(~F.coalesce(enriched, F.lit(False)), "not_enriched")


def time_split(markets: DataFrame, cutoff: int, seed: int, key: str = "condition_id") -> DataFrame:
    """(key, first_trade_ts, resolved_at) to split and split_basis. A market that straddles the cutoff falls by a seeded coin."""
    coin = S.hash_number(S.joined_hash(":", F.lit(str(seed)), F.lit("overlap"), key), 2)
    after, before = F.col("first_trade_ts") >= cutoff, F.col("resolved_at") < cutoff
    return markets.withColumns({
        "split": F.when(after, "test").when(before, "train").when(coin == 0, "train").otherwise("test"),
        "split_basis": F.when(after, "after_cutoff").when(before, "before_cutoff").otherwise("overlap_random"),
    })


def market_spans(trades: DataFrame, key: str = "condition_id") -> DataFrame:
    return trades.groupBy(key).agg(F.min("trade_ts").alias("first_trade_ts"), F.max("resolved_at").alias("resolved_at"))


def folds(markets: DataFrame, seed: int, key: str = "condition_id", k: int = FOLDS) -> DataFrame:
    """cv_fold of the training markets, dealt round-robin in hash order: their sizes differ by one at most.

    Row numbers run over ranges of the hash in parallel, at most 4096 whatever the number of markets, so no task sorts all.
    """
    hashed = S.joined_hash(":", F.lit(str(seed)), F.lit("fold"), key)
    train = markets.where("split = 'train'").select(key, F.substring(hashed, 1, 16).alias("_o"))
    dealt = numbered(train, "_place", F.substring("_o", 1, 3), ["_o", key]).select(key, (F.col("_place") % k).cast("int").alias("cv_fold"))
    return markets.join(dealt, key, "left")


def base(cohorts: DataFrame, cohort_markets: DataFrame, trades: DataFrame, markets: DataFrame, outcomes: DataFrame, resolutions: DataFrame, features: DataFrame, wallets: DataFrame, scores: DataFrame, cohort: str, feature_version: int, score_version: int, source: str = AUTHORITY) -> DataFrame:
    """The rows of a cohort's training set: trades of its chosen markets in its window with their market and outcome, and
    what is known of resolution (of one source), features and score (of one version each) and wallet."""
    facts = scope(cohorts, cohort_markets, trades, cohort, columns=("canonical_category",))
    rows = facts.drop("event_slug", "outcome_name").join(markets.select("condition_id", "event_slug", "start_ts", "end_ts"), "condition_id").join(outcomes.select("asset_id", "outcome_name"), "asset_id")
    rows = rows.join(resolutions.where(F.col("source") == source).select("condition_id", "resolved_at", "terminal"), "condition_id", "left")
    rows = rows.join(features.where(F.col("feature_version") == feature_version).drop("feature_version", *[c for c in trades.columns if c != "trade_key"]), "trade_key", "left")
    rows = rows.join(wallets.select("wallet_snapshot_id", F.col("missing_reason").alias("wallet_reason")), "wallet_snapshot_id", "left")
    rows = rows.join(scores.where(F.col("score_version") == score_version).select("trade_key", "score", "bucket"), "trade_key", "left")
    return rows.withColumn("has_features", F.col("wallet_snapshot_id").isNotNull())


# A wallet's figures in the training set, the figure of the summary that they come from, and their scale.
WALLET_FIELDS = (
    ("wallet_observed_trade_count", "observed_trade_count", 1), ("wallet_distinct_market_count", "distinct_market_count", 1), ("wallet_distinct_outcome_count", "distinct_outcome_count", 1),
    ("wallet_active_days", "active_days", 1), ("wallet_mean_notional_usd", "mean", 1e-6), ("wallet_median_notional_usd", "median", 1e-6), ("wallet_p90_notional_usd", "p90", 1e-6),
    ("wallet_max_notional_usd", "most", 1e-6), ("wallet_stddev_notional_usd", "stddev", 1e-6), ("wallet_mean_price", "mean_price", 1e-6), ("wallet_cheap_trade_count", "cheap_trade_count", 1),
    ("wallet_last_7d_trade_count", "last_7d_trade_count", 1), ("wallet_last_7d_notional_usd", "last_7d_notional", 1e-6), ("wallet_seconds_since_last_trade", "seconds_since_last", 1),
    ("wallet_largest_market_volume_share", "largest_market_share_ppm", 1e-6),
)
OPTIONAL = (
    "days_since_market_start", "hours_to_scheduled_end", "fraction_of_market_life_elapsed", "size_vs_median", *[n for n, _, _ in WALLET_FIELDS],
    "wallet_buy_count", "wallet_sell_count", "wallet_buy_notional_share",
)


def wallet_features(rows: DataFrame) -> DataFrame:
    """Adds the wallet's features from the figures of a summary (columns of WALLET_FIELDS' second names, buy_count, sell_count,
    buy_notional, total, history_truncated). Without a summary all are null."""
    present = F.col("observed_trade_count").isNotNull()
    scaled = {name: F.col(source) if factor == 1 else F.col(source) * F.lit(factor) for name, source, factor in WALLET_FIELDS}
    sides = {f"wallet_{side}_count": F.when(present, F.coalesce(f"{side}_count", F.lit(0))) for side in ("buy", "sell")}
    return rows.withColumns({**scaled, **sides, "wallet_buy_notional_share": S.buy_share(F.col("buy_notional"), F.col("total"))})


def features_of(rows: DataFrame) -> DataFrame:
    """The columns of a training row from base rows with split, burst, wallet figures and the last hour's activity."""
    start = rows.agg(F.min("trade_ts").alias("_start"))
    timed = lifecycle(rows.join(F.broadcast(start), F.lit(True)), F.col("_start")).drop("_start")
    named = wallet_features(timed).withColumns({
        "price": S.dollars(F.col("price_ppm")), "notional_usd": S.dollars(F.col("notional_microusd")), "log_notional": S.log10_dollars(F.col("notional_microusd")),
        "size_shares": S.dollars(F.col("size_microshares")), "size_vs_median": F.col("size_vs_median_milli") / 1000, "sample_weight": S.sample_weight(F.col("notional_microusd")),
        "heuristic_score": F.col("score"), "heuristic_bucket": F.col("bucket"),
    })
    return market_weight(with_missing_flags(named, list(OPTIONAL)))


def labels_of(rows: DataFrame, labels: DataFrame, names: dict[int, str]) -> DataFrame:
    """One row a trade: its outcome, its edge over the price, and entry price, P&L, status and source for each horizon.

    A horizon without a label has the status missing; the outcome is that of the first horizon that knows it.
    """
    pick = lambda h, c: F.max(F.when(F.col("horizon_seconds") == h, F.col(c)))
    wide = labels.groupBy("trade_key").agg(*[pick(h, c).alias(f"{c}_{n}") for h, n in names.items() for c in ("entry_price_ppm", "gross_pnl", "status", "price_source", "outcome_won")])
    won = F.coalesce(*[F.col(f"outcome_won_{n}").cast("int") for n in names.values()])
    joined = rows.select("trade_key", "split", "price_ppm").join(wide, "trade_key", "left").withColumn("outcome_won", won)
    by_horizon = [c for n in names.values() for c in (
        (F.col(f"entry_price_ppm_{n}") * 1e-6).alias(f"entry_price_{n}"), (F.col(f"gross_pnl_{n}") * 1e-6).alias(f"gross_pnl_per_share_{n}"),
        F.coalesce(f"status_{n}", F.lit("missing")).alias(f"label_status_{n}"), F.col(f"price_source_{n}"),
    )]
    return joined.select("trade_key", "split", "outcome_won", S.edge(F.col("outcome_won"), F.col("price_ppm")).alias("edge"), *by_horizon)


def lifecycle(rows: DataFrame, dataset_start: Column | int) -> DataFrame:
    """Calendar and market-life features of trade_ts, start_ts and end_ts (seconds)."""
    ts, start, end = F.col("trade_ts"), F.col("start_ts"), F.col("end_ts")
    moment = F.timestamp_seconds(ts)
    start_of = F.lit(dataset_start) if isinstance(dataset_start, int) else dataset_start
    return rows.withColumns({
        "trade_time_utc": F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "hour_utc": F.hour(moment), "day_of_week": F.weekday(moment),
        "days_since_market_start": (ts - start) / S.DAY, "hours_to_scheduled_end": (end - ts) / 3600,
        "fraction_of_market_life_elapsed": F.when(end > start, (ts - start) / (end - start)), "months_since_dataset_start": (ts - start_of) / (30.4375 * S.DAY),
    })


def with_missing_flags(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumns({f"missing_{n}": F.col(n).isNull().cast("int") for n in names})


def market_weight(rows: DataFrame, key: str = "condition_id") -> DataFrame:
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return rows.join(n, key).withColumn("market_weight", 1 / F.col("_n")).drop("_n")


def sealed_labels(labels: DataFrame, split: str) -> DataFrame:
    return labels.where(F.col("split") == split)


def split_summary(rows: DataFrame, category: str) -> DataFrame:
    """Markets, trades, mean price and win rate by split and category; the test split's outcomes stay sealed."""
    return rows.groupBy("split", category).agg(
        F.count_distinct("condition_id").alias("markets"), F.count("*").alias("trades"), F.round(F.avg("price_ppm"), 4).alias("mean_price"),
        F.round(F.avg(F.when((F.col("split") == "train"), F.col("outcome_won").cast("int"))), 6).alias("win_rate"),
    )


def leakage(rows: DataFrame, event: str) -> DataFrame:
    """Events with markets in both splits."""
    return rows.groupBy(event).agg(F.count_distinct("split").alias("splits")).where("splits > 1").select(event)


def split_basis(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "split_basis").agg(F.count_distinct("condition_id").alias("markets"), F.count("*").alias("trades"))


def quality(features: DataFrame, names: tuple[str, ...] = OPTIONAL) -> DataFrame:
    """(measure, n, share): truncated histories, trades in bursts, and the missing values of each optional feature; one pass."""
    measures = {"history_truncated": F.col("history_truncated") == 1, "in_bursts": F.col("burst_size") > 1, **{f"missing_{n}": F.col(f"missing_{n}") == 1 for n in names}}
    counts = features.agg(F.count("*").alias("_all"), *[F.count_if(c).alias(k) for k, c in measures.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in measures])).alias("x")
    return counts.select("_all", rows).select("x.measure", "x.n", F.round(F.col("x.n") / F.nullif("_all", F.lit(0)), 6).alias("share"))


def label_statuses(labels: DataFrame, names: list[str]) -> DataFrame:
    """(horizon, status, n) of the training split; the test split stays sealed."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("horizon"), F.col(f"label_status_{n}").alias("status")) for n in names])).alias("x")
    return labels.where("split = 'train'").select(rows).groupBy("x.horizon", "x.status").agg(F.count("*").alias("n"))


def small_cells(summary: DataFrame, least: int = 30) -> DataFrame:
    return summary.where(F.col("markets") < least)


def report(features: DataFrame, labels: DataFrame, dropped: DataFrame, names: list[str], facts: dict) -> str:
    """A Markdown report of a training set: what was left out, the split, small cells and the quality of the data."""
    summary = split_summary(features.join(labels.select("trade_key", "outcome_won"), "trade_key", "left"), "canonical_category")
    sections = {
        "Rows not included": dropped.orderBy("reason"), "Split assignment": split_basis(features).orderBy("split", "split_basis"), "Split x category": summary.orderBy("split", "canonical_category"),
        "Small cells": small_cells(summary).select("split", "canonical_category", "markets").orderBy("split", "canonical_category"), "Data quality": quality(features).where("n > 0").orderBy("measure"),
        "Label status (train only)": label_statuses(labels, names).orderBy("horizon", "status"),
    }
    lines = ["# Dataset report", "", *[f"- {k}: {v}" for k, v in facts.items()]]
    for title, rows in sections.items():
        lines += ["", f"## {title}", "", markdown(rows).rstrip("\n")]
    notes = ["labels_test is sealed until the final evaluation.", "overlap_random markets traded before the cutoff and were resolved after it: report with and without them.", "Group by condition_id for uncertainty.", "P&L is gross per share; fees are not known."]
    return "\n".join([*lines, "", "## Notes", "", *[f"- {x}" for x in notes], ""])
