"""Outcomes and delayed prices: resolution evidence, forward as-of labels with a tolerance, fills and P&L."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.functions import scalars as S

HORIZONS = (900, 3600, 86_400)
TOLERANCE = 300


def resolution_evidence(markets: DataFrame, expected: Column | None = None) -> DataFrame:
    """Adds quality, terminal and winner to rows with condition_id, closed, status and JSON outcomes, prices and tokens.

    The first reason in the list that holds is the quality.
    """
    o, p, t = (S.string_list(F.col(c)) for c in ("outcomes", "outcome_prices", "token_ids"))
    outs, toks = F.transform(o, lambda x: F.trim(x)), F.transform(t, lambda x: F.trim(x))
    prices = F.transform(p, lambda x: x.try_cast("decimal(38,18)"))
    quoted = lambda c: ~F.coalesce(F.col(c).rlike(r"^\s*\[(?:\s*\"(?:[^\"\\]|\\.)*\"\s*,?)*\s*\]\s*$"), F.lit(False))
    status = F.nullif(F.lower(F.trim("status")), F.lit(""))
    distinct = lambda a: F.size(F.array_distinct(a)) != F.size(a)
    ones = F.size(F.filter(prices, lambda x: x == 1))
    quality = (
        (F.when(F.lower(F.trim("condition_id")) != F.lower(F.trim(expected)), "condition_mismatch") if expected is not None else F.when(F.lit(False), ""))
        .when(~F.coalesce("closed", F.lit(False)), "not_closed")
        .when(o.isNull(), "missing_outcomes").when(p.isNull(), "missing_outcome_prices").when(t.isNull(), "missing_clob_tokens")
        .when(quoted("outcomes"), "invalid_outcomes").when(quoted("token_ids"), "invalid_clob_tokens").when(F.exists(prices, lambda x: x.isNull()), "invalid_outcome_prices")
        .when((F.size(outs) == 0) | (F.size(outs) != F.size(prices)) | (F.size(outs) != F.size(toks)), "outcome_length_mismatch")
        .when(F.exists(outs, lambda x: x == ""), "empty_outcome").when(F.exists(toks, lambda x: x == ""), "empty_clob_token")
        .when(distinct(F.transform(outs, lambda x: F.lower(x))), "duplicate_outcomes").when(distinct(toks), "duplicate_clob_tokens")
        .when((ones != 1) | F.exists(prices, lambda x: (x != 0) & (x != 1)), "ambiguous_outcome_prices")
        .when(status.isNotNull() & (status != "resolved"), "nonterminal_resolution").otherwise("terminal_outcome_prices")
    )
    rows = markets.withColumn("quality", quality).withColumn("terminal", F.col("quality") == "terminal_outcome_prices")
    return rows.withColumn("winner", F.when(F.col("terminal"), F.array_position(prices, F.lit(1).cast("decimal(38,18)")) - 1).cast("int"))


def dispute_flag(*values: Column) -> Column:
    """The first value that reads as a truth value."""
    read = [F.when(F.lower(F.trim(v.cast("string"))).isin("true", "1"), True).when(F.lower(F.trim(v.cast("string"))).isin("false", "0"), False) for v in values]
    return F.coalesce(*read, F.lit(False))


def outcome_won(outcome_index: Column, winner: Column) -> Column:
    return outcome_index == winner


def forward_as_of(trades: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = HORIZONS, tolerance: int = TOLERANCE, by: str = "asset_id", rank: str | None = None) -> DataFrame:
    """For each trade and horizon the earliest price in [target, target + tolerance], least price first on ties.

    ``rank`` names a column of prices that comes before the time: the least rank with any price counts.

    Time is cut into slices of the tolerance, and a target looks at its own slice and the next, so the join has equal keys
    that are spread over time however large an asset is. Trades without a price stay, with nulls.
    """
    wanted = trades.withColumn("horizon_seconds", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("target", F.col("trade_ts") + F.col("horizon_seconds"))
    looked = wanted.select("trade_key", "horizon_seconds", by, "target", F.explode(F.array(F.floor(F.col("target") / tolerance), F.floor(F.col("target") / tolerance) + 1)).alias("_slice"))
    ranks = [rank] if rank else []
    points = prices.select(F.col(by), *ranks, F.col("t").alias("observed_at"), F.col("price_ppm").alias("entry_price_ppm"), F.floor(F.col("t") / tolerance).alias("_slice"))
    hits = looked.join(points, [by, "_slice"]).where((F.col("observed_at") >= F.col("target")) & (F.col("observed_at") <= F.col("target") + tolerance))
    best = hits.groupBy("trade_key", "horizon_seconds").agg(F.min(F.struct(*ranks, "observed_at", "entry_price_ppm")).alias("_b")).select("trade_key", "horizon_seconds", "_b.*")
    return wanted.join(best, ["trade_key", "horizon_seconds"], "left")


def resolution_lookup(wanted: DataFrame, closed: DataFrame, key: str = "condition_id") -> DataFrame:
    """wanted (key) with the one closed row of each market; missing_resolution without a row, ambiguous_response with several."""
    rest = [c for c in closed.columns if c != key]
    found = closed.groupBy(key).agg(F.count("*").alias("answers"), F.min(F.struct(*rest)).alias("_r"))
    joined = wanted.join(found, key, "left")
    verdict = F.when(F.col("answers").isNull(), "missing_resolution").when(F.col("answers") > 1, "ambiguous_response")
    return joined.select(*wanted.columns, verdict.alias("lookup_error"), *[F.when(F.col("answers") == 1, F.col(f"_r.{c}")).alias(c) for c in rest])


def without_conflicts(evidence: DataFrame, outcomes: DataFrame) -> DataFrame:
    """evidence (condition_id, tokens, terminal, winner, quality): a terminal market with a token of another market is not terminal."""
    tokens = evidence.where("terminal").select("condition_id", F.explode("tokens").alias("asset_id"))
    other = tokens.join(outcomes.select("asset_id", F.col("condition_id").alias("_m")), "asset_id").where("_m <> condition_id").select("condition_id").distinct().withColumn("_c", F.lit(True))
    clash = F.coalesce("_c", F.lit(False))
    return evidence.join(other, "condition_id", "left").withColumns({
        "terminal": F.col("terminal") & ~clash, "winner": F.when(~clash, F.col("winner")), "quality": F.when(clash, "token_condition_conflict").otherwise(F.col("quality")),
    }).drop("_c")


#: The sources of a label's price in the order in which they count.
SOURCES = ("historical_price_history", "historical_trade_print")


def labelled(trades: DataFrame, series: DataFrame, prints: DataFrame, horizons: tuple[int, ...] = HORIZONS, tolerance: int = TOLERANCE, by: str = "asset_id") -> DataFrame:
    """Labels from the price series, else from trade prints; trades carry resolved_at and won.

    Both sources go through one as-of join, with the source as the first part of what is least.
    status: unavailable_before_horizon, price_unavailable or complete.
    """
    both = series.select(by, "t", "price_ppm", F.lit(0).alias("rank")).unionByName(prints.select(by, "t", "price_ppm", F.lit(1).alias("rank")))
    rows = forward_as_of(trades, both, horizons, tolerance, by, rank="rank")
    early = F.coalesce(F.col("resolved_at") <= F.col("target"), F.lit(False))
    price = F.when(~early, F.col("entry_price_ppm"))
    source = F.when(price.isNotNull(), F.get(F.array(*[F.lit(x) for x in SOURCES]), F.col("rank")))
    return rows.select(
        "trade_key", "horizon_seconds", F.col("target").alias("scheduled_at"), F.when(~early, F.col("observed_at")).alias("observed_at"), price.alias("entry_price_ppm"), source.alias("price_source"),
        F.when(early, "unavailable_before_horizon").when(price.isNull(), "price_unavailable").otherwise("complete").alias("status"), "won", S.gross_pnl(F.col("won"), price).alias("gross_pnl"),
    )


def live_labels(due: DataFrame, books: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """due (trade_key, asset_id, horizon_seconds, due_at, now) with the asset's book at that time: what a live observation gives.

    books: asset_id, asks and bids (array<struct<price,size>>). More than ``tolerance`` late: path is "history" and nothing
    else is set. Without an ask the price is unavailable; else the label waits for the resolution, with three fills.
    """
    rows = due.join(books, "asset_id", "left").withColumn("path", F.when(F.col("now") > F.col("due_at") + tolerance, "history").otherwise("live"))
    live = F.col("path") == "live"
    asks, bids = (F.coalesce(c, F.array().cast("array<struct<price:bigint,size:bigint>>")) for c in ("asks", "bids"))
    priced = live & book.best_ask(asks).isNotNull()
    fills = F.array(*[F.struct(F.lit(usd * S.MILLION).cast("bigint").alias("notional"), book.average_fill(book.sorted_asks(asks), usd * S.MILLION).alias("average")) for usd in (100, 500, 1000)])
    fills = F.transform(fills, lambda f: F.struct(f["notional"].alias("target_notional_microusd"), f["average"].alias("average_fill_price_ppm"), S.fill_shares(f["notional"], f["average"]).alias("shares_microshares")))
    return rows.select(
        "trade_key", "horizon_seconds", "path", F.when(priced, "observed_pending_resolution").when(live, "price_unavailable").alias("status"), F.when(priced, F.col("now")).alias("observed_at"),
        F.when(priced, book.best_ask(asks)).alias("entry_price_ppm"), F.when(priced, F.lit("live_order_book")).alias("price_source"), F.when(priced, book.best_bid(bids)).alias("best_bid_ppm"),
        F.when(priced, book.best_ask(asks) - book.best_bid(bids)).alias("spread_ppm"), F.when(priced, book.depth_within(asks, 10_000)).alias("ask_depth_1c"), F.when(priced, book.depth_within(asks, 50_000)).alias("ask_depth_5c"), F.when(priced, fills).alias("fills"),
    )


def finalized(labels: DataFrame, trades: DataFrame, outcomes: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Labels with a price get the outcome and the gross P&L of their resolved market; waiting ones become complete.

    Markets without a terminal resolution, unknown outcomes and labels without a price stay as they are.
    """
    known = resolutions.where(F.col("terminal").cast("boolean")).select("condition_id", F.col("winner").alias("_winner"))
    index = trades.select("trade_key", "asset_id", "condition_id").join(outcomes.select("asset_id", "outcome_index"), "asset_id").join(known, "condition_id")
    won = outcome_won(F.col("outcome_index"), F.col("_winner"))
    rows = labels.join(index.select("trade_key", won.alias("_won")), "trade_key", "left")
    settled = F.col("_won").isNotNull() & F.col("entry_price_ppm").isNotNull()
    value = {
        "outcome_won": F.when(settled, F.col("_won").cast("int")).otherwise(F.col("outcome_won").cast("int")), "gross_pnl": F.when(settled, S.gross_pnl(F.col("_won"), F.col("entry_price_ppm"))).otherwise(F.col("gross_pnl")),
        "status": F.when(settled & (F.col("status") == "observed_pending_resolution"), "complete").otherwise(F.col("status")),
    }
    return rows.select(*[value.get(c, F.col(c)).alias(c) for c in labels.columns])


def finalized_scenarios(scenarios: DataFrame, labels: DataFrame) -> DataFrame:
    """Fill scenarios (trade_key, horizon_seconds, target_notional_microusd, average_fill_price_ppm) with shares and P&L of their finalised labels."""
    shares = S.fill_shares(F.col("target_notional_microusd"), F.col("average_fill_price_ppm"))
    rows = scenarios.join(labels.select("trade_key", "horizon_seconds", F.col("outcome_won").cast("boolean").alias("_won")), ["trade_key", "horizon_seconds"], "left")
    return rows.withColumn("shares_microshares", shares).withColumn("gross_pnl", S.scenario_pnl(F.col("shares_microshares"), F.col("_won"), F.col("target_notional_microusd"))).drop("_won")


def to_recheck(resolutions: DataFrame, now: int, every: int = 6 * 3600) -> DataFrame:
    """Markets that are not terminal yet and were last looked at ``every`` seconds ago or earlier."""
    return resolutions.where(~F.col("terminal").cast("boolean") & (F.coalesce("checked_at", F.lit(0)) + every <= now)).select("condition_id", F.coalesce("checked_at", F.lit(0)).alias("checked_at"))


def pivot_labels(labels: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row per trade with the columns of each horizon."""
    return labels.groupBy("trade_key").pivot("horizon_seconds", list(horizons)).agg(F.first("entry_price_ppm").alias("price"), F.first("gross_pnl").alias("pnl"), F.first("status").alias("status"))
