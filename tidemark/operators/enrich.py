"""Point-in-time activity: wallet summaries over a window or before each trade, the last hour, bursts and scores."""

from __future__ import annotations

import bisect
import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


FRACTIONS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def quantiles(rows: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact quantiles by linear interpolation, cut toward zero, without gathering a group's values.

    Equal values are one row with a count; counts are added up in order, and a quantile needs two places in that order.
    """
    counted = rows.groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    total = counted.groupBy(*by).agg(F.sum("_n").alias("_all"))
    placed = counted.withColumn("_upto", F.sum("_n").over(running)).join(total, by)
    place = {k: (F.col("_all") - 1) * F.lit(q) for k, q in fractions.items()}
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_x")))
    found = placed.groupBy(*by).agg(
        F.first("_all").alias("_all"),
        *[at(F.floor(p)).alias(f"_a{k}") for k, p in place.items()],
        *[at(F.least(F.floor(p) + 1, F.col("_all") - 1)).alias(f"_b{k}") for k, p in place.items()],
    )
    between = {k: (F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * (p - F.floor(p))).cast("bigint") for k, p in place.items()}
    return found.select(*by, *[c.alias(k) for k, c in between.items()])


def wallet_summary(history: DataFrame, start: Column | int, end: Column | int, key: str = "proxy_wallet") -> DataFrame:
    """Counts, amounts, quantiles, sides and market shares of each wallet's trades in [start, end].

    Two levels of partial sums: by (wallet, market, side), then by wallet; sides and the five largest markets are the only
    arrays, and both are bounded.
    """
    inside = F.col("trade_ts").between(start, end)
    rows = history.withColumns({"_in": inside, "_bad": F.col("notional_microusd").isNull() | F.col("price_ppm").isNull()})
    ok = rows.where("_in and not _bad")
    counted = rows.groupBy(key).agg(F.count("*").alias("received_count"), F.count_if("_bad").alias("malformed_count"), F.count_if(~F.col("_bad") & ~inside).alias("outside_count"))
    markets = ok.groupBy(key, "condition_id").agg(F.sum("notional_microusd").alias("v")).groupBy(key).agg(F.max("v").alias("largest_market"), F.count("*").alias("distinct_market_count"))
    sides = ok.groupBy(key, "side").agg(F.count("*").alias("n"), F.sum("notional_microusd").alias("v")).groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("side", "n")))).alias("side_counts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("side", "v")))).alias("side_notional")
    )
    top = top_markets(ok, 5, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "condition_id", "volume", "trades"))), lambda x: F.struct(x["condition_id"].alias("condition_id"), x["volume"].alias("volume"), x["trades"].alias("trades"))).alias("top_markets"))
    week = F.lit(end) + 1 - 7 * S.DAY
    sums = ok.groupBy(key).agg(
        F.count("*").alias("observed_trade_count"), F.count_distinct("asset_id").alias("distinct_outcome_count"), F.count_distinct(F.floor(F.col("trade_ts") / S.DAY)).alias("active_days"),
        F.min("trade_ts").alias("first_ts"), F.max("trade_ts").alias("last_ts"), F.count_if(F.col("side") == "BUY").alias("buy_count"), F.count_if(F.col("side") == "SELL").alias("sell_count"),
        F.sum("notional_microusd").alias("total"), F.expr("sum(notional_microusd) div count(*)").alias("mean"), F.expr("sum(price_ppm) div count(*)").alias("mean_price"),
        F.min("notional_microusd").alias("least"), F.max("notional_microusd").alias("most"), F.bround(F.stddev_pop("notional_microusd")).cast("bigint").alias("stddev"),
        F.count_if(F.col("price_ppm") <= 250_000).alias("cheap_trade_count"), F.count_if(F.col("trade_ts") >= week).alias("last_7d_trade_count"),
        F.coalesce(F.sum(F.when(F.col("trade_ts") >= week, F.col("notional_microusd"))), F.lit(0)).alias("last_7d_notional"),
    )
    out = counted.join(sums, key, "left").join(markets, key, "left").join(sides, key, "left").join(top, key, "left").join(quantiles(ok, [key], "notional_microusd", FRACTIONS), key, "left")
    share = F.when(F.col("total") > 0, F.floor(F.col("largest_market").cast("decimal(20,0)") * S.MILLION / F.col("total")).cast("bigint"))
    return out.withColumns({"largest_market_share_ppm": share, "seconds_since_last": F.lit(end) + 1 - F.col("last_ts")}).drop("largest_market")


#: Rows of a wallet's history that a point in time looks back on at most, the latest; there is a flag where there were more.
HISTORY_CAP = 50_000
_AT_TIME = "observed_trade_count long, distinct_market_count long, distinct_outcome_count long, active_days long, total long, mean long, median long, p90 long, most long, stddev long, mean_price long, cheap_trade_count long, last_7d_trade_count long, last_7d_notional long, seconds_since_last long, largest_market_share_ppm long, buy_count long, sell_count long, buy_notional long, history_truncated int"


def point_in_time_summary(trades: DataFrame, history: DataFrame, days: int = 30, cap: int | None = HISTORY_CAP, key: str = "proxy_wallet") -> DataFrame:
    """For each (wallet, moment) of trades the summary of the wallet's history in [moment - days, moment - 1].

    No row at or after the moment counts, so nothing looks ahead. Time is cut into slices of the window's length, and a
    moment looks at its own slice and the one before: a wallet's history is many groups, each of two slices at most, and
    moves over its moments in order. History rows: wallet, trade_ts, condition_id, asset_id, side, notional_microusd,
    price_ppm; rows without an amount or price do not count, nor do null markets and assets count as one more. Moments without
    history, and those without a wallet or time, have counts and a total of 0 and null figures. ``cap`` None: all of the window.
    """
    span = days * S.DAY
    slice_ = F.floor(F.col("trade_ts") / span)
    asked_for = trades.select(F.col(key).alias("w"), "trade_ts", slice_.alias("s"))
    moments = asked_for.where("w is not null and trade_ts is not null").distinct()
    rows = history.where(F.col("notional_microusd").isNotNull() & F.col("price_ppm").isNotNull() & F.col("trade_ts").isNotNull()).select(
        F.col(key).alias("w"), F.col("trade_ts").alias("t"), F.xxhash64("condition_id").alias("market"), F.xxhash64("asset_id").alias("asset"), (F.col("side") == "BUY").alias("buy"),
        F.col("notional_microusd").alias("v"), F.col("price_ppm").alias("p"), F.explode(F.array(slice_, slice_ + 1)).alias("s"),
    )
    kind = trades.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in _AT_TIME.split(", ")]

    def run(group: tuple, asked: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame(columns=[key, "trade_ts", *names])
        if not len(past):
            past = pd.DataFrame(columns=["t", "market", "asset", "buy", "v", "p"])
        asked = asked.sort_values("trade_ts")
        past = past.sort_values(["t", "v", "market", "asset"], kind="stable").reset_index(drop=True)
        t = past["t"].to_numpy(np.int64)
        moments_ = asked["trade_ts"].to_numpy(np.int64)
        ends = np.searchsorted(t, moments_, side="left")
        begins = np.searchsorted(t, np.maximum(1, moments_ - span), side="left")
        window = _Window()
        amounts = [0, *itertools.accumulate(past["v"].tolist())]
        columns = list(zip(t.tolist(), *[past[c].tolist() for c in ("v", "p", "market", "asset")], past["buy"].fillna(False).tolist(), strict=True))
        out, low, high = [], 0, 0
        for at, a, b in zip(moments_.tolist(), begins.tolist(), ends.tolist(), strict=True):
            start = a if cap is None else max(a, b - cap)
            while high < b:
                window.add(columns[high])
                high += 1
            while low < start:
                window.remove(columns[low])
                low += 1
            recent = max(start, int(np.searchsorted(t, at - 7 * S.DAY, side="left")))
            out.append(window.figures(at, t[b - 1].item() if b > start else None, b - recent, amounts[b] - amounts[recent], start > a))
        found = pd.DataFrame(out, columns=names).astype("Int64")
        found.insert(0, "trade_ts", moments_)
        found.insert(0, key, asked["w"].to_numpy())
        return found

    found = moments.groupBy("w", "s").cogroup(rows.groupBy("w", "s")).applyInPandas(run, f"{key} {kind}, trade_ts long, {_AT_TIME}")
    # Moments that no history can be before gather in no group.
    lost = asked_for.where("w is null or trade_ts is null").select(F.col("w").alias(key), F.col("trade_ts").cast("long").alias("trade_ts")).distinct()
    empty = zip(_AT_TIME.split(", "), _Window().figures(0, None, 0, 0, False), strict=True)
    return found.union(lost.select(key, "trade_ts", *[F.lit(x).cast(n.split()[1]).alias(n.split()[0]) for n, x in empty]))


#: xxhash64 of null.
_NULL = 42


class _Window:
    """The rows of a moving window: sums, counts by market, asset and day, and the amounts in order."""

    def __init__(self) -> None:
        self.amounts: list[int] = []
        self.total = self.squares = self.price = self.cheap = self.buys = self.bought = 0
        self.volume: dict[int, int] = {}
        self.markets: Counter = Counter()
        self.assets: Counter = Counter()
        self.days: Counter = Counter()

    def add(self, row: tuple, sign: int = 1) -> None:
        t, v, p, market, asset, buy = row
        if sign > 0:
            bisect.insort(self.amounts, v)
        else:
            del self.amounts[bisect.bisect_left(self.amounts, v)]
        self.total += sign * v
        self.squares += sign * v * v
        self.price += sign * p
        self.cheap += sign * (p <= 250_000)
        self.buys += sign * bool(buy)
        self.bought += sign * v * bool(buy)
        self.volume[market] = self.volume.get(market, 0) + sign * v
        for counter, x in ((self.markets, market), (self.assets, asset), (self.days, t // S.DAY)):
            counter[x] += sign
            if not counter[x]:
                del counter[x]
                if counter is self.markets:
                    del self.volume[market]

    def remove(self, row: tuple) -> None:
        self.add(row, -1)

    def quantile(self, q: float) -> int:
        i = (len(self.amounts) - 1) * q
        a, b = self.amounts[int(i)], self.amounts[min(int(i) + 1, len(self.amounts) - 1)]
        return int(a + (b - a) * (i - int(i)))

    def figures(self, at: int, last: int | None, week: int, week_total: int, truncated: bool) -> tuple:
        n = len(self.amounts)
        if not n:
            return (0, 0, 0, 0, 0, *[None] * 6, 0, 0, 0, None, None, 0, 0, 0, int(truncated))
        deviation = math.sqrt(max(0, n * self.squares - self.total * self.total)) / n
        share = max(self.volume.values()) * S.MILLION // self.total if self.total else None
        return (
            n, len(self.markets) - (_NULL in self.markets), len(self.assets) - (_NULL in self.assets), len(self.days), self.total, self.total // n, self.quantile(0.5), self.quantile(0.9), self.amounts[-1], round(deviation), self.price // n, self.cheap,
            week, week_total, at - last, share, self.buys, n - self.buys, self.bought, int(truncated),
        )


def top_markets(history: DataFrame, k: int = 5, key: str = "proxy_wallet") -> DataFrame:
    """Each wallet's k markets of the largest volume; ties to the smaller id."""
    by_market = history.groupBy(key, "condition_id").agg(F.sum("notional_microusd").alias("volume"), F.count("*").alias("trades"))
    w = Window.partitionBy(key).orderBy(F.desc("volume"), "condition_id")
    return by_market.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def trailing_activity(trades: DataFrame, seconds: int = 3600, partition: str = "asset_id") -> DataFrame:
    """Count and amount of the trades of the same asset in [t - seconds, t)."""
    w = Window.partitionBy(partition).orderBy("trade_ts").rangeBetween(-seconds, -1)
    return trades.withColumns({"recent_count": F.count("*").over(w), "recent_notional": F.coalesce(F.sum("notional_microusd").over(w), F.lit(0))})


def trailing_activity_by_time(trades: DataFrame, seconds: int = 3600, partition: str = "asset_id", **sums: Column) -> DataFrame:
    """The same for assets of any size, with further sums by name: each (asset, slice of time) is a window of its own.

    A slice needs the slice before it; the rows of both are sorted together, but no task holds more than two slices.
    """
    slice_ = F.floor(F.col("trade_ts") / seconds)
    both = trades.select("*", *[c.alias(f"_{n}") for n, c in sums.items()], F.explode(F.array(F.struct(slice_.alias("at"), F.lit(True).alias("own")), F.struct((slice_ + 1).alias("at"), F.lit(False).alias("own")))).alias("_s"))
    w = Window.partitionBy(partition, "_s.at").orderBy("trade_ts").rangeBetween(-seconds, -1)
    extra = {n: F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)) for n in sums}
    found = both.withColumns({"recent_count": F.count("*").over(w), "recent_notional": F.coalesce(F.sum("notional_microusd").over(w), F.lit(0)), **extra})
    return found.where("_s.own").drop("_s", *[f"_{n}" for n in sums])


def young_buys(trades: DataFrame, wallets: DataFrame, seconds: int = 3600, young: int = 7 * S.DAY) -> DataFrame:
    """Adds recent_count, recent_notional and young_count of the same asset's last hour.

    wallets: (proxy_wallet, as_of_ts, wallet_age_seconds), the wallet as it was at each of its trades; no row: not young.
    """
    aged = trades.join(wallets.select("proxy_wallet", F.col("as_of_ts").alias("trade_ts"), "wallet_age_seconds"), ["proxy_wallet", "trade_ts"], "left")
    return trailing_activity_by_time(aged, seconds, young_count=F.coalesce(F.col("wallet_age_seconds") < young, F.lit(False)).cast("long"))


def bursts(trades: DataFrame, gap: int = 60, by: tuple[str, ...] = ("proxy_wallet", "asset_id"), slice_seconds: int = S.DAY) -> DataFrame:
    """burst_id (the first trade's key) and burst_size of runs with gaps of at most ``gap`` seconds.

    Runs are found within slices of time, so no task holds a wallet's whole history; then only the first and the last run
    of each slice, two rows, are joined to those of the slices beside it.
    """
    by = list(by)
    start, end = F.struct("trade_ts", "trade_key"), F.col("trade_ts")
    w = Window.partitionBy(*by, "_s").orderBy("trade_ts", "trade_key")
    new = F.when(end - F.lag("trade_ts").over(w) <= gap, 0).otherwise(1)
    local = trades.withColumn("_s", F.floor(F.col("trade_ts") / max(slice_seconds, gap + 1))).withColumn("_new", new)
    local = local.withColumn("_b", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    runs = local.groupBy(*by, "_s", "_b").agg(F.min(start).alias("first"), F.max("trade_ts").alias("last"), F.count("*").alias("n"))
    ends = runs.groupBy(*by, "_s").agg(F.min("_b").alias("lo"), F.max("_b").alias("hi"))
    edge = runs.join(ends, [*by, "_s"]).where("_b = lo or _b = hi")
    order = Window.partitionBy(*by).orderBy("_s", "_b")
    joins = (F.col("_b") == F.col("lo")) & (F.col("first.trade_ts") - F.lag("last").over(order) <= gap)
    chained = edge.withColumn("_g", F.sum(F.when(joins, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = chained.groupBy(*by, "_g").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    linked = chained.select(*by, "_s", "_b", "_g").join(whole, [*by, "_g"]).select(*by, "_s", "_b", F.col("first.trade_key").alias("burst_id"), F.col("n").alias("burst_size"))
    inner = runs.join(ends, [*by, "_s"]).where("_b <> lo and _b <> hi").select(*by, "_s", "_b", F.col("first.trade_key").alias("burst_id"), F.col("n").alias("burst_size"))
    return local.join(linked.unionByName(inner), [*by, "_s", "_b"]).drop("_s", "_b")


def scored(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds score, bucket and components; columns: the inputs of score_components."""
    return rows.withColumn("components", S.score_components(**columns)).withColumn("score", S.score_of(F.col("components"))).withColumn("bucket", S.score_bucket(F.col("score")))
