"""Order books as arrays of levels struct<price, size> (millionths): sorting, depth and fills by array folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MILLION = 1_000_000


def sorted_asks(levels: Column) -> Column:
    return F.array_sort(levels, lambda a, b: F.when(a["price"] < b["price"], -1).when(a["price"] > b["price"], 1).otherwise(0))


def sorted_bids(levels: Column) -> Column:
    return F.array_sort(levels, lambda a, b: F.when(a["price"] > b["price"], -1).when(a["price"] < b["price"], 1).otherwise(0))


def levels(books: DataFrame, key: str, asks: str = "asks", bids: str = "bids") -> DataFrame:
    """One row a level of each book: key, side, level_number from 0 at the best price, price_ppm, size_microshares."""
    both = [(F.lit("ask"), sorted_asks(F.col(asks))), (F.lit("bid"), sorted_bids(F.col(bids)))]
    rows = [books.select(key, side.alias("side"), F.posexplode(x).alias("level_number", "l")) for side, x in both]
    return rows[0].unionByName(rows[1]).select(key, "side", "level_number", F.col("l.price").alias("price_ppm"), F.col("l.size").alias("size_microshares"))


def of_levels(levels_: DataFrame, key: str, side: str, price: str, size: str) -> DataFrame:
    """Books with their sides as arrays, from rows of levels."""
    pick = lambda x: F.collect_list(F.when(F.col(side) == x, F.struct(F.col(price).alias("price"), F.col(size).alias("size"))))
    return levels_.groupBy(key).agg(sorted_asks(pick("ask")).alias("asks"), sorted_bids(pick("bid")).alias("bids"))


def first_books(books: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the books of one key the first stays; a failure at any time sets its status to failed."""
    rest = [c for c in books.columns if c not in key]
    found = books.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.bool_or(F.col("status") == "failed").alias("_failed"))
    value = lambda c: F.when(F.col("_failed"), "failed").otherwise(F.col("_r.status")) if c == "status" else F.col(f"_r.{c}")
    return found.select(*key, *[value(c).alias(c) for c in rest])


def best_ask(asks: Column) -> Column:
    return F.array_min(F.transform(asks, lambda a: a["price"]))


def best_bid(bids: Column) -> Column:
    return F.array_max(F.transform(bids, lambda a: a["price"]))


def depth_within(asks: Column, delta: int) -> Column:
    best = best_ask(asks)
    return F.when(best.isNotNull(), F.aggregate(F.filter(asks, lambda a: a["price"] <= best + delta), F.lit(0).cast("bigint"), lambda s, a: s + a["size"]))


def average_fill(asks_in_order: Column, budget: int) -> Column:
    """The average price at which a budget buys through the asks; null if they do not suffice."""
    wide = lambda c: c.cast("decimal(20,0)")
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("cost"), F.lit(0).cast("bigint").alias("shares"))

    def take(s: Column, a: Column) -> Column:
        whole = F.floor(wide(a["price"]) * a["size"] / MILLION).cast("bigint")
        part = F.when(a["price"] > 0, F.floor(wide(s["left"]) * MILLION / a["price"]).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        shares = F.when(whole <= s["left"], a["size"]).otherwise(part)
        cost = F.when(whole <= s["left"], whole).otherwise(F.floor(wide(a["price"]) * part / MILLION).cast("bigint"))
        done = s["left"] <= 1
        return F.struct(F.when(done, s["left"]).otherwise(s["left"] - cost).alias("left"), F.when(done, s["cost"]).otherwise(s["cost"] + cost).alias("cost"), F.when(done, s["shares"]).otherwise(s["shares"] + shares).alias("shares"))

    return F.aggregate(asks_in_order, start, take, lambda s: F.when((s["left"] <= 1) & (s["shares"] > 0), F.floor(wide(s["cost"]) * MILLION / s["shares"]).cast("bigint")))


def summary(asks: Column, bids: Column) -> list[Column]:
    order = sorted_asks(asks)
    return [
        best_bid(bids).alias("best_bid"), best_ask(asks).alias("best_ask"), (best_ask(asks) - best_bid(bids)).alias("spread"),
        depth_within(asks, 10_000).alias("depth_1c"), depth_within(asks, 50_000).alias("depth_5c"),
        *[average_fill(order, usd * MILLION).alias(f"fill_{usd}") for usd in (100, 500, 1000)],
    ]
