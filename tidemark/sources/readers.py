"""Sources: JSON pages over HTTP as a Spark data source, tables of files, and typed CSV."""

from __future__ import annotations

import itertools
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RETRIES, TIMEOUT, LONGEST_WAIT = 3, 20.0, 60.0


class _TryAgain(Exception):
    """A failure that may pass; asked: the seconds that the server wants to be left alone."""

    def __init__(self, cause: Exception, asked: str | None = None) -> None:
        super().__init__(str(cause))
        self.cause = cause
        self.asked = float(asked) if asked and asked.replace(".", "", 1).isdigit() else None


def _answer(url: str, timeout: float, opener: Callable):
    """The JSON behind an address; 429, 5xx, network and JSON errors may pass, others are final."""
    try:
        with opener(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            raise _TryAgain(e, e.headers.get("Retry-After") if e.headers else None) from e
        raise
    except (OSError, ValueError) as e:
        raise _TryAgain(e) from e


def get_json(base: str, path: str, params: dict, retries: int = RETRIES, timeout: float = TIMEOUT, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep):
    """A JSON answer; parameters that are None are left out. Failures that may pass are tried again after growing pauses, or
    after as long as the server asks for."""
    query = urllib.parse.urlencode([(k, v) for k, v in params.items() if v is not None])
    url = "/".join((base.rstrip("/"), path.lstrip("/"))) + ("?" + query if query else "")
    pauses = [2.0**k for k in range(retries)]
    while True:
        try:
            return _answer(url, timeout, opener)
        except _TryAgain as failed:
            if not pauses:
                raise failed.cause from None
            pause = pauses.pop(0)
            sleep(min(LONGEST_WAIT, pause if failed.asked is None else failed.asked) + random.random())


def page(body) -> tuple[list, str | None]:
    """Items and cursor of an answer: a list, or data as a list, data.items or data.rows."""
    data = body.get("data", body) if isinstance(body, dict) else body
    cursor = (body.get("next_cursor") or body.get("nextCursor")) if isinstance(body, dict) else None
    if isinstance(data, dict):
        data = data.get("items", data.get("rows"))
    if not isinstance(data, list):
        raise ValueError("a page without a list of items")
    return data, cursor


class HistoryTruncated(Exception):
    """More pages were there than asked for."""


def pages(fetch: Callable[[str | None], object], limit: int | None = None, whole: bool = False) -> Iterator[list]:
    """Pages by cursor, ``limit`` at most if given; a cursor that comes again is an error, and so is one left at the end if ``whole``."""
    cursor, seen = None, set()
    for _ in itertools.count() if limit is None else range(limit):
        items, cursor = page(fetch(cursor))
        yield items
        if not cursor or not items:
            return
        if cursor in seen:
            raise ValueError(f"cursor {cursor!r} came again")
        seen.add(cursor)
    if whole:
        raise HistoryTruncated(f"more than {limit} pages")


@dataclass
class _Slice(InputPartition):
    params: dict


class HttpJson(DataSource):
    """format("http_json"): options base, path, slices (a JSON list of parameter objects, one partition each), pages (a slice with more is an error; no limit by default)."""

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HttpReader(self.options)


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Slice(x) for x in json.loads(self.options.get("slices", "[{}]"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        fetch = lambda cursor: get_json(o["base"], o["path"], {**partition.params, "cursor": cursor})
        for items in pages(fetch, int(o["pages"]) if "pages" in o else None, whole=True):
            for x in items:
                yield (json.dumps(x, separators=(",", ":"), ensure_ascii=False),)


def trade_feed(trades: DataFrame, start: int | None = None, end: int | None = None, user: str | None = None, condition: str | None = None, side: str | None = "BUY", min_cash: float | None = 100) -> DataFrame:
    """The feed's parameters as filters, which reach the scan of a file table."""
    out = trades
    for column, value, test in (("trade_ts", start, lambda c, v: c >= v), ("trade_ts", end, lambda c, v: c <= v), ("proxy_wallet", user, lambda c, v: c == v), ("condition_id", condition, lambda c, v: c == v), ("side", side, lambda c, v: c == v), ("notional_microusd", min_cash, lambda c, v: c >= int(v * 1_000_000))):
        if value is not None:
            out = out.where(test(F.col(column), value))
    return out


def truncated_history(trades: DataFrame, cap: int, key: str = "proxy_wallet") -> DataFrame:
    """Each wallet's latest ``cap`` rows, with is_truncated where there were more."""
    sizes = trades.groupBy(key).agg((F.count("*") > cap).alias("is_truncated"))
    w = Window.partitionBy(key).orderBy(F.desc("trade_ts"), F.desc("trade_key"))
    return trades.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n").join(sizes, key)


def looked_up(keys: DataFrame, first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns from the first source that has the key, else from the second."""
    a = first.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_a"))
    b = second.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = keys.join(a, key, "left").join(b, key, "left")
    return both.select(*keys.columns, *[F.when(F.col("_a"), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in columns])


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a dimension by key, for each key that asks; a key without a row gets nulls."""
    return keys.join(rows.dropDuplicates([key]), key, "left")


def market_page(markets: DataFrame, closed: bool | None = None, tag: str | None = None, after: int | None = None, limit: int = 100, key: str = "market_id") -> DataFrame:
    """A page of the market feed: the largest ids below ``after``, of open or closed markets and of one tag if given.

    The last row's id is the cursor of the next page. The filters reach the scan, and the page is a top-k, not a sort.
    """
    rows = markets
    if closed is not None:
        rows = rows.where(F.col("closed") == closed)
    if tag is not None:
        rows = rows.where(F.array_contains("tags", tag) if dict(markets.dtypes).get("tags", "").startswith("array") else F.col("tag") == tag)
    if after is not None:
        rows = rows.where(F.col(key) < after)
    return rows.orderBy(F.desc(key)).limit(limit)


def price_history(points: DataFrame, asset, start: int, end: int, fidelity: int | None = None) -> DataFrame:
    """The points (t, price_ppm) of an asset in [start, end]; with a fidelity in minutes the last point of each such step."""
    rows = points.where((F.col("asset_id") == asset) & F.col("t").between(start, end))
    if fidelity is None:
        return rows
    step = F.floor(F.col("t") / (60 * fidelity)).alias("_step")
    return rows.groupBy("asset_id", step).agg(F.max(F.struct("t", "price_ppm")).alias("_p")).select("asset_id", "_p.t", "_p.price_ppm")


def read_training_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows; empty fields are null, and a value that does not fit is an error."""
    return spark.read.schema(schema).options(header=True, nullValue="", mode="FAILFAST").csv(path)


def training_rows(features: DataFrame, labels: DataFrame, horizon: str) -> DataFrame:
    """Training features with their labels, one to one; anything else is an error that names the count."""
    wrong = features.where(F.coalesce(F.col("split") != "train", F.lit(True))).count() + labels.where(F.coalesce(F.col("split") != "train", F.lit(True))).count()
    if wrong:
        raise ValueError(f"{wrong} rows of another split")
    both = features.join(labels.drop("split"), "trade_key", "full")
    n = both.agg(F.count("*").alias("n"), F.count_distinct("trade_key").alias("k"), F.count_if(F.col("outcome_won").isNull()).alias("bad")).first()
    if n["n"] != n["k"] or n["bad"] or n["n"] != features.count():
        raise ValueError(f"{n['n']} joined rows, {n['k']} keys, {n['bad']} without an outcome")
    return both.withColumn("delayed_price", F.col(f"entry_price_{horizon}"))


def merged_schemas(*frames: DataFrame) -> DataFrame:
    """Frames of older and newer schemas, with nulls for what the older lack."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
