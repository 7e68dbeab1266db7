"""Live ingest: overlapping polls, each record once in the store, late rows dropped, and work fanned out from each new trade."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ingest import admit, first_wins
from tidemark.operators.labels import HORIZONS, TOLERANCE
from tidemark.scratch import children

#: Seconds by which polls overlap, seconds that a first poll looks back, and seconds after which a record counts as late.
OVERLAP, FIRST, LATEST = 60, 120, 600


def source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files that grows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(path)


def poll_window(last_ts: int | None, now: int) -> tuple[int, int]:
    """What the next poll asks for: from a little before the last trade, so that nothing falls between two polls."""
    return max(1, last_ts - OVERLAP if last_ts else now - FIRST), now


def in_window(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Sources ignore the bounds at times, so they are checked here again, both ends included."""
    return rows.where(F.col("trade_ts").between(start, end))


def each_once(trades: DataFrame, key: str = "trade_key", late: int = LATEST) -> DataFrame:
    """Drops repeats of a key within the watermark, and rows later than it; older state is forgotten. store_once knows all keys."""
    timed = trades.withColumn("event_time", F.timestamp_seconds("trade_ts"))
    return timed.withWatermark("event_time", f"{late} seconds").dropDuplicatesWithinWatermark([key])


def store_once(path: str, key: str = "trade_key", then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each key once for ever: batch n is the folder batch=n, written over if the batch comes again.

    A batch meets only stored rows of its own span of time, which the scan's statistics find; its own earlier try does not count.
    """

    def sink(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            span = rows.agg(F.min("trade_ts").alias("a"), F.max("trade_ts").alias("b")).first()
            fresh = first_wins(rows, [[key]], ["trade_ts"])
            folders = [f"{path}/{x}" for x in children(spark, path) if x.startswith("batch=") and x != f"batch={n}"]
            if folders and span["a"] is not None:
                known = spark.read.parquet(*folders).where(F.col("trade_ts").between(span["a"], span["b"])).select(key)
                fresh = fresh.join(known, key, "left_anti")
            fresh.write.mode("overwrite").parquet(f"{path}/batch={n}")
            if then is not None:
                then(spark.read.parquet(f"{path}/batch={n}"), n)
        finally:
            rows.unpersist()

    return sink


def fan_out(trades: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row of due work for each trade and horizon."""
    due = trades.withColumn("horizon_seconds", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return due.select("trade_key", "asset_id", "horizon_seconds", (F.col("trade_ts") + F.col("horizon_seconds")).alias("due_at"))


def is_on_time(due_at: Column, now: Column, tolerance: int = TOLERANCE) -> Column:
    """Whether an observation still counts as live; later ones come from history."""
    return now - due_at <= tolerance


def routed(due: DataFrame, now: int, tolerance: int = TOLERANCE) -> DataFrame:
    """Adds the path of each due observation: wait until its time, live while it is on time, history after that."""
    at = F.col("due_at")
    return due.withColumn("path", F.when(at > now, "wait").when(is_on_time(at, F.lit(now), tolerance), "live").otherwise("history"))


def run(trades: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Admitted trades to an idempotent sink; all that is there and then the end, or every ``interval``."""
    writer = each_once(admit(trades)).writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
