"""Row numbers over a whole table without a task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, name: str, part: Column, order: list[Column | str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds the row's number from 0 in the order of (part, *order), within each group of ``by``.

    ``part`` cuts the order into ranges: rows are numbered within a range, and the sizes of the ranges before it are added.
    The ranges' sizes are one row each, so their number should be bounded (a prefix of a hash, a bin of a share).
    """
    placed = rows.withColumn("_part", part)
    sizes = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*by, "_part", F.coalesce(ahead, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    joined = placed.withColumn("_within", within).join(starts, [*by, "_part"])
    return joined.withColumn(name, F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")
