"""Sinks: CSV exports, datasets that are never overwritten, manifests with checksums, and small reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, order: list[str] = [], decimals: int | None = None) -> None:  # noqa: B006
    """Header, empty text for null, LF; refuses to write over anything."""
    if decimals is not None:
        rows = rows.select(*[F.round(c, decimals).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])
    (rows.orderBy(*order) if order else rows).write.mode("errorifexists").options(header=True, nullValue="", emptyValue="", lineSep="\n").csv(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files below a path, read where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, path: str, **facts) -> None:
    """manifest/ beside the data: one JSON document of the facts and the files' checksums."""
    files = [r.asDict() for r in checksums(spark, path).where(~F.col("file").startswith("_")).orderBy("file").collect()]
    spark.createDataFrame([(json.dumps({**facts, "files": files}, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


#: More rows than this are no small report.
REPORT_ROWS = 10_000


def markdown(rows: DataFrame, most: int = REPORT_ROWS) -> str:
    """A table of a small report; one of more than ``most`` rows is an error, nothing is cut off."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in found]) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document as a folder with one text file; refuses to write over anything."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, sort_keys=True, indent=2, default=str))


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON, as CSV has none."""
    return rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes])


def export(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Several ordered tables as CSV folders."""
    for name, (rows, order) in tables.items():
        write_csv(flat(rows), f"{path}/{name}", order)


def compacted(raw: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """The rows that must stay: those whose key has no summary yet."""
    return raw.join(summaries.select(key), key, "left_anti")
