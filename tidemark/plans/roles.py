"""The library's roles on the sample tables: trades from events or lineitem, markets from part, and so on.

The same views are written in DuckDB SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    notional = S.micro_of_double("value")
    price = F.least(F.lit(S.MILLION), F.round(F.col("value") * 1000).cast("bigint"))
    return e.select(
        F.col("event_id").cast("string").alias("trade_key"), F.col("user_id").alias("proxy_wallet"), F.col("event_type").alias("asset_id"),
        F.get_json_object("props", "$.k").cast("int").alias("condition_id"), F.when(F.col("event_id") % 4 == 3, "SELL").otherwise("BUY").alias("side"),
        F.unix_timestamp("ts").alias("trade_ts"), notional.alias("notional_microusd"), price.alias("price_ppm"),
    )


EVENT_TRADES = """trades AS (
    SELECT CAST(event_id AS VARCHAR) AS trade_key, user_id AS proxy_wallet, event_type AS asset_id,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS condition_id, CASE WHEN event_id % 4 = 3 THEN 'SELL' ELSE 'BUY' END AS side,
           CAST(floor(epoch(ts)) AS BIGINT) AS trade_ts, CAST(round(value * 1000000) AS BIGINT) AS notional_microusd,
           least(1000000, CAST(round(value * 1000) AS BIGINT)) AS price_ppm FROM events)"""


def line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order: the wallet is the customer, the market the part."""
    i, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = i.join(o, i.l_orderkey == o.o_orderkey)
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_key"), F.col("o_custkey").alias("proxy_wallet"), F.col("l_suppkey").alias("asset_id"), F.col("l_partkey").alias("condition_id"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.unix_timestamp("l_shipdate").alias("trade_ts"),
        S.micro_of_double("l_extendedprice").alias("notional_microusd"), F.round(F.col("l_discount") * 10_000_000).cast("bigint").alias("price_ppm"), F.col("l_quantity").cast("bigint").alias("quantity"), "l_orderkey", "l_linenumber",
    )


LINE_TRADES = """lines AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trade_key, o_custkey AS proxy_wallet, l_suppkey AS asset_id, l_partkey AS condition_id,
           CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS trade_ts,
           CAST(round(l_extendedprice * 1000000) AS BIGINT) AS notional_microusd, CAST(round(l_discount * 10000000) AS BIGINT) AS price_ppm,
           CAST(l_quantity AS BIGINT) AS quantity, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("condition_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("event_id"), F.col("p_name").alias("title"), F.col("p_size").alias("size"))


MARKETS = "markets AS (SELECT p_partkey AS condition_id, p_type AS category, p_brand AS event_id, p_name AS title, p_size AS size FROM part)"
