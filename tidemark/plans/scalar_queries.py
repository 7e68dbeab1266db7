"""Queries of the scalar functions on the sample tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import ingest, labels
from tidemark.plans.registry import query
from tidemark.plans.roles import EVENT_TRADES, event_trades, table


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, 'none') AS v FROM orders")
def b1_first_alias(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", S.first_of(F.when(k % 3 == 0, F.col("o_orderstatus")), F.when(k % 2 == 0, F.col("o_orderpriority")), F.lit("none")).alias("v"))


_JSON = """'{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}'"""


@query(f"SELECT c_custkey, {_JSON} AS json, sha256({_JSON}) AS hash FROM customer")
def b2_b3_canonical_json(spark: SparkSession, d: str) -> DataFrame:
    names = ("c_nationkey", "c_custkey", "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", S.canonical_json(*names).alias("json"), S.content_hash(*names).alias("hash"))


_PRICE = "CAST(l_orderkey % 997 AS VARCHAR) || '.' || lpad(CAST(l_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') || lpad(CAST(l_suppkey AS VARCHAR), 3, '0')"
_SIZE = "CAST(l_orderkey * 1000003 AS VARCHAR) || '.' || lpad(CAST(l_linenumber * 37 AS VARCHAR), 3, '0')"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(CAST({_SIZE} AS DECIMAL(38, 3)) * 1000000) AS BIGINT) AS size_micro, CAST(round(CAST({_PRICE} AS DECIMAL(18, 12)), 6) * 1000000 AS BIGINT) AS price_micro,
    CAST(round(CAST({_PRICE} AS DECIMAL(19, 12)) * CAST({_SIZE} AS DECIMAL(19, 3)), 6) * 1000000 AS BIGINT) AS notional FROM lineitem""")
def b4_b5_b7_large_decimals(spark: SparkSession, d: str) -> DataFrame:
    """Sizes above 10^9 and prices of twelve places."""
    i = table(spark, d, "lineitem")
    text = lambda c: c.cast("string")
    price = F.concat(text(F.col("l_orderkey") % 997), F.lit("."), F.lpad(text(F.col("l_partkey") * 7919 % 1_000_000_000), 9, "0"), F.lpad(text(F.col("l_suppkey")), 3, "0"))
    size = F.concat(text(F.col("l_orderkey") * 1_000_003), F.lit("."), F.lpad(text(F.col("l_linenumber") * 37), 3, "0"))
    return i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.millionths(size).alias("size_micro"), S.millionths(price).alias("price_micro"), S.notional(price, size).alias("notional"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 >= 2 THEN CAST(round(CAST(c_acctbal AS DECIMAL(18, 2)) * 1000000) AS BIGINT) END AS v FROM customer")
def b6_optional_amounts(spark: SparkSession, d: str) -> DataFrame:
    k, amount = F.col("c_custkey") % 4, F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    return table(spark, d, "customer").select("c_custkey", S.optional_millionths(F.when(k == 0, "").when(k == 1, "n/a").otherwise(amount)).alias("v"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS t FROM orders")
def b8_b20_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Digits, digits with a fraction, ISO with and without a zone, and text that is no time."""
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    digits = F.unix_timestamp(at).cast("string")
    text = F.when(k == 0, digits).when(k == 1, F.concat(digits, F.lit(".75"))).when(k == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    start, _ = S.market_times([F.lit(None).cast("string"), text], [text])
    return table(spark, d, "orders").select("o_orderkey", start.alias("t"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '{\"a\":' || o_custkey || ',\"b\":[1,2]}' ELSE 'not json ' || o_orderkey END AS v FROM orders")
def b9_json_or_text(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{ "a": '), F.col("o_custkey").cast("string"), F.lit(' , "b": [1, 2] }'))).otherwise(F.concat(F.lit("not json "), F.col("o_orderkey").cast("string")))
    return o.select("o_orderkey", S.json_or_text(text).alias("v"))


_RAW = """r AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'id-' || l_orderkey || '-' || l_partkey || '-' || l_suppkey END AS id, 'W' || l_suppkey AS w, 'C' || l_partkey AS c, CAST(l_suppkey AS VARCHAR) AS a, CAST(CAST(l_discount AS DECIMAL(18, 2)) AS VARCHAR) AS p,
    CASE WHEN l_linenumber = 7 THEN 'many' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) END AS s, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS t FROM lineitem),
    n AS (SELECT *, sha256(concat('', chr(31), lower(w), chr(31), lower(c), chr(31), a, chr(31), t, chr(31), 'BUY', chr(31), p, chr(31), s)) AS fingerprint FROM r)"""


@query(f"WITH {_RAW} SELECT coalesce(id, fingerprint) AS trade_key, fingerprint, lower(w) AS proxy_wallet, 'BUY' AS side, l_linenumber = 7 AS is_malformed, CAST(round(CAST(p AS DECIMAL(18, 2)) * TRY_CAST(s AS DECIMAL(18, 2)), 6) * 1000000 AS BIGINT) AS notional_microusd FROM n")
def b10_b12_normalized_trades(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    name = F.concat_ws("-", F.lit("id"), "l_orderkey", "l_partkey", "l_suppkey")
    size = F.when(F.col("l_linenumber") == 7, "many").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    raw = i.select(
        F.when(F.col("l_linenumber") == 1, name).alias("tradeId"), F.concat(F.lit("W"), F.col("l_suppkey").cast("string")).alias("proxyWallet"), F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("conditionId"),
        F.col("l_suppkey").cast("string").alias("tokenId"), F.lit("buy").alias("side"), F.col("l_discount").cast("decimal(18,2)").cast("string").alias("price"), size.alias("size"), F.unix_timestamp("l_shipdate").cast("string").alias("timestamp"),
    )
    return ingest.normalize_trades(raw).select("trade_key", "fingerprint", "proxy_wallet", "side", "is_malformed", "notional_microusd")


_SLUG = "CASE p_size % 5 WHEN 0 THEN 'btc_updown_5m' WHEN 1 THEN 'eth-up-or-down-at-5m' ELSE lower(p_brand) END"


@query(f"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_size % 5 = 1 AND p_partkey % 2 = 0 THEN 'slug' WHEN p_size % 5 = 2 AND p_size * 20 BETWEEN 120 AND 600 THEN 'title_and_duration' END AS evidence FROM part""")
def b13_short_horizon(spark: SparkSession, d: str) -> DataFrame:
    """Slugs count as one text: a slug that ends in 5m counts only where a dash or the end of all follows."""
    k, size = F.col("p_partkey"), F.col("p_size")
    slug = F.when(size % 5 == 0, "btc_updown_5m").when(size % 5 == 1, "eth-up-or-down-at-5m").otherwise(F.lower("p_brand"))
    title = F.when(size % 5 == 2, F.lit("Will Bitcoin go")).otherwise(F.col("p_name"))
    after = F.when(k % 2 == 0, F.lit("-x")).otherwise(F.lit(""))
    found = S.short_horizon_evidence([F.concat(slug, after), F.lit("plain")], [title, F.when(size % 5 == 2, "UP or  down?")], F.lit(0), size * 20)
    return table(spark, d, "part").select("p_partkey", found.alias("evidence"))


@query("SELECT o_custkey, CAST(floor((v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2) AS BIGINT) AS m FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY 1)")
def b16_whole_median(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(S.middle(F.collect_list("o_orderkey")).alias("m"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE lower(p_type) END AS event, CASE WHEN p_size % 4 <> 0 THEN lower(p_type) WHEN p_size % 3 = 0 THEN 'finance' WHEN p_size % 2 = 0 THEN 'tech' END AS category FROM part""")
def b17_b18_market_category(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    events = F.when(size % 4 == 0, F.array().cast("array<struct<category:string>>")).otherwise(F.array(F.struct(F.col("p_type").alias("category"))))
    first = S.first_event(events)["category"]
    tags = F.when(size % 2 == 0, F.array(F.struct(F.lit("odd").alias("slug"), F.lit("Tech").alias("label")))).otherwise(F.array().cast("array<struct<slug:string,label:string>>"))
    found = S.market_category(first, F.when(size % 3 == 0, "Finance"), tags)
    return table(spark, d, "part").select("p_partkey", F.lower(first).alias("event"), found.alias("category"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'sports' WHEN o_orderpriority = '1-URGENT' THEN 'politics' WHEN o_orderpriority = '2-HIGH' THEN 'finance' WHEN o_orderpriority = '3-MEDIUM' THEN 'crypto' END AS category FROM orders")
def b19_canonical_category(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    raw = F.when(p == "1-URGENT", " Elections").when(p == "2-HIGH", "business").when(p == "3-MEDIUM", "CRYPTO").otherwise("gardening")
    return table(spark, d, "orders").select("o_orderkey", S.canonical_category(raw, F.col("o_custkey") % 7 == 0).alias("category"))


@query(f"WITH {EVENT_TRADES} SELECT trade_key, CASE WHEN condition_id > 0 THEN notional_microusd * 1000 // (condition_id * 100000) END AS ratio, CASE WHEN condition_id % 2 = 0 THEN 1706000000 - trade_ts END AS seconds, greatest(0, 1705000000 - trade_ts) * 1000 AS latency, list_filter(['median', 'end', 'cheap'], lambda x: (x = 'median' AND condition_id = 0) OR (x = 'end' AND condition_id % 2 = 1) OR (x = 'cheap' AND price_ppm < 10000))::VARCHAR AS missing FROM trades")
def b22_b23_b24_b52_trade_features(spark: SparkSession, d: str) -> DataFrame:
    k, ts = F.col("condition_id"), F.col("trade_ts")
    missing = S.missing_fields(median=k == 0, end=k % 2 == 1, cheap=F.col("price_ppm") < 10_000)
    return event_trades(spark, d).select(
        "trade_key", S.size_ratio_milli(F.col("notional_microusd"), k * 100_000).alias("ratio"), S.seconds_to_resolution(F.when(k % 2 == 0, 1_706_000_000), ts).alias("seconds"), S.latency_ms(F.lit(1_705_000_000), ts).cast("bigint").alias("latency"),
        F.concat(F.lit("["), F.array_join(missing, ", "), F.lit("]")).alias("missing"),
    )


@query("""SELECT c_custkey, 'window;raw_history_fetch_id:' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ';truncated' ELSE '' END AS reason, c_custkey AS fetch_id, 'window;history_fetch_id:' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ';truncated' ELSE '' END AS migrated FROM customer""")
def b25_b54_reason_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    reason = S.reasons(F.lit("window"), F.concat(F.lit("raw_history_fetch_id:"), k.cast("string")), F.when(k % 2 == 0, "truncated"))
    return table(spark, d, "customer").select("c_custkey", reason.alias("reason"), S.fetch_id(reason).alias("fetch_id"), F.replace(reason, F.lit("raw_history_fetch_id:"), F.lit("history_fetch_id:")).alias("migrated"))


@query("""SELECT a.vec_id, round(sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x))), 5) AS norm, CAST(greatest(-1000000, least(1000000, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) * 1000) * 1000)) AS BIGINT) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def b30_b31_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The cosine is rounded once, to thousandths: what is rounded to millionths before may end on the other side of a half."""
    e = table(spark, d, "embeddings")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    a, b = F.col("embedding"), F.col("next")
    norm = F.when(F.size(a) > 0, F.round(F.sqrt(S.dot(a, a)) * 100_000) / 100_000)
    cosine = F.greatest(F.least(F.round(S.cosine(a, b) * 1000) * 1000, F.lit(S.MILLION)), F.lit(-S.MILLION))
    return both.select("vec_id", norm.alias("norm"), cosine.cast("bigint").alias("cosine"))


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'not_closed' WHEN 1 THEN 'missing_outcomes' WHEN 2 THEN 'outcome_length_mismatch' WHEN 3 THEN 'duplicate_outcomes' WHEN 4 THEN 'ambiguous_outcome_prices' WHEN 5 THEN 'nonterminal_resolution' WHEN 6 THEN 'invalid_outcome_prices' ELSE 'terminal_outcome_prices' END AS quality,
    CASE WHEN p_size % 8 = 7 THEN p_partkey % 2 END AS winner, CASE WHEN p_size % 3 = 0 THEN true ELSE false END AS disputed, CASE WHEN p_size % 8 <> 1 THEN 2 END AS names FROM part""")
def b32_b33_b34_b35_resolution(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size") % 8
    names = F.when(size == 1, None).when(size == 3, F.lit('["Yes","YES"]')).otherwise(F.lit('["Yes","No"]'))
    prices = F.when(size == 2, '["1"]').when(size == 4, '["1","1"]').when(size == 6, '["one","0"]').when(k % 2 == 0, '["1","0"]').otherwise('["0","1"]')
    rows = table(spark, d, "part").select(
        "p_partkey", "p_size", k.cast("string").alias("condition_id"), (size != 0).alias("closed"), F.when(size == 5, "disputed").otherwise("resolved").alias("status"), names.alias("outcomes"), prices.alias("outcome_prices"), F.format_string('["%d","%d"]', k * 2, k * 2 + 1).alias("token_ids"),
    )
    flag = labels.dispute_flag(F.lit(None).cast("string"), F.when(F.col("p_size") % 3 == 0, " TRUE ").when(F.col("p_size") % 3 == 1, "false"), F.lit(0))
    found = labels.resolution_evidence(rows)
    return found.select("p_partkey", "quality", F.col("winner").cast("bigint").alias("winner"), flag.alias("disputed"), F.when(S.string_list(F.col("outcomes")).isNotNull(), F.size(S.string_list(F.col("outcomes")))).alias("names"))


@query(f"WITH {EVENT_TRADES} SELECT trade_key, condition_id % 2 = 1 AS won, CASE WHEN condition_id % 2 = 1 THEN 1000000 - price_ppm ELSE -price_ppm END AS gross, CASE WHEN price_ppm > 0 THEN 100000000::BIGINT * 1000000 // price_ppm END AS shares, round(CAST(condition_id % 2 = 1 AS INT) - price_ppm / 1000000.0, 9) AS edge, round(100 * condition_id / 100.0, 4) AS percent FROM trades")
def b35_b36_b37_b48_outcomes(spark: SparkSession, d: str) -> DataFrame:
    won = labels.outcome_won(F.col("condition_id") % 2, F.lit(1))
    return event_trades(spark, d).select("trade_key", won.alias("won"), S.gross_pnl(won, F.col("price_ppm")).alias("gross"), S.fill_shares(F.lit(100 * S.MILLION), F.col("price_ppm")).alias("shares"), F.round(S.edge(won, F.col("price_ppm")), 9).alias("edge"), S.percent(F.col("condition_id"), F.lit(100)).alias("percent"))


@query("SELECT o_orderkey, CAST(('0x' || substr(sha256('7:a:' || o_orderkey), 1, 16))::UBIGINT % 1000 AS BIGINT) AS h, round(ln(greatest(0.001, least(0.999, o_custkey / 1000.0)) / (1 - greatest(0.001, least(0.999, o_custkey / 1000.0)))), 9) AS logit, round(sign(o_custkey - 500) * ln(1 + abs(o_custkey - 500)), 9) AS log1p, CASE WHEN o_custkey % 2 = 0 THEN o_custkey / 4.0 END AS finite FROM orders")
def b46_b47_b51_numbers(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    odd = F.when(c % 2 == 0, c / 4).when(c % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return table(spark, d, "orders").select("o_orderkey", S.hash_number(S.joined_hash(":", F.lit("7"), F.lit("a"), k), 1000).alias("h"), F.round(S.logit(c / 1000), 9).alias("logit"), F.round(S.signed_log1p((c - 500).cast("double")), 9).alias("log1p"), S.finite(odd).alias("finite"))


@query(f"WITH {EVENT_TRADES} SELECT trade_key FROM trades WHERE side = 'BUY' AND notional_microusd >= 20000000 AND trade_ts BETWEEN 1704500000 AND 1705900000")
def c2_window(spark: SparkSession, d: str) -> DataFrame:
    return ingest.admit(event_trades(spark, d), 1_704_500_000, 1_705_900_000, 20 * S.MILLION).select("trade_key")
