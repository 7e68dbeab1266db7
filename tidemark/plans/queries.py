"""Queries that apply the library's operators to the sample tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.functions import scalars as S
from tidemark.operators import audit, dataset, enrich, ingest, labels, model, sampling
from tidemark.plans import reports
from tidemark.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from tidemark.plans.roles import EVENT_TRADES, LINE_TRADES, MARKETS, event_trades, line_trades, markets, table
from tidemark.sources import readers

#: A moment in the middle of the lines' dates.
CUTOFF = 852_076_800


@query(f"""WITH {EVENT_TRADES} SELECT trade_key, notional_microusd, price_ppm FROM trades WHERE side = 'BUY' AND notional_microusd >= 100000000""")
def c1_admit_filter(spark: SparkSession, d: str) -> DataFrame:
    return ingest.admit(event_trades(spark, d)).select("trade_key", "notional_microusd", "price_ppm")


@query(f"""WITH {LINE_TRADES}, {MARKETS} SELECT side, count(*) AS n, CAST(sum(notional_microusd) AS BIGINT) AS total FROM lines
    WHERE condition_id NOT IN (SELECT condition_id FROM markets WHERE size <= 5) GROUP BY side""")
def c3_exclusion_anti_join(spark: SparkSession, d: str) -> DataFrame:
    kept = ingest.without_excluded(line_trades(spark, d), markets(spark, d).where("size <= 5"), "condition_id")
    return kept.groupBy("side").agg(F.count("*").alias("n"), F.sum("notional_microusd").alias("total"))


@query(f"""WITH {LINE_TRADES} SELECT trade_key FROM lines WHERE notional_microusd >= 30000000000 OR
    CAST(('0x' || substr(sha256(trade_key), 1, 16)) AS UBIGINT) % 4 < 1""")
def c4_b15_enrichment_sample(spark: SparkSession, d: str) -> DataFrame:
    t = line_trades(spark, d)
    return t.where((F.col("notional_microusd") >= 30_000 * S.MILLION) | S.hash_sample(F.col("trade_key"))).select("trade_key")


@query(f"""WITH {LINE_TRADES}, {MARKETS}, r AS (SELECT CASE WHEN category NOT IN (SELECT min(p_type) FROM part) THEN NULL ELSE 'other_category' END AS a, quantity, price_ppm FROM lines JOIN markets USING (condition_id))
    SELECT coalesce(CASE WHEN a IS NOT NULL THEN a WHEN quantity < 5 THEN 'no_verified_resolution' WHEN price_ppm = 0 THEN 'not_enriched' END, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def c8_drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    other = table(spark, d, "part").agg(F.min("p_type").alias("other"))
    rows = line_trades(spark, d).join(markets(spark, d), "condition_id").join(F.broadcast(other), F.lit(True))
    reason = dataset.drop_reason(F.col("category") != F.col("other"), F.col("quantity") >= 5, F.col("price_ppm") > 0)
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN p_size <= 3 THEN 'excluded' WHEN p_type LIKE '%ANODIZED%' THEN 'category_not_targeted' WHEN trim(p_name) = '' THEN 'missing_title'
    WHEN p_partkey > 1900 THEN 'created_after_window' WHEN p_partkey < 50 THEN 'ended_before_window' ELSE 'eligible' END AS eligibility, count(*) AS n FROM part GROUP BY 1""")
def c9_eligibility(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    e = sampling.eligibility(F.col("p_size") <= 3, F.when(~F.col("p_type").contains("ANODIZED"), F.col("p_type")), F.col("p_name"), F.col("p_partkey"), F.col("p_partkey"), 50, 1900)
    return p.groupBy(e.alias("eligibility")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey FROM r WHERE n = 1""")
def e27_dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.first_wins(table(spark, d, "lineitem"), [["l_orderkey", "l_linenumber"]], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT count(*) AS snapshots FROM (SELECT DISTINCT o_custkey, sha256(o_orderstatus || chr(31) || o_orderpriority) AS h FROM orders)""")
def e28_snapshot_dedupe(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("h", S.fingerprint("o_orderstatus", "o_orderpriority"))
    return ingest.first_wins(o, [["o_custkey", "h"]], ["o_orderdate", "o_orderkey"]).agg(F.count("*").alias("snapshots"))


@query("""WITH o AS (SELECT o_custkey AS k, max(o_orderkey) AS v, 'P' AS s FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), n AS (SELECT o_custkey AS k, min(o_orderkey) AS v, NULL AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.v ELSE n.v END AS v, coalesce(n.s, o.s) AS s FROM o FULL JOIN n ON o.k = n.k""")
def e29_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    old = o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v")).withColumn("s", F.lit("P"))
    new = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v")).withColumn("s", F.lit(None).cast("string"))
    return ingest.upsert(old, new, ["k"], ["s"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE n = 1""")
def f4_latest_version(spark: SparkSession, d: str) -> DataFrame:
    return ingest.latest_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


_WALLET_SQL = f"""WITH {EVENT_TRADES}, z AS (SELECT max(trade_ts) AS hi FROM trades), w AS (SELECT t.*, hi FROM trades t, z),
    m AS (SELECT proxy_wallet, condition_id, sum(notional_microusd) AS v FROM trades GROUP BY 1, 2),
    mm AS (SELECT proxy_wallet, max(v) AS mv, count(*) AS distinct_market_count FROM m GROUP BY 1),
    q AS (SELECT proxy_wallet, list(notional_microusd ORDER BY notional_microusd) AS v FROM trades GROUP BY 1)
    SELECT w.proxy_wallet, count(*) AS observed_trade_count, any_value(distinct_market_count) AS distinct_market_count, count(DISTINCT asset_id) AS distinct_outcome_count,
           count(DISTINCT trade_ts // 86400) AS active_days, min(trade_ts) AS first_ts, max(trade_ts) AS last_ts, count(*) FILTER (side = 'BUY') AS buy_count, count(*) FILTER (side = 'SELL') AS sell_count,
           CAST(sum(notional_microusd) AS BIGINT) AS total, CAST(sum(notional_microusd) // count(*) AS BIGINT) AS mean, CAST(sum(price_ppm) // count(*) AS BIGINT) AS mean_price,
           count(*) FILTER (price_ppm <= 250000) AS cheap_trade_count, CAST(any_value(mv) * 1000000 // sum(notional_microusd) AS BIGINT) AS largest_market_share_ppm,
           any_value(hi) + 1 - max(trade_ts) AS seconds_since_last
    FROM w JOIN mm USING (proxy_wallet) GROUP BY w.proxy_wallet"""


def _with_end(t: DataFrame) -> tuple[DataFrame, int]:
    return t, t.agg(F.max("trade_ts")).first()[0] or 0


@query(_WALLET_SQL)
def e20_wallet_summary(spark: SparkSession, d: str) -> DataFrame:
    t, end = _with_end(event_trades(spark, d))
    names = "observed_trade_count distinct_market_count distinct_outcome_count active_days first_ts last_ts buy_count sell_count total mean mean_price cheap_trade_count largest_market_share_ppm seconds_since_last".split()
    return enrich.wallet_summary(t, 0, end).select("proxy_wallet", *names)


def _quantile_sql(q: float) -> str:
    i = f"((len(v) - 1) * {q}::DOUBLE)"
    return f"CAST(trunc(v[CAST(floor({i}) AS INTEGER) + 1] + (v[least(CAST(floor({i}) AS INTEGER) + 2, len(v))] - v[CAST(floor({i}) AS INTEGER) + 1]) * ({i} - floor({i}))) AS BIGINT) AS p{round(100 * q)}"


@query(f"""WITH {EVENT_TRADES}, q AS (SELECT proxy_wallet, list(notional_microusd ORDER BY notional_microusd) AS v, stddev_pop(notional_microusd) AS s FROM trades GROUP BY 1)
    SELECT proxy_wallet, {', '.join(_quantile_sql(q) for q in (0.25, 0.5, 0.75, 0.9))}, CAST(round_even(s, 0) AS BIGINT) AS stddev FROM q""")
def e20_wallet_quantiles(spark: SparkSession, d: str) -> DataFrame:
    t, end = _with_end(event_trades(spark, d))
    return enrich.wallet_summary(t, 0, end).select("proxy_wallet", "p25", "p50", "p75", "p90", "stddev")


@query(f"""WITH {EVENT_TRADES}, v AS (SELECT proxy_wallet, condition_id, CAST(sum(notional_microusd) AS BIGINT) AS volume FROM trades GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY proxy_wallet ORDER BY volume DESC, condition_id) AS place FROM v)
    SELECT proxy_wallet, condition_id, volume, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def g4_top_markets_per_wallet(spark: SparkSession, d: str) -> DataFrame:
    return enrich.top_markets(event_trades(spark, d)).drop("trades")


_HOUR = """SELECT trade_key, count(*) OVER w AS recent_count, CAST(coalesce(sum(notional_microusd) OVER w, 0) AS BIGINT) AS recent_notional FROM trades
    WINDOW w AS (PARTITION BY asset_id ORDER BY trade_ts RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING)"""


@query(f"WITH {EVENT_TRADES} {_HOUR}")
def f6_activity_last_hour(spark: SparkSession, d: str) -> DataFrame:
    return enrich.trailing_activity_by_time(event_trades(spark, d)).select("trade_key", "recent_count", "recent_notional")


@query(f"""WITH {EVENT_TRADES}, a AS (SELECT *, CASE WHEN trade_ts - lag(trade_ts) OVER (PARTITION BY proxy_wallet ORDER BY trade_ts, trade_key) <= 3600 THEN 0 ELSE 1 END AS fresh FROM trades),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY proxy_wallet ORDER BY trade_ts, trade_key ROWS UNBOUNDED PRECEDING) AS g FROM a)
    SELECT trade_key, first_value(trade_key) OVER (PARTITION BY proxy_wallet, g ORDER BY trade_ts, trade_key) AS burst_id, count(*) OVER (PARTITION BY proxy_wallet, g) AS burst_size FROM b""")
def f1_burst_sessions(spark: SparkSession, d: str) -> DataFrame:
    return enrich.bursts(event_trades(spark, d), 3600, ("proxy_wallet",)).select("trade_key", "burst_id", "burst_size")


def _prices(t: DataFrame) -> DataFrame:
    return t.select("asset_id", F.col("trade_ts").alias("t"), "price_ppm")


@query(f"""WITH {EVENT_TRADES}, w AS (SELECT trade_key, asset_id, h AS horizon_seconds, trade_ts + h AS target FROM trades, (VALUES (900), (3600), (86400)) x(h)),
    b AS (SELECT w.trade_key, horizon_seconds, min(p.trade_ts) AS observed_at, arg_min(p.price_ppm, (p.trade_ts, p.price_ppm)) AS entry_price_ppm FROM w JOIN trades p ON p.asset_id = w.asset_id AND p.trade_ts BETWEEN target AND target + 300 GROUP BY 1, 2)
    SELECT w.trade_key, CAST(w.horizon_seconds AS INTEGER) AS horizon_seconds, observed_at, entry_price_ppm FROM w LEFT JOIN b USING (trade_key, horizon_seconds)""")
def d8_forward_as_of(spark: SparkSession, d: str) -> DataFrame:
    t = event_trades(spark, d)
    return labels.forward_as_of(t, _prices(t)).select("trade_key", "horizon_seconds", "observed_at", "entry_price_ppm")


_LABELS = f"""{EVENT_TRADES}, t AS (SELECT *, trade_ts + 40000 AS resolved_at, condition_id % 2 = 0 AS won FROM trades),
    w AS (SELECT trade_key, asset_id, won, resolved_at, h AS horizon_seconds, trade_ts, trade_ts + h AS target FROM t, (VALUES (900), (3600), (86400)) x(h)),
    s AS (SELECT w.trade_key, horizon_seconds, arg_min(p.trade_ts, (p.trade_ts, p.price_ppm)) AS ts, arg_min(p.price_ppm, (p.trade_ts, p.price_ppm)) AS price FROM w JOIN trades p ON p.asset_id = w.asset_id AND p.side = 'BUY' AND p.trade_ts BETWEEN target AND target + 300 GROUP BY 1, 2),
    f AS (SELECT w.trade_key, horizon_seconds, arg_min(p.trade_ts, (p.trade_ts, p.price_ppm)) AS ts, arg_min(p.price_ppm, (p.trade_ts, p.price_ppm)) AS price FROM w JOIN trades p ON p.asset_id = w.asset_id AND p.side = 'SELL' AND p.trade_ts BETWEEN target AND target + 300 GROUP BY 1, 2),
    l AS (SELECT w.trade_key, CAST(w.horizon_seconds AS INTEGER) AS horizon_seconds, w.trade_ts, w.won, w.target AS scheduled_at, resolved_at <= target AS early, CASE WHEN NOT (resolved_at <= target) THEN coalesce(s.ts, f.ts) END AS observed_at,
          CASE WHEN NOT (resolved_at <= target) THEN coalesce(s.price, f.price) END AS entry_price_ppm,
          CASE WHEN resolved_at <= target THEN NULL WHEN s.ts IS NOT NULL THEN 'historical_price_history' WHEN f.ts IS NOT NULL THEN 'historical_trade_print' END AS price_source
          FROM w LEFT JOIN s USING (trade_key, horizon_seconds) LEFT JOIN f USING (trade_key, horizon_seconds)),
    labelled AS (SELECT *, CASE WHEN early THEN 'unavailable_before_horizon' WHEN entry_price_ppm IS NULL THEN 'price_unavailable' ELSE 'complete' END AS status,
          CASE WHEN won THEN 1000000 - entry_price_ppm ELSE -entry_price_ppm END AS gross_pnl FROM l)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    t = event_trades(spark, d).withColumns({"resolved_at": F.col("trade_ts") + 40_000, "won": F.col("condition_id") % 2 == 0})
    return labels.labelled(t, _prices(t.where("side = 'BUY'")), _prices(t.where("side = 'SELL'")))


@query(f"""WITH {_LABELS} SELECT trade_key, horizon_seconds, observed_at, entry_price_ppm, price_source, status, gross_pnl FROM labelled""")
def d9_b36_labels_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("trade_key", "horizon_seconds", "observed_at", "entry_price_ppm", "price_source", "status", "gross_pnl")


@query(f"""WITH {_LABELS} SELECT trade_key, max(CASE WHEN horizon_seconds = 900 THEN entry_price_ppm END) AS "900_price", max(CASE WHEN horizon_seconds = 900 THEN gross_pnl END) AS "900_pnl", max(CASE WHEN horizon_seconds = 900 THEN status END) AS "900_status",
    max(CASE WHEN horizon_seconds = 3600 THEN entry_price_ppm END) AS "3600_price", max(CASE WHEN horizon_seconds = 3600 THEN gross_pnl END) AS "3600_pnl", max(CASE WHEN horizon_seconds = 3600 THEN status END) AS "3600_status",
    max(CASE WHEN horizon_seconds = 86400 THEN entry_price_ppm END) AS "86400_price", max(CASE WHEN horizon_seconds = 86400 THEN gross_pnl END) AS "86400_pnl", max(CASE WHEN horizon_seconds = 86400 THEN status END) AS "86400_status" FROM labelled GROUP BY 1""")
def d15_label_pivot(spark: SparkSession, d: str) -> DataFrame:
    return labels.pivot_labels(_labelled(spark, d))


@query(f"""WITH {_LABELS} SELECT horizon_seconds, count(*) AS label_rows, count(*) FILTER (status = 'complete') AS complete_rows, count(*) FILTER (status = 'price_unavailable') AS price_unavailable_rows,
    count(*) FILTER (status = 'unavailable_before_horizon') AS unavailable_before_horizon_rows, 0::BIGINT AS other_status_rows, 0::BIGINT AS incomplete_rows,
    count(*) FILTER (scheduled_at <> trade_ts + horizon_seconds) AS scheduled_mismatches, count(*) FILTER (status = 'complete' AND observed_at NOT BETWEEN scheduled_at AND scheduled_at + 300) AS observed_mismatches,
    count(*) FILTER (status = 'complete' AND entry_price_ppm NOT BETWEEN 0 AND 1000000) AS invalid_prices, 0::BIGINT AS winner_mismatches, 0::BIGINT AS pnl_mismatches FROM labelled GROUP BY 1""")
def e13_label_integrity(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).withColumn("outcome_won", F.col("won")).join(event_trades(spark, d).select("trade_key", "trade_ts"), "trade_key")
    return audit.label_integrity(rows)


_SCORES = f"""{LINE_TRADES}, {MARKETS}, m AS (SELECT proxy_wallet, count(*) AS trades_of_wallet, min(trade_ts) AS first_ts FROM lines GROUP BY 1),
    x AS (SELECT trade_key, quantity, notional_microusd AS n, price_ppm AS p, trade_ts - first_ts AS age, trades_of_wallet AS prior, notional_microusd * 1000 // 20000000000 AS ratio, size * 86400 AS remaining,
          CASE WHEN category LIKE '%BRASS%' THEN 'high' WHEN category LIKE '%STEEL%' THEN 'medium' ELSE 'low' END AS prior_category, l_linenumber AS young, category
          FROM lines JOIN markets USING (condition_id) JOIN m USING (proxy_wallet)),
    scores AS (SELECT *, CASE WHEN age < 604800 THEN 3 WHEN age < 2592000 THEN 2 ELSE 0 END + CASE WHEN prior <= 5 THEN 2 WHEN prior <= 20 THEN 1 ELSE 0 END + CASE WHEN n >= 5000000000 THEN 2 WHEN n >= 1000000000 THEN 1 ELSE 0 END
          + CASE WHEN ratio >= 10000 THEN 2 WHEN ratio >= 3000 THEN 1 ELSE 0 END + CASE WHEN p <= 250000 THEN 1 ELSE 0 END + CASE WHEN remaining BETWEEN 0 AND 604800 THEN 2 WHEN remaining BETWEEN 0 AND 2592000 THEN 1 ELSE 0 END
          + CASE prior_category WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END + CASE WHEN young >= 3 THEN 2 ELSE 0 END AS score FROM x)"""
_BUCKET = "CASE WHEN score >= 8 THEN 'high' WHEN score >= 5 THEN 'medium' ELSE 'low' END"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    t = line_trades(spark, d)
    wallets = t.groupBy("proxy_wallet").agg(F.count("*").alias("prior"), F.min("trade_ts").alias("first_ts"))
    rows = t.join(markets(spark, d), "condition_id").join(wallets, "proxy_wallet")
    kind = F.when(F.col("category").contains("BRASS"), "high").when(F.col("category").contains("STEEL"), "medium").otherwise("low")
    return enrich.scored(
        rows, age=F.col("trade_ts") - F.col("first_ts"), prior_trades=F.col("prior"), window_complete=F.lit(True), notional_=F.col("notional_microusd"), ratio=S.size_ratio_milli(F.col("notional_microusd"), F.lit(20_000 * S.MILLION)),
        price=F.col("price_ppm"), remaining=F.col("size") * S.DAY, prior=kind, young=F.col("l_linenumber"),
    )


@query(f"""WITH {_SCORES} SELECT trade_key, score, {_BUCKET} AS bucket, quantity FROM scores""")
def b21_heuristic_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("trade_key", "score", "bucket", "quantity")


@query(f"""WITH {_SCORES} SELECT {_BUCKET} AS bucket, count(*) AS trades, round(avg(score), 2) AS mean_score, min(score) AS least FROM scores GROUP BY 1""")
def e2_score_buckets(spark: SparkSession, d: str) -> DataFrame:
    return reports.bucket_report(_scores(spark, d).withColumn("score_version", F.lit(1)))


@query(f"""WITH {LINE_TRADES}, {MARKETS} SELECT category, count(*) AS trades, count(DISTINCT proxy_wallet) AS wallets, count(DISTINCT condition_id) AS markets, count(DISTINCT event_id) AS events,
    count(*) FILTER (quantity >= 25) AS large, count(DISTINCT CASE WHEN side = 'SELL' THEN condition_id END) AS sold_markets, round(avg(price_ppm) / 1000000.0, 6) AS mean_price FROM lines JOIN markets USING (condition_id) GROUP BY 1""")
def e5_e16_category_funnel(spark: SparkSession, d: str) -> DataFrame:
    rows = line_trades(spark, d).join(markets(spark, d), "condition_id")
    return rows.groupBy("category").agg(
        F.count("*").alias("trades"), F.count_distinct("proxy_wallet").alias("wallets"), F.count_distinct("condition_id").alias("markets"), F.count_distinct("event_id").alias("events"), F.count_if(F.col("quantity") >= 25).alias("large"),
        F.count_distinct(F.when(F.col("side") == "SELL", F.col("condition_id"))).alias("sold_markets"), F.round(F.avg("price_ppm") / 1_000_000, 6).alias("mean_price"),
    )


@query("""SELECT coalesce(p_type, 'unknown') AS category, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 20""")
def e3_category_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.category_counts(table(spark, d, "part"), "p_type")


@query(f"""WITH {EVENT_TRADES} SELECT CASE WHEN price_ppm < 100000 THEN '00-10%' WHEN price_ppm < 250000 THEN '10-25%' WHEN price_ppm < 500000 THEN '25-50%' WHEN price_ppm < 750000 THEN '50-75%' WHEN price_ppm < 900000 THEN '75-90%' ELSE '90-100%' END AS price_band,
    count(*) AS trades, min(price_ppm) AS least FROM trades GROUP BY 1""")
def e18_b49_price_bands(spark: SparkSession, d: str) -> DataFrame:
    return reports.band_histogram(event_trades(spark, d))


def _top_sql(key: str, other: str) -> str:
    return f"""WITH {LINE_TRADES} SELECT {key}, count(*) AS trades, count(DISTINCT {other}) AS others, round(100 * count(*) / (SELECT count(*) FROM lines), 4) AS share FROM lines GROUP BY 1 ORDER BY trades DESC, {key} LIMIT 20"""


@query(_top_sql("condition_id", "proxy_wallet"))
def g3_top_markets(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_by_trades(line_trades(spark, d), "condition_id", "proxy_wallet")


@query(_top_sql("proxy_wallet", "condition_id"))
def g3_top_wallets(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_by_trades(line_trades(spark, d), "proxy_wallet", "condition_id")


@query("""SELECT lang, toxic, count(*) AS trades, count(DISTINCT source) AS items FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def e17_class_balance(spark: SparkSession, d: str) -> DataFrame:
    return reports.class_balance(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), ["lang"], "toxic", "source")


_SPANS = f"{LINE_TRADES}, spans AS (SELECT condition_id, min(trade_ts) AS first_trade_ts, max(trade_ts) AS resolved_at FROM lines GROUP BY 1)"
_SPLIT = f"""{_SPANS}, split AS (SELECT *, CASE WHEN first_trade_ts >= {CUTOFF} THEN 'test' WHEN resolved_at < {CUTOFF} THEN 'train' WHEN CAST('0x' || substr(sha256('7:overlap:' || condition_id), 1, 16) AS UBIGINT) % 2 = 0 THEN 'train' ELSE 'test' END AS split,
    CASE WHEN first_trade_ts >= {CUTOFF} THEN 'after_cutoff' WHEN resolved_at < {CUTOFF} THEN 'before_cutoff' ELSE 'overlap_random' END AS split_basis FROM spans)"""


def _split(spark: SparkSession, d: str) -> DataFrame:
    spans = dataset.market_spans(line_trades(spark, d).withColumn("resolved_at", F.col("trade_ts")))
    return dataset.time_split(spans, CUTOFF, 7)


@query(f"""WITH {_SPLIT} SELECT * FROM split""")
def f3_e26_time_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)


@query(f"""WITH {_SPLIT}, o AS (SELECT condition_id, CAST((row_number() OVER (ORDER BY substr(sha256('7:fold:' || condition_id), 1, 16), condition_id) - 1) % 5 AS INTEGER) AS cv_fold FROM split WHERE split = 'train')
    SELECT condition_id, split, cv_fold FROM split LEFT JOIN o USING (condition_id)""")
def f2_cv_folds(spark: SparkSession, d: str) -> DataFrame:
    return dataset.folds(_split(spark, d), 7).select("condition_id", "split", "cv_fold")


@query(f"""WITH {_SPLIT}, {MARKETS} SELECT split, category, count(DISTINCT condition_id) AS markets, count(*) AS trades, round(avg(price_ppm), 4) AS mean_price, round(avg(CASE WHEN split = 'train' THEN CAST(quantity > 25 AS INTEGER) END), 6) AS win_rate
    FROM lines JOIN split USING (condition_id) JOIN markets USING (condition_id) GROUP BY 1, 2""")
def e21_split_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = line_trades(spark, d).withColumn("outcome_won", F.col("quantity") > 25).join(_split(spark, d), "condition_id").join(markets(spark, d), "condition_id")
    return dataset.split_summary(rows, "category")


@query(f"""WITH {LINE_TRADES} SELECT trade_key, quantity, round(1.0 / count(*) OVER (PARTITION BY condition_id), 9) AS market_weight, CASE WHEN notional_microusd >= 500000000 THEN 1.0::DOUBLE ELSE 4.0::DOUBLE END AS sample_weight FROM lines""")
def e24_b44_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = dataset.market_weight(line_trades(spark, d))
    return rows.select("trade_key", "quantity", F.round("market_weight", 9).alias("market_weight"), S.sample_weight(F.col("notional_microusd")).alias("sample_weight"))


@query(f"""WITH {EVENT_TRADES}, s AS (SELECT t.*, p_size::BIGINT * 86400 * 40 AS start_ts, CASE WHEN p_size > 25 THEN p_size::BIGINT * 86400 * 500 END AS end_ts FROM trades t LEFT JOIN part ON p_partkey = condition_id)
    SELECT trade_key, strftime(to_timestamp(trade_ts) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS trade_time_utc, CAST(trade_ts // 3600 % 24 AS INTEGER) AS hour_utc, CAST((trade_ts // 86400 + 3) % 7 AS INTEGER) AS day_of_week,
    round((trade_ts - start_ts) / 86400.0, 6) AS days_since_market_start, round((end_ts - trade_ts) / 3600.0, 6) AS hours_to_scheduled_end, CASE WHEN end_ts > start_ts THEN round((trade_ts - start_ts)::DOUBLE / (end_ts - start_ts), 6) END AS fraction_of_market_life_elapsed,
    CAST(end_ts IS NULL AS INTEGER) AS missing_hours_to_scheduled_end FROM s""")
def b39_b43_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("condition_id"), (F.col("p_size").cast("long") * S.DAY * 40).alias("start_ts"), F.when(F.col("p_size") > 25, F.col("p_size").cast("long") * S.DAY * 500).alias("end_ts"))
    rows = dataset.with_missing_flags(dataset.lifecycle(event_trades(spark, d).join(p, "condition_id", "left"), 0), ["hours_to_scheduled_end"])
    return rows.select("trade_key", "trade_time_utc", "hour_utc", "day_of_week", *[F.round(c, 6).alias(c) for c in ("days_since_market_start", "hours_to_scheduled_end", "fraction_of_market_life_elapsed")], "missing_hours_to_scheduled_end")


_RANK = "sha256('7:' || p_type || ':' || p_partkey)"


@query(f"""SELECT p_partkey, {_RANK} AS random_rank, {_RANK} < '{-(-300_000 * (1 << 256) // 1_000_000):064x}' AS is_admitted FROM part""")
def b28_b29_admission_rank(spark: SparkSession, d: str) -> DataFrame:
    return sampling.ranked(table(spark, d, "part"), 7, 0.3, "p_type", "p_partkey").select("p_partkey", "random_rank", "is_admitted")


@query(f"""WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY {_RANK}, p_partkey) AS place FROM part) SELECT p_partkey, p_type, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""")
def f8_quota_per_category(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.ranked(table(spark, d, "part"), 7, 0.3, "p_type", "p_partkey")
    return sampling.top_by_rank(rows, "p_type", 10, ["random_rank", "p_partkey"]).select("p_partkey", "p_type", "place")


@query()
def m2_semantic_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("category"), "embedding")
    rows = sampling.ranked(e, 7, 0.5, "category", "vec_id").withColumnRenamed("is_admitted", "admitted")
    return sampling.greedy_distinct(rows, "category", "vec_id", "embedding", [], 0.3, 40)


@query("""SELECT p_partkey, lower(regexp_replace(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')), '^$', '')) AS title, sha256(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS text_hash,
    CASE WHEN lower(p_name) LIKE '%award%' OR lower(p_name) LIKE '%appointment%' OR lower(p_name) LIKE '%court%' OR lower(p_name) LIKE '%geopolitics%' OR lower(p_name) LIKE '%mention%' OR lower(p_name) LIKE '%tech%' OR lower(p_name) LIKE '%company%' OR lower(p_name) LIKE '%business%' THEN 'high'
         WHEN lower(p_name) LIKE '%politic%' OR lower(p_name) LIKE '%fed%' OR lower(p_name) LIKE '%central-bank%' OR lower(p_name) LIKE '%central bank%' THEN 'medium' ELSE 'low' END AS prior FROM part""")
def b26_b27_b14_titles(spark: SparkSession, d: str) -> DataFrame:
    title = S.normal_title(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", title.alias("title"), F.sha2(title, 256).alias("text_hash"), S.category_prior(F.col("p_name")).alias("prior"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)), 6) * 1000000 AS BIGINT) AS notional, CAST(round(CAST(l_discount AS DECIMAL(18,2)) * 1000000) AS BIGINT) AS price_ppm,
    sha256(concat(l_orderkey, chr(31), l_linenumber, chr(31), l_returnflag, chr(31), '')) AS print FROM lineitem""")
def b5_b7_b11_fixed_point(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    price, size = F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_discount").cast("decimal(18,2)").cast("string")
    return i.select("l_orderkey", "l_linenumber", "l_partkey", S.notional(price, size).alias("notional"), S.millionths(size).alias("price_ppm"), S.fingerprint("l_orderkey", "l_linenumber", "l_returnflag", F.lit(None)).alias("print"))


_BOOK = """b AS (SELECT l_partkey, list({'price': price, 'size': size} ORDER BY price) AS asks FROM (SELECT l_partkey, CAST(round(l_discount * 1000000) AS BIGINT) + 10000 AS price, CAST(sum(l_quantity) AS BIGINT) * 20000000 AS size FROM lineitem GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {_BOOK} SELECT l_partkey, asks[1].price AS best_ask, CAST(list_sum(list_transform(list_filter(asks, lambda a: a.price <= asks[1].price + 10000), lambda a: a.size)) AS BIGINT) AS depth_1c,
    CAST(list_sum(list_transform(list_filter(asks, lambda a: a.price <= asks[1].price + 50000), lambda a: a.size)) AS BIGINT) AS depth_5c FROM b""")
def f11_f12_book_depth(spark: SparkSession, d: str) -> DataFrame:
    b = _books(spark, d)
    return b.select("l_partkey", book.best_ask(F.col("asks")).alias("best_ask"), book.depth_within(F.col("asks"), 10_000).alias("depth_1c"), book.depth_within(F.col("asks"), 50_000).alias("depth_5c"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    levels = table(spark, d, "lineitem").groupBy("l_partkey", (F.round(F.col("l_discount") * S.MILLION).cast("bigint") + 10_000).alias("price")).agg((F.sum("l_quantity").cast("bigint") * 20_000_000).alias("size"))
    return levels.groupBy("l_partkey").agg(F.collect_list(F.struct("price", "size")).alias("asks"))


@query(f"""WITH RECURSIVE {_BOOK}, s AS (
    SELECT l_partkey, asks, 1 AS k, 20000000000::BIGINT AS rest, 0::BIGINT AS cost, 0::BIGINT AS shares FROM b
    UNION ALL
    SELECT l_partkey, asks, k + 1, rest - CASE WHEN rest <= 1 THEN 0 ELSE tc END, cost + CASE WHEN rest <= 1 THEN 0 ELSE tc END, shares + CASE WHEN rest <= 1 THEN 0 ELSE ts END FROM (
        SELECT *, CASE WHEN lc <= rest THEN lc ELSE CAST(p::HUGEINT * (rest::HUGEINT * 1000000 // p) // 1000000 AS BIGINT) END AS tc, CASE WHEN lc <= rest THEN z ELSE CAST(rest::HUGEINT * 1000000 // p AS BIGINT) END AS ts FROM (
            SELECT *, asks[k].price AS p, asks[k].size AS z, CAST(asks[k].price::HUGEINT * asks[k].size // 1000000 AS BIGINT) AS lc FROM s WHERE k <= len(asks))))
    SELECT l_partkey, CASE WHEN rest <= 1 AND shares > 0 THEN CAST(cost::HUGEINT * 1000000 // shares AS BIGINT) END AS fill FROM s WHERE k = len(asks) + 1""")
def f10_book_fill(spark: SparkSession, d: str) -> DataFrame:
    return _books(spark, d).select("l_partkey", book.average_fill(book.sorted_asks(F.col("asks")), 20_000 * S.MILLION).alias("fill"))


_PREDICTED = """p AS (SELECT l_partkey, l_discount * 8 + 0.1 AS p, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label, 1.0::DOUBLE AS market_weight, l_partkey % 5 AS cv_fold, p_type AS category FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    i, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return i.join(p, i.l_partkey == p.p_partkey).select("l_partkey", (F.col("l_discount") * 8 + 0.1).alias("p"), (F.col("l_quantity") > 25).cast("int").alias("label"), F.lit(1.0).alias("market_weight"), (F.col("l_partkey") % 5).alias("cv_fold"), F.col("p_type").alias("category"))


@query(f"""WITH {_PREDICTED} SELECT cv_fold, category, count(*) AS n, round(sum(-(label * ln(p) + (1 - label) * ln(1 - p)) * market_weight) / sum(market_weight), 8) AS log_loss, round(sum((p - label) * (p - label) * market_weight) / sum(market_weight), 8) AS brier FROM p GROUP BY 1, 2""")
def e32_e35_metrics(spark: SparkSession, d: str) -> DataFrame:
    return model.metrics(_predicted(spark, d), ["cv_fold", "category"], "market_weight").withColumns({"log_loss": F.round("log_loss", 8), "brier": F.round("brier", 8)})


@query(f"""WITH {_PREDICTED}, t AS (SELECT p, sum(label * market_weight) AS a, sum((1 - label) * market_weight) AS b FROM p GROUP BY 1), r AS (SELECT *, coalesce(sum(b) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t)
    SELECT round(sum(a * (below + b / 2)) / (sum(a) * sum(b)), 10) AS auc FROM r""")
def e32_auc(spark: SparkSession, d: str) -> DataFrame:
    return model.auc(_predicted(spark, d), w="market_weight").select(F.round("auc", 10).alias("auc"))


@query(f"""WITH {_PREDICTED}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM p), q AS (SELECT p.*, CAST(len(list_filter(edges, lambda x: x <= p.p)) AS INTEGER) AS bin FROM p, e)
    SELECT bin, count(*) AS n, round(avg(p), 8) AS mean_p, round(avg(label), 8) AS mean_label FROM q GROUP BY 1""")
def e34_calibration(spark: SparkSession, d: str) -> DataFrame:
    return model.calibration(_predicted(spark, d), w="market_weight").select("bin", "n", F.round("mean_p", 8).alias("mean_p"), F.round("mean_label", 8).alias("mean_label"))


@query(f"""WITH {_PREDICTED}, m AS (SELECT category, cv_fold, avg((p - label) * (p - label)) AS b FROM p GROUP BY 1, 2) SELECT category, round(avg(b), 8) AS mean, round(stddev_samp(b) / sqrt(count(*)), 8) AS se FROM m GROUP BY 1""")
def e33_fold_mean_and_se(spark: SparkSession, d: str) -> DataFrame:
    found = model.mean_and_se(model.metrics(_predicted(spark, d), ["category", "cv_fold"], "market_weight"), ["category"], "brier")
    return found.select("category", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"))


@query()
def e36_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    low, mean, high = (lambda r: (r[1], r[0], r[2]))(model.cluster_bootstrap(_predicted(spark, d), F.col("label") - F.col("p"), "l_partkey", F.lit(1.0)))
    return spark.sql(f"SELECT {mean!r}D AS mean, {low!r}D AS low, {high!r}D AS high")


@query()
def m9_logistic_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    t = event_trades(spark, d).withColumns({"label": (F.col("condition_id") % 3 == 0).cast("int"), "price": F.col("price_ppm") / S.MILLION, "category": F.col("asset_id"), "cv_fold": F.col("condition_id") % 3, "market_weight": F.lit(1.0), "sample_weight": S.sample_weight(F.col("notional_microusd")), "size": F.col("notional_microusd") / S.MILLION})
    found = model.out_of_fold(t, model.Candidate("full", "sample_x_market", 1.0), model.Inputs((), ("size",), ()), model.categories_of(t), 3)
    return model.metrics(found, ["cv_fold"], "market_weight").withColumns({"log_loss": F.round("log_loss", 4), "brier": F.round("brier", 4)})


@query("""SELECT 'negative_price' AS rule, count(*) FILTER (NOT l_extendedprice >= 0) AS n FROM lineitem UNION ALL SELECT 'discount_range', count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.05)) FROM lineitem UNION ALL
    SELECT 'quantity', count(*) FILTER (NOT l_quantity > 1) FROM lineitem""")
def m_constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    return audit.violations(table(spark, d, "lineitem"), negative_price=F.col("l_extendedprice") >= 0, discount_range=F.col("l_discount").between(0, 0.05), quantity=F.col("l_quantity") > 1)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, count(*) OVER (PARTITION BY o_custkey) > 5 AS is_truncated FROM orders)
    SELECT o_custkey, o_orderkey, is_truncated FROM r WHERE n <= 5""")
def a4_truncated_history(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("trade_ts"), F.col("o_orderkey").alias("trade_key"))
    return readers.truncated_history(o, 5, "o_custkey").select("o_custkey", "o_orderkey", "is_truncated")


@query("""SELECT o_orderkey, coalesce(c.c_name, 'none') AS name FROM orders LEFT JOIN (SELECT DISTINCT ON (c_custkey) c_custkey, c_name FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey""")
def a7_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"))
    open_, closed = c.where("name is not null"), c.where("name is null").withColumn("name", F.lit("none"))
    found = readers.looked_up(table(spark, d, "orders").select("o_orderkey", "o_custkey"), open_, closed, "o_custkey", ["name"])
    return found.select("o_orderkey", F.coalesce("name", F.lit("none")).alias("name"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return e5_e16_category_funnel(spark, d)


from tidemark.plans import cohort_queries, scalar_queries  # noqa: E402, F401  (they register their queries)
