"""Queries on a cohort's tables: joins of its scope, reports, exports, the work that is left, labels, training sets and the audit."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.functions import scalars as S
from tidemark.operators import audit, cohorts, dataset, enrich, ingest, labels, model, sampling
from tidemark.plans import reports
from tidemark.plans.cohort_roles import role, with_roles
from tidemark.plans.registry import query
from tidemark.plans.roles import EVENT_TRADES, event_trades, table
from tidemark.scratch import shared_folder
from tidemark.sources import readers
from tidemark.streaming import live

SCOPE = """scoped AS (SELECT f.*, m.canonical_category, m.event_id, m.event_slug, m.title, m.random_rank FROM fills f JOIN cohort_markets m ON m.condition_id = f.condition_id
    JOIN cohorts c ON c.cohort_name = m.cohort_name AND f.trade_ts BETWEEN c.window_start AND c.window_end WHERE m.cohort_name = 'main' AND m.selection_status = 'selected')"""


def tables(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [role(spark, d, n) for n in names]


def scoped(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.scope(*tables(spark, d, "cohorts", "cohort_markets", "fills"), "main")


def sql(select: str, *names: str, more: str = SCOPE) -> str:
    return f"{with_roles('cohorts', 'cohort_markets', 'fills', *names)}, {more} {select}"


# Joins


@query(f"""{with_roles('fills', 'markets', 'outcomes', 'features', 'wallets', 'scores', 'books')},
    lf AS (SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY trade_key ORDER BY feature_version DESC) = 1), ls AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY trade_key ORDER BY score_version DESC) = 1)
    SELECT t.trade_key, t.notional_microusd, m.title, m.category, o.outcome_name, w.completeness, lf.size_vs_median_milli, ls.score, ls.bucket, b.best_ask_ppm, b.status AS book_status FROM fills t JOIN markets m USING (condition_id)
    JOIN outcomes o ON o.asset_id = t.asset_id JOIN lf ON lf.trade_key = t.trade_key JOIN wallets w ON w.wallet_snapshot_id = lf.wallet_snapshot_id LEFT JOIN ls ON ls.trade_key = t.trade_key
    LEFT JOIN books b ON b.trade_key = t.trade_key AND b.kind = 'post_detection'""")
def d1_feature_view(spark: SparkSession, d: str) -> DataFrame:
    view = reports.feature_view(*tables(spark, d, "fills", "markets", "outcomes", "features", "wallets", "scores", "books"))
    return view.select("trade_key", "notional_microusd", "title", "category", "outcome_name", "completeness", "size_vs_median_milli", "score", "bucket", "best_ask_ppm", F.col("status").alias("book_status"))


@query(sql("""SELECT s.trade_key, s.canonical_category, m.event_slug, m.start_ts, o.outcome_name, r.resolved_at, r.terminal, f.trade_key IS NOT NULL AS has_features, f.size_vs_median_milli, w.missing_reason AS wallet_reason, x.score
    FROM scoped s JOIN markets m ON m.condition_id = s.condition_id JOIN outcomes o ON o.asset_id = s.asset_id LEFT JOIN resolutions r ON r.condition_id = s.condition_id AND r.source = 'authority'
    LEFT JOIN features f ON f.trade_key = s.trade_key AND f.feature_version = 2 LEFT JOIN wallets w ON w.wallet_snapshot_id = f.wallet_snapshot_id LEFT JOIN scores x ON x.trade_key = s.trade_key AND x.score_version = 2""",
    "markets", "outcomes", "resolutions", "features", "wallets", "scores"))
def d3_dataset_base(spark: SparkSession, d: str) -> DataFrame:
    rows = dataset.base(*tables(spark, d, "cohorts", "cohort_markets", "fills", "markets", "outcomes", "resolutions", "features", "wallets", "scores"), "main", 2, 2)
    return rows.select("trade_key", "canonical_category", "event_slug", "start_ts", "outcome_name", "resolved_at", "terminal", "has_features", "size_vs_median_milli", "wallet_reason", "score")


@query(sql("SELECT trade_key, canonical_category, trade_ts FROM scoped WHERE canonical_category IN ('ECONOMY', 'SMALL')"))
def d4_c6_c7_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = cohorts.scope(*tables(spark, d, "cohorts", "cohort_markets", "fills"), "main", ["ECONOMY", "SMALL"])
    return rows.select("trade_key", "canonical_category", "trade_ts")


_EVENT = "coalesce(nullif(event_id, ''), nullif(event_slug, ''), CAST(condition_id AS VARCHAR))"


@query(sql(f"""SELECT count(*) AS trades, count(DISTINCT proxy_wallet) AS wallets, count(DISTINCT condition_id) AS markets, count(DISTINCT {_EVENT}) AS events, min(trade_ts) AS first_trade_ts, max(trade_ts) AS last_trade_ts,
    count(*) FILTER (enrichment_status = 'complete') AS complete, count(*) FILTER (enrichment_status = 'pending') AS pending, count(*) FILTER (enrichment_status = 'failed') AS failed, count(*) FILTER (enrichment_status = 'not_selected') AS not_selected FROM scoped"""))
def e11_e19_population(spark: SparkSession, d: str) -> DataFrame:
    return audit.population(scoped(spark, d))


_LABEL_AUDIT = """w AS (SELECT s.trade_key, s.trade_ts, o.outcome_index = r.winner AS won, CAST(h.h AS INT) AS horizon_seconds FROM scoped s LEFT JOIN outcomes o ON o.asset_id = s.asset_id
    LEFT JOIN resolutions r ON r.condition_id = s.condition_id AND r.source = 'authority' CROSS JOIN (VALUES (900), (3600), (86400)) h(h)),
    j AS (SELECT w.*, l.status, l.scheduled_at, l.observed_at, l.entry_price_ppm AS price, l.outcome_won, l.gross_pnl FROM w LEFT JOIN labels_ l USING (trade_key, horizon_seconds)),
    la AS (SELECT horizon_seconds, count(status) AS label_rows, count(*) FILTER (status = 'complete') AS complete_rows, count(*) FILTER (status = 'price_unavailable') AS price_unavailable_rows,
    count(*) FILTER (status = 'unavailable_before_horizon') AS unavailable_before_horizon_rows, count(*) FILTER (status NOT IN ('complete', 'price_unavailable', 'unavailable_before_horizon')) AS other_status_rows,
    count(*) FILTER (status = 'complete' AND (price IS NULL OR outcome_won IS NULL OR gross_pnl IS NULL)) AS incomplete_rows, count(*) FILTER (scheduled_at <> trade_ts + horizon_seconds) AS scheduled_mismatches,
    count(*) FILTER (status = 'complete' AND (observed_at < scheduled_at OR observed_at > scheduled_at + 300)) AS observed_mismatches, count(*) FILTER (status = 'complete' AND (price < 0 OR price > 1000000)) AS invalid_prices,
    count(*) FILTER (status = 'complete' AND outcome_won <> CASE WHEN won THEN 1 ELSE 0 END) AS winner_mismatches, count(*) FILTER (status = 'complete' AND gross_pnl <> CASE WHEN outcome_won = 1 THEN 1000000 - price ELSE -price END) AS pnl_mismatches,
    count(*) AS expected, count(*) - count(status) AS missing_rows, round(100 * count(status) / count(*), 4) AS coverage_percent, round(100 * count(*) FILTER (status = 'complete') / count(*), 4) AS trainable_percent FROM j GROUP BY 1)"""


@query(sql("SELECT * FROM la", "labels_", "outcomes", "resolutions", more=f"{SCOPE}, {_LABEL_AUDIT}"))
def d5_e13_label_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.label_audit(scoped(spark, d), *tables(spark, d, "labels_", "outcomes", "resolutions"))


@query(sql("""SELECT count(v.trade_key) AS feature_rows, count(*) FILTER (completeness = 'complete') AS complete_wallet_rows, count(*) FILTER (completeness = 'partial') AS partial_wallet_rows, count(*) FILTER (completeness = 'unavailable') AS unavailable_wallet_rows,
    count(*) FILTER (missing_reason ILIKE '%truncated%') AS truncated_wallet_rows, count(*) FILTER (size_vs_median_milli IS NULL) AS missing_size_ratio_rows, count(*) FILTER (seconds_to_resolution IS NULL) AS missing_resolution_time_rows
    FROM scoped s LEFT JOIN (SELECT f.*, w.completeness, w.missing_reason FROM features f JOIN wallets w USING (wallet_snapshot_id) QUALIFY row_number() OVER (PARTITION BY trade_key ORDER BY feature_version DESC) = 1) v ON v.trade_key = s.trade_key""", "features", "wallets"))
def d6_e15_c13_feature_coverage(spark: SparkSession, d: str) -> DataFrame:
    view = reports.feature_view(*tables(spark, d, "fills", "markets", "outcomes", "features", "wallets", "scores", "books"))
    return audit.feature_coverage(scoped(spark, d), view)


@query(f"""WITH {EVENT_TRADES}, a AS (SELECT proxy_wallet, trade_ts, any_value(trade_ts - lo) AS age FROM trades JOIN (SELECT proxy_wallet, min(trade_ts) AS lo FROM trades GROUP BY 1) USING (proxy_wallet) GROUP BY 1, 2),
    t AS (SELECT * FROM trades JOIN a USING (proxy_wallet, trade_ts))
    SELECT trade_key, count(*) OVER w AS recent_count, CAST(coalesce(sum(notional_microusd) OVER w, 0) AS BIGINT) AS recent_notional, CAST(coalesce(sum(CASE WHEN age < 604800 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS young_count
    FROM t WINDOW w AS (PARTITION BY asset_id ORDER BY trade_ts RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING)""")
def d7_young_wallets_last_hour(spark: SparkSession, d: str) -> DataFrame:
    t = event_trades(spark, d)
    first = t.groupBy("proxy_wallet").agg(F.min("trade_ts").alias("lo"))
    wallets = t.select("proxy_wallet", F.col("trade_ts").alias("as_of_ts")).distinct().join(first, "proxy_wallet").withColumn("wallet_age_seconds", F.col("as_of_ts") - F.col("lo"))
    return enrich.young_buys(t, wallets).select("trade_key", "recent_count", "recent_notional", "young_count")


_PIT = "observed_trade_count distinct_market_count distinct_outcome_count active_days total median p90 most stddev mean_price cheap_trade_count last_7d_trade_count last_7d_notional seconds_since_last largest_market_share_ppm buy_count sell_count buy_notional".split()


def _at(q: float, name: str) -> str:
    i = f"((len(v) - 1) * {q}::DOUBLE)"
    return f"CAST(trunc(v[CAST(floor({i}) AS INTEGER) + 1] + (v[least(CAST(floor({i}) AS INTEGER) + 2, len(v))] - v[CAST(floor({i}) AS INTEGER) + 1]) * ({i} - floor({i}))) AS BIGINT) AS {name}"


@query(f"""WITH {EVENT_TRADES}, q AS (SELECT DISTINCT proxy_wallet, trade_ts FROM trades),
    h AS (SELECT q.proxy_wallet, q.trade_ts, t.trade_ts AS ts, t.condition_id, t.asset_id, t.side, t.notional_microusd AS n, t.price_ppm FROM q JOIN trades t ON t.proxy_wallet = q.proxy_wallet AND t.trade_ts BETWEEN greatest(1, q.trade_ts - 2592000) AND q.trade_ts - 1),
    m AS (SELECT proxy_wallet, trade_ts, max(s) AS mv FROM (SELECT proxy_wallet, trade_ts, condition_id, sum(n) AS s FROM h GROUP BY 1, 2, 3) GROUP BY 1, 2),
    g AS (SELECT proxy_wallet, trade_ts, count(*) AS observed_trade_count, count(DISTINCT condition_id) AS distinct_market_count, count(DISTINCT asset_id) AS distinct_outcome_count, count(DISTINCT ts // 86400) AS active_days, CAST(sum(n) AS BIGINT) AS total,
          list(n ORDER BY n) AS v, max(n) AS most, CAST(round_even(stddev_pop(n), 0) AS BIGINT) AS stddev, CAST(sum(price_ppm) // count(*) AS BIGINT) AS mean_price, count(*) FILTER (price_ppm <= 250000) AS cheap_trade_count,
          count(*) FILTER (ts >= trade_ts - 604800) AS last_7d_trade_count, CAST(coalesce(sum(n) FILTER (ts >= trade_ts - 604800), 0) AS BIGINT) AS last_7d_notional, trade_ts - max(ts) AS seconds_since_last,
          count(*) FILTER (side = 'BUY') AS buy_count, count(*) FILTER (side = 'SELL') AS sell_count, CAST(coalesce(sum(n) FILTER (side = 'BUY'), 0) AS BIGINT) AS buy_notional FROM h GROUP BY 1, 2)
    SELECT q.proxy_wallet, q.trade_ts, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _PIT if c in ('observed_trade_count', 'distinct_market_count', 'distinct_outcome_count', 'active_days', 'cheap_trade_count', 'last_7d_trade_count', 'last_7d_notional', 'buy_count', 'sell_count', 'buy_notional'))},
    total, {_at(0.5, 'median')}, {_at(0.9, 'p90')}, most, mean_price, seconds_since_last, CAST(mv * 1000000 // total AS BIGINT) AS largest_market_share_ppm FROM q LEFT JOIN g USING (proxy_wallet, trade_ts) LEFT JOIN m USING (proxy_wallet, trade_ts)""")
def d10_point_in_time_wallets(spark: SparkSession, d: str) -> DataFrame:
    """All of each window, without the history's limit; the total of no trades, which the operator gives as 0, is null."""
    t = event_trades(spark, d)
    found = enrich.point_in_time_summary(t, t, cap=None).withColumn("total", F.when(F.col("observed_trade_count") > 0, F.col("total")))
    return found.select("proxy_wallet", "trade_ts", *[c for c in _PIT if c != "stddev"])


@query(f"""{with_roles('labels_', 'fills', 'outcomes', 'resolutions')}, w AS (SELECT f.trade_key, o.outcome_index = r.winner AS won FROM fills f JOIN outcomes o ON o.asset_id = f.asset_id JOIN resolutions r ON r.condition_id = f.condition_id AND r.terminal = 1)
    SELECT l.trade_key, horizon_seconds, CASE WHEN won IS NOT NULL AND entry_price_ppm IS NOT NULL THEN CAST(won AS INT) ELSE CAST(outcome_won AS INT) END AS outcome_won,
    CASE WHEN won IS NOT NULL AND entry_price_ppm IS NOT NULL THEN CASE WHEN won THEN 1000000 - entry_price_ppm ELSE -entry_price_ppm END ELSE gross_pnl END AS gross_pnl,
    CASE WHEN won IS NOT NULL AND entry_price_ppm IS NOT NULL AND status = 'observed_pending_resolution' THEN 'complete' ELSE status END AS status FROM labels_ l LEFT JOIN w USING (trade_key)""")
def d11_j8_finalised_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.finalized(*tables(spark, d, "labels_", "fills", "outcomes", "resolutions")).select("trade_key", "horizon_seconds", "outcome_won", "gross_pnl", "status")


@query(f"""{with_roles('scenarios', 'labels_')} SELECT s.*, CASE WHEN average_fill_price_ppm > 0 THEN target_notional_microusd * 1000000 // average_fill_price_ppm END AS shares_microshares,
    CASE WHEN average_fill_price_ppm > 0 THEN CASE WHEN outcome_won = 1 THEN target_notional_microusd * 1000000 // average_fill_price_ppm ELSE 0 END - target_notional_microusd END AS gross_pnl FROM scenarios s LEFT JOIN labels_ l USING (trade_key, horizon_seconds)""")
def b37_b38_fill_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return labels.finalized_scenarios(*tables(spark, d, "scenarios", "labels_"))


@query(f"""{with_roles('resolutions', 'outcomes')}, bad AS (SELECT DISTINCT r.condition_id FROM resolutions r JOIN outcomes o ON o.asset_id IN (r.condition_id * 2, r.condition_id * 2 + 1) AND o.condition_id <> r.condition_id WHERE r.terminal = 1)
    SELECT r.condition_id, r.terminal = 1 AND b.condition_id IS NULL AS terminal, CASE WHEN b.condition_id IS NULL THEN winner END AS winner, CASE WHEN b.condition_id IS NOT NULL THEN 'token_condition_conflict' ELSE quality END AS quality FROM resolutions r LEFT JOIN bad b USING (condition_id)""")
def d12_token_conflicts(spark: SparkSession, d: str) -> DataFrame:
    r, o = tables(spark, d, "resolutions", "outcomes")
    k = F.col("condition_id")
    evidence = r.select("condition_id", F.array(k * 2, k * 2 + 1).alias("tokens"), (F.col("terminal") == 1).alias("terminal"), "winner", "quality")
    return labels.without_conflicts(evidence, o).drop("tokens")


@query(f"""{with_roles('fetches', 'summaries', 'wallets')}, w AS (SELECT wallet_snapshot_id, TRY_CAST(regexp_extract(missing_reason, '(?:^|;)(?:raw_)?history_fetch_id:(\\d+)(?:;|$)', 1) AS BIGINT) AS fetch_id FROM wallets)
    SELECT w.wallet_snapshot_id, w.fetch_id, f.status, s.median_notional_microusd FROM w LEFT JOIN (fetches f JOIN summaries s USING (fetch_id)) ON f.fetch_id = w.fetch_id""")
def d13_b25_summaries_of_wallets(spark: SparkSession, d: str) -> DataFrame:
    f, s, w = tables(spark, d, "fetches", "summaries", "wallets")
    named = w.select("wallet_snapshot_id", S.fetch_id(F.col("missing_reason")).alias("fetch_id"))
    return named.join(cohorts.wallet_exports(f, s).select("fetch_id", "status", "median_notional_microusd"), "fetch_id", "left").select("wallet_snapshot_id", "fetch_id", "status", "median_notional_microusd")


@query(f"""{with_roles('fills', 'labels_')}, p AS (SELECT trade_key, {', '.join(f"max(CASE WHEN horizon_seconds = {h} THEN {c} END) AS {c}_{n}" for h, n in ((900, '15m'), (3600, '1h'), (86400, '24h')) for c in ('entry_price_ppm', 'gross_pnl', 'status', 'price_source', 'outcome_won'))} FROM labels_ GROUP BY 1)
    SELECT trade_key, 'train' AS split, coalesce(outcome_won_15m, outcome_won_1h, outcome_won_24h) AS outcome_won, round(coalesce(outcome_won_15m, outcome_won_1h, outcome_won_24h) - price_ppm / 1000000.0, 9) AS edge, round(entry_price_ppm_15m * 0.000001, 9) AS entry_price_15m,
    coalesce(status_24h, 'missing') AS label_status_24h, price_source_1h FROM fills LEFT JOIN p USING (trade_key)""")
def d14_b45_labels_of_rows(spark: SparkSession, d: str) -> DataFrame:
    f, l = tables(spark, d, "fills", "labels_")
    wide = dataset.labels_of(f.withColumn("split", F.lit("train")), l, {900: "15m", 3600: "1h", 86400: "24h"})
    return wide.select("trade_key", "split", "outcome_won", F.round("edge", 9).alias("edge"), F.round("entry_price_15m", 9).alias("entry_price_15m"), "label_status_24h", "price_source_1h")


_TEXTS = "texts AS (SELECT vec_id, sha256(CAST(vec_id // 2 AS VARCHAR)) AS text_hash, concat('title ', CAST(vec_id AS VARCHAR)) AS title FROM embeddings), known AS (SELECT DISTINCT text_hash FROM texts WHERE vec_id % 3 = 0)"


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    texts = e.select("vec_id", F.sha2(F.floor(F.col("vec_id") / 2).cast("string"), 256).alias("text_hash"), F.concat(F.lit("title "), F.col("vec_id").cast("string")).alias("title"), "embedding", "label")
    return texts, texts.where("vec_id % 3 = 0").select("text_hash").distinct()


@query(f"WITH {_TEXTS} SELECT text_hash, min(title) AS title FROM texts WHERE text_hash NOT IN (SELECT text_hash FROM known) GROUP BY 1")
def d16_e31_missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    return sampling.missing_embeddings(*_texts(spark, d))


@query(f"WITH {_TEXTS} SELECT vec_id, generation_device FROM (SELECT text_hash, 'cpu' AS generation_device FROM known) JOIN texts USING (text_hash)")
def d17_markets_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    texts, known = _texts(spark, d)
    vectors = texts.groupBy("text_hash").agg(F.min_by("embedding", "vec_id").alias("embedding")).join(known, "text_hash").withColumns({"model_name": F.lit("m"), "generation_device": F.lit("cpu")})
    both = vectors.unionByName(vectors.withColumn("model_name", F.lit("other")))
    return sampling.with_vectors(texts.select("vec_id", "text_hash"), both, "m").select("vec_id", "generation_device")


@query("SELECT DISTINCT CASE WHEN label % 3 = 0 THEN 'cpu' ELSE 'cuda' END AS generation_device FROM embeddings")
def e37_devices(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.devices(table(spark, d, "embeddings").select(F.when(F.col("label") % 3 == 0, "cpu").otherwise("cuda").alias("generation_device")))


_GOOD = "(SELECT 1 FROM resolutions r WHERE r.condition_id = m.condition_id AND r.terminal = 1 AND r.source = 'authority')"


@query(f"{with_roles('cohort_markets', 'resolutions')} SELECT condition_id FROM cohort_markets m WHERE cohort_name = 'main' AND eligible = 1 AND NOT EXISTS {_GOOD}")
def d18_unverified_candidates(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.unverified_candidates(*tables(spark, d, "cohort_markets", "resolutions"), "main").select("condition_id")


@query(f"{with_roles('cohort_markets', 'resolutions')} SELECT condition_id, fetch_status FROM cohort_markets m WHERE cohort_name = 'main' AND selection_status = 'selected' AND fetch_status IN ('pending', 'failed') AND EXISTS {_GOOD}")
def d19_scan_targets(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.scan_targets(*tables(spark, d, "cohort_markets", "resolutions"), "main").select("condition_id", "fetch_status")


@query(f"{with_roles('cohort_markets', 'resolutions')} SELECT condition_id FROM cohort_markets m WHERE cohort_name = 'main' AND eligible = 1 AND selection_status = 'selected' AND EXISTS {_GOOD}")
def c11_verified_markets(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.verified_markets(*tables(spark, d, "cohort_markets", "resolutions"), "main").select("condition_id")


_ABANDONED = """SELECT j.job_key, j.status, m.canonical_category, m.selection_status FROM jobs j JOIN cohorts c ON c.cohort_name = j.cohort_name JOIN cohort_markets m ON m.cohort_name = j.cohort_name AND m.condition_id = j.entity_id
    WHERE j.cohort_name = 'main' AND j.status IN ('pending', 'leased') AND j.job_kind = 'verify_resolution' AND c.discovery_complete = 1 AND m.selection_status <> 'selected'"""


@query(f"{with_roles('jobs', 'cohorts', 'cohort_markets')} {_ABANDONED}")
def d20_abandoned_jobs(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.abandoned_jobs(*tables(spark, d, "jobs", "cohorts", "cohort_markets"), "main").select("job_key", "status", "canonical_category", "selection_status")


@query(f"{with_roles('fetches', 'summaries')} SELECT fetch_id FROM fetches f WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey + 10 = f.fetch_id) AND NOT EXISTS (SELECT 1 FROM summaries s WHERE s.fetch_id = f.fetch_id)")
def d21_unsummarised_fetches(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "orders").select((F.col("o_custkey") + 10).alias("fetch_id"))
    return cohorts.unsummarised(raw, *tables(spark, d, "fetches", "summaries")).select("fetch_id")


@query(f"""{with_roles('scores', 'fills', 'markets', 'outcomes')} SELECT f.trade_ts, f.trade_key, m.title, o.outcome_name, f.notional_microusd / 1000000.0 AS notional_usd, s.score FROM scores s JOIN fills f USING (trade_key) JOIN markets m ON m.condition_id = f.condition_id
    JOIN outcomes o ON o.asset_id = f.asset_id WHERE s.bucket = 'high' AND s.score_version = (SELECT max(score_version) FROM scores) ORDER BY f.trade_ts DESC, f.trade_key LIMIT 10""")
def d22_g2_b50_high_scores(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.high_scores(*tables(spark, d, "scores", "fills", "markets", "outcomes"))


@query(sql("""SELECT horizon_seconds, status, coalesce(price_source, 'none') AS price_source, coalesce(price_quality, 'none') AS price_quality, count(*) AS n, count(*) FILTER (fee_source IS NULL) AS unknown_fees, round(avg(gross_pnl) / 1000000.0, 6) AS mean_gross
    FROM labels_ l JOIN scoped s ON s.trade_key = l.trade_key GROUP BY 1, 2, 3, 4""", "labels_"))
def d23_e9_e14_label_report(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.label_report(scoped(spark, d), role(spark, d, "labels_"))


@query(f"""{with_roles('fills')} SELECT trade_key, CAST(order_key % 2 AS INT) AS outcome_won, price_ppm / 1000000.0 AS delayed_price FROM fills""")
def d24_c15_training_rows(spark: SparkSession, d: str) -> DataFrame:
    f = role(spark, d, "fills")
    left = f.select("trade_key", F.lit("train").alias("split"))
    right = f.select("trade_key", F.lit("train").alias("split"), (F.col("order_key") % 2).cast("int").alias("outcome_won"), S.dollars(F.col("price_ppm")).alias("entry_price_15m"))
    return readers.training_rows(left, right, "15m").select("trade_key", "outcome_won", "delayed_price")


@query(f"""{with_roles('fetches', 'summaries')}, f AS (SELECT f.proxy_wallet, v.v AS again, f.window_start, f.window_end, f.fetch_id * 10 + v.v AS fetch_id, f.status, s.median_notional_microusd FROM fetches f JOIN summaries s USING (fetch_id) CROSS JOIN (VALUES (0), (1)) v(v))
    SELECT proxy_wallet, window_start, window_end, max(fetch_id) AS fetch_id FROM f WHERE status IN ('complete', 'truncated') GROUP BY 1, 2, 3""")
def d27_usable_fetches(spark: SparkSession, d: str) -> DataFrame:
    f, s = tables(spark, d, "fetches", "summaries")
    again = F.explode(F.array(F.lit(0), F.lit(1))).alias("again")
    twice = lambda t: t.select(*t.columns, again).withColumn("fetch_id", F.col("fetch_id") * 10 + F.col("again")).drop("again")
    return cohorts.usable_fetches(twice(f), twice(s)).select("proxy_wallet", "window_start", "window_end", "fetch_id")


# Reports


@query(f"""{with_roles('fills')} SELECT count(*) AS trades, count(*) FILTER (source_mode = 'live') AS live, count(*) FILTER (source_mode = 'backfill') AS backfill, count(*) FILTER (enrichment_status = 'complete') AS complete,
    count(*) FILTER (enrichment_status = 'pending') AS pending, count(*) FILTER (enrichment_status = 'failed') AS failed, max(ingested_at) AS freshest FROM fills""")
def e1_totals(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.totals(role(spark, d, "fills"))


@query(f"{with_roles('books', 'fetches')} SELECT 'books' AS what, status, count(*) AS n FROM books GROUP BY status UNION ALL SELECT 'fetches', status, count(*) FROM fetches GROUP BY status")
def e4_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [cohorts.counts_by(role(spark, d, x), "status").select(F.lit(x).alias("what"), "status", "n") for x in ("books", "fetches")])


@query(f"""{with_roles('cohort_markets')} SELECT canonical_category, CAST(sum(eligible) AS BIGINT) AS eligible, count(*) FILTER (selection_status = 'selected') AS selected, count(*) FILTER (selection_status = 'redundant') AS redundant,
    count(*) FILTER (selection_status = 'not_selected' AND selection_reason = 'random_reject') AS random_rejected, count(*) FILTER (selection_status = 'selected' AND fetch_status = 'complete') AS fetched, count(*) FILTER (selection_status = 'selected' AND fetch_status = 'failed') AS failed,
    count(*) FILTER (selection_status = 'selected' AND fetch_status = 'complete' AND qualifying_trade_count = 0) AS zero_trade, CAST(sum(CASE WHEN selection_status = 'selected' THEN qualifying_trade_count ELSE 0 END) AS BIGINT) AS trades,
    count(DISTINCT CASE WHEN selection_status = 'selected' THEN coalesce(event_id, event_slug) END) AS unique_events FROM cohort_markets WHERE cohort_name = 'main' GROUP BY 1""")
def e5_cohort_funnel(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.funnel(role(spark, d, "cohort_markets"), "main")


@query(sql("SELECT canonical_category, count(DISTINCT proxy_wallet) AS wallets FROM scoped GROUP BY 1"))
def e6_wallets_by_category(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.wallets_by_category(scoped(spark, d))


@query(f"{with_roles('jobs')} SELECT job_kind, status, count(*) AS n FROM jobs WHERE cohort_name IN ('main', 'main:live') GROUP BY 1, 2")
def e7_job_counts(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.counts_by(cohorts.jobs_of(role(spark, d, "jobs"), "main"), "job_kind", "status")


@query(f"{with_roles('jobs')} SELECT job_kind, job_key, attempts, last_error, updated_at, job_id FROM jobs WHERE cohort_name IN ('main', 'main:live') AND status = 'dead' ORDER BY updated_at DESC, job_id DESC LIMIT 20")
def e7_dead_jobs(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.dead_jobs(role(spark, d, "jobs"), "main")


@query(f"{with_roles('jobs')} SELECT job_kind, count(*) AS n FROM jobs WHERE cohort_name IN ('main', 'main:live') AND status = 'succeeded' AND last_error ILIKE 'skipped%' GROUP BY 1")
def c13_audited_skips(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.audited_skips(role(spark, d, "jobs"), "main")


@query(f"{with_roles('jobs')} SELECT job_key, priority FROM jobs WHERE status = 'pending' AND available_at <= 950000000 AND job_kind IN ('scan_market', 'observe_entry') ORDER BY priority DESC, available_at, job_id LIMIT 5")
def g5_next_jobs(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.next_jobs(role(spark, d, "jobs"), 950_000_000, ["scan_market", "observe_entry"], 5).select("job_key", "priority")


@query(f"""{with_roles('resolutions', 'cohort_markets')}, r AS (SELECT * FROM resolutions WHERE condition_id IN (SELECT condition_id FROM cohort_markets WHERE cohort_name = 'main'))
    SELECT status, quality, count(*) AS n FROM r GROUP BY 1, 2""")
def e8_resolution_quality(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.counts_by(cohorts.resolutions_of(*tables(spark, d, "resolutions", "cohort_markets"), "main"), "status", "quality")


@query(f"""{with_roles('resolutions', 'cohort_markets')} SELECT count(*) AS checked, count(*) FILTER (terminal = 1) AS terminal, count(*) FILTER (was_disputed = 1) AS disputed FROM resolutions WHERE condition_id IN (SELECT condition_id FROM cohort_markets WHERE cohort_name = 'main')""")
def d26_e8_resolution_totals(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.resolution_totals(cohorts.resolutions_of(*tables(spark, d, "resolutions", "cohort_markets"), "main"))


@query(f"{with_roles('cohort_markets')} SELECT coalesce(eligibility_reason, 'none') AS reason, count(*) AS n FROM cohort_markets WHERE cohort_name = 'main' AND eligible = 0 GROUP BY 1")
def e8_ineligible_reasons(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.ineligible_reasons(role(spark, d, "cohort_markets"), "main")


@query(sql("""SELECT CAST(h.h AS INT) AS horizon_seconds, count(l.trade_key) AS covered, count(*) AS expected, count(*) - count(l.trade_key) AS missing FROM scoped s CROSS JOIN (VALUES (900), (3600), (86400)) h(h) LEFT JOIN labels_ l ON l.trade_key = s.trade_key AND l.horizon_seconds = h.h GROUP BY 1""", "labels_"))
def e10_label_coverage(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.label_coverage(scoped(spark, d), role(spark, d, "labels_"))


@query(sql("""SELECT count(*) AS trades, count(*) - count(DISTINCT s.trade_key) AS duplicate_trade_keys, count(*) FILTER (o.condition_id <> s.condition_id) AS outcome_condition_mismatches, count(*) FILTER (o.outcome_index IS NULL) AS missing_outcome_indexes, 0::BIGINT AS orphans,
    count(*) FILTER (enrichment_status = 'complete') AS enriched, count(*) FILTER (enrichment_status IN ('pending', 'failed')) AS open_enrichment FROM scoped s LEFT JOIN outcomes o ON o.asset_id = s.asset_id""", "outcomes"))
def e12_trade_integrity(spark: SparkSession, d: str) -> DataFrame:
    return audit.trade_integrity(scoped(spark, d), *tables(spark, d, "outcomes", "cohort_markets"))


@query(sql(f"""SELECT canonical_category, count(*) AS trades, count(DISTINCT proxy_wallet) AS wallets, count(DISTINCT condition_id) AS markets, count(DISTINCT {_EVENT}) AS events, round(avg(price_ppm) / 1000000.0, 6) AS mean_trade_price FROM scoped GROUP BY 1"""))
def e16_category_summary(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.category_summary(scoped(spark, d))


@query(sql("""SELECT canonical_category, outcome_won, count(*) AS trades, count(DISTINCT condition_id) AS items FROM scoped s JOIN labels_ l ON l.trade_key = s.trade_key AND l.horizon_seconds = 900 AND l.status = 'complete' GROUP BY 1, 2""", "labels_"))
def e17_winner_balance(spark: SparkSession, d: str) -> DataFrame:
    at = role(spark, d, "labels_").where("horizon_seconds = 900 and status = 'complete'").select("trade_key", "outcome_won")
    return reports.class_balance(scoped(spark, d).join(at, "trade_key"), ["canonical_category"], "outcome_won", "condition_id")


# Exports


def _export(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows, _ = cohorts.cohort_exports(*tables(spark, d, "cohorts", "cohort_markets", "fills", "resolutions", "labels_", "scenarios"), "main")[name]
        return rows

    run.__name__ = f"a15_{name}"
    return run


_MINE = "FROM cohort_markets WHERE cohort_name = 'main'"
for _name, _select in {
    "cohort_markets": f"SELECT * {_MINE} AND selection_status = 'selected'",
    "cohort_resolutions": "SELECT r.*, m.canonical_category, m.random_rank FROM resolutions r JOIN cohort_markets m USING (condition_id) WHERE m.cohort_name = 'main'",
    "cohort_labels": "SELECT l.*, s.canonical_category, s.trade_ts FROM labels_ l JOIN scoped s USING (trade_key)",
    "cohort_label_fill_scenarios": "SELECT x.*, s.trade_ts FROM scenarios x JOIN scoped s USING (trade_key)",
    "cohort_trades": "SELECT f.*, s.canonical_category, s.random_rank FROM fills f JOIN scoped s USING (trade_key)",
    "cohort_similarity_rejections": f"SELECT cohort_name, condition_id, title, canonical_category, random_rank, selection_reason, duplicate_of_condition_id, similarity_ppm {_MINE} AND selection_status = 'redundant'",
    "cohort_admission_rejections": f"SELECT cohort_name, condition_id, title, canonical_category, random_rank, discovery_ordinal, selection_reason {_MINE} AND selection_status = 'not_selected' AND selection_reason = 'random_reject'",
}.items():
    query(sql(_select, "resolutions", "labels_", "scenarios"))(_export(_name))


@query(f"{with_roles('fetches', 'summaries')} SELECT f.*, s.median_notional_microusd, s.note FROM fetches f JOIN summaries s USING (fetch_id)")
def a14_wallet_summaries(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.wallet_exports(*tables(spark, d, "fetches", "summaries"))


# Work that is left


@query(f"""{with_roles('fills', 'features', 'fetches', 'summaries')} SELECT trade_key, trade_ts, enrichment_status FROM fills t WHERE enrichment_status IN ('pending', 'failed')
    OR (enrichment_status = 'complete' AND NOT EXISTS (SELECT 1 FROM features f WHERE f.trade_key = t.trade_key AND f.feature_version = 2))
    OR (enrichment_status = 'complete' AND NOT EXISTS (SELECT 1 FROM fetches h JOIN summaries s USING (fetch_id) WHERE h.proxy_wallet = t.proxy_wallet AND h.window_start = greatest(1, t.trade_ts - 2592000) AND h.window_end = t.trade_ts - 1 AND h.status IN ('complete', 'truncated')))
    ORDER BY trade_ts, trade_key LIMIT 500""")
def c10_g9_pending_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.pending_enrichment(*tables(spark, d, "fills", "features", "fetches", "summaries"), 2, 500)


@query(f"{with_roles('fills', 'features')} SELECT trade_key FROM fills t WHERE enrichment_status <> 'not_selected' AND (enrichment_status IN ('pending', 'failed') OR NOT EXISTS (SELECT 1 FROM features f WHERE f.trade_key = t.trade_key AND f.feature_version = 2))")
def c12_needs_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.needs_enrichment(*tables(spark, d, "fills", "features"), 2).select("trade_key")


@query(f"""{with_roles('fills', 'labels_')} SELECT trade_key, CAST(h.h AS INT) AS horizon_seconds FROM fills CROSS JOIN (VALUES (900), (3600), (86400)) h(h) LEFT JOIN labels_ l USING (trade_key) WHERE l.trade_key IS NULL OR l.horizon_seconds = h.h AND l.status IN ('pending', 'observed_pending_resolution')
    UNION ALL SELECT f.trade_key, CAST(h.h AS INT) FROM fills f CROSS JOIN (VALUES (900), (3600), (86400)) h(h) WHERE EXISTS (SELECT 1 FROM labels_ l WHERE l.trade_key = f.trade_key) AND NOT EXISTS (SELECT 1 FROM labels_ l WHERE l.trade_key = f.trade_key AND l.horizon_seconds = h.h)""")
def c12_needs_label(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.needs_label(*tables(spark, d, "fills", "labels_"))


@query(f"{with_roles('markets')} SELECT condition_id FROM markets WHERE (start_ts <= 795000000 OR start_ts IS NULL) AND condition_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 4)")
def c16_backfill_markets(spark: SparkSession, d: str) -> DataFrame:
    m = role(spark, d, "markets").withColumn("created_ts", F.col("start_ts"))
    excluded = table(spark, d, "part").where("p_size < 4").select(F.col("p_partkey").alias("condition_id"))
    return ingest.backfill_markets(m, excluded, 795_000_000).select("condition_id")


@query(f"{with_roles('fills', 'scores')} SELECT trade_key FROM fills LEFT JOIN scores USING (trade_key) WHERE coalesce(score_version, 1) = 1 AND (notional_microusd >= 1000000000 OR score >= 5)")
def c5_live_books(spark: SparkSession, d: str) -> DataFrame:
    f, s = tables(spark, d, "fills", "scores")
    return f.join(s.where("score_version = 1"), "trade_key", "left").where(S.needs_book(F.col("notional_microusd"), F.col("score"))).select("trade_key")


@query(f"{with_roles('fills')} SELECT filter, count(*) AS n FROM (SELECT 'all' AS filter FROM fills UNION ALL SELECT 'price_lt_0.95' FROM fills WHERE price_ppm / 1000000.0 < 0.95) GROUP BY 1")
def c14_trade_filters(spark: SparkSession, d: str) -> DataFrame:
    f = role(spark, d, "fills").withColumn("price", S.dollars(F.col("price_ppm")))
    return reduce(DataFrame.unionByName, [model.filtered(f, x).agg(F.count("*").alias("n")).select(F.lit(x).alias("filter"), "n") for x in model.FILTERS])


@query(f"""{with_roles('fills', 'markets')}, e AS (SELECT trade_key, condition_id, trade_ts, notional_microusd, end_ts FROM fills LEFT JOIN markets USING (condition_id))
    SELECT job_kind, job_key, cohort_name, entity_id, priority, available_at FROM (
    SELECT 'enrich_trade' AS job_kind, concat('enrich_trade:', trade_key, ':v1') AS job_key, 'main:live' AS cohort_name, trade_key AS entity_id, 0 AS priority, 900000000::BIGINT AS available_at FROM e WHERE notional_microusd >= 500000000 OR ('0x' || substr(sha256(trade_key), 1, 16))::UBIGINT % 4 < 1
    UNION ALL SELECT 'observe_entry', concat('observe_entry:', trade_key, ':', CAST(h.h AS VARCHAR)), 'main:live', trade_key, 30, trade_ts + h.h FROM e CROSS JOIN (VALUES (900), (3600), (86400)) h(h)
    UNION ALL SELECT 'capture_book', concat('capture_book:', trade_key, ':post_detection'), 'main:live', trade_key, 40, 900000000 FROM e WHERE notional_microusd >= 1000000000
    UNION ALL SELECT DISTINCT 'resolve_market', concat('resolve_market:', CAST(condition_id AS VARCHAR)), 'main:live', CAST(condition_id AS VARCHAR), 0, greatest(900000000, coalesce(end_ts, 900000000)) FROM e)""")
def j9_fan_out(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.fan_out(*tables(spark, d, "fills", "markets"), "main", 900_000_000, live=True)


# Feeds


_FEEDS = """feeds AS (SELECT p_size % 5 AS round, 1 AS feed, p_partkey AS position, p_partkey AS condition_id, p_size = 7 AS failed FROM part WHERE p_size < 30 UNION ALL SELECT p_size % 5, 2, -p_partkey, p_partkey, false FROM part WHERE p_type = 'SMALL' OR p_size > 20
    UNION ALL SELECT p_size % 3, 3, p_partkey, p_partkey, p_size > 40 FROM part WHERE p_brand < 'Brand#2')"""


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    pick = lambda rows, n, feed, at, bad: rows.select((F.col("p_size") % n).alias("round"), F.lit(feed).alias("feed"), at.alias("position"), F.col("p_partkey").alias("condition_id"), bad.alias("failed"))
    k, size = F.col("p_partkey"), F.col("p_size")
    return pick(p.where(size < 30), 5, 1, k, size == 7).unionByName(pick(p.where("p_type = 'SMALL' or p_size > 20"), 5, 2, -k, F.lit(False))).unionByName(pick(p.where("p_brand < 'Brand#2'"), 3, 3, k, size > 40))


@query(f"WITH {_FEEDS}, n AS (SELECT *, row_number() OVER (ORDER BY round, feed, position, condition_id) AS discovery_ordinal FROM feeds WHERE NOT failed) SELECT condition_id, arg_min(feed, discovery_ordinal) AS feed, min(discovery_ordinal) AS discovery_ordinal FROM n GROUP BY 1")
def f7_j12_discovered(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.discovered(_feeds(spark, d)).select("condition_id", "feed", "discovery_ordinal")


@query(f"WITH {_FEEDS} SELECT condition_id, min(feed) AS feed FROM feeds GROUP BY 1")
def h1_union_of_feeds(spark: SparkSession, d: str) -> DataFrame:
    feeds = _feeds(spark, d)
    parts = [feeds.where(F.col("feed") == k).drop(*(["failed"] if k == 2 else [])) for k in (1, 2, 3)]
    return ingest.first_wins(readers.merged_schemas(*parts), [["condition_id"]], ["feed"]).select("condition_id", "feed")


@query(f"""{with_roles('streams', 'cohort_markets')} SELECT tag_slug FROM streams WHERE exhausted = 0 AND canonical_category NOT IN (SELECT n_nationkey FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) WHERE n >= 6)""")
def j12_active_feeds(spark: SparkSession, d: str) -> DataFrame:
    chosen = table(spark, d, "customer").select(F.col("c_nationkey").alias("canonical_category"))
    return cohorts.active_feeds(role(spark, d, "streams"), chosen, 6).select("tag_slug")


@query(f"""{with_roles('markets', 'fills')}, f AS (SELECT condition_id, min(trade_ts) AS a, max(trade_ts) AS b FROM fills GROUP BY 1) SELECT 0::BIGINT AS shared, count(*) AS "all" FROM f""")
def h3_disjoint_splits(spark: SparkSession, d: str) -> DataFrame:
    split = dataset.time_split(dataset.market_spans(role(spark, d, "fills").withColumn("resolved_at", F.col("trade_ts"))), 900_000_000, 7)
    return cohorts.disjoint(split.where("split = 'train'"), split.where("split = 'test'"), "condition_id")


@query(f"WITH {EVENT_TRADES} SELECT trade_key, trade_ts FROM trades WHERE side = 'BUY' AND trade_ts BETWEEN (SELECT min(trade_ts) + 3600 FROM trades) AND (SELECT min(trade_ts) + 2000000 FROM trades)")
def j3_j4_j6_overlapping_polls(spark: SparkSession, d: str) -> DataFrame:
    """Three polls that overlap, one of them tried twice, into a store that keeps each trade once."""
    t = event_trades(spark, d)
    start = t.agg(F.min("trade_ts")).first()[0] or 0
    path = f"{shared_folder(spark)}/polls-{uuid.uuid4().hex}"
    sink, last = live.store_once(path), start + 3600 + live.OVERLAP
    for batch, end in ((0, 700_000), (1, 1_400_000), (2, 2_000_000)):
        window = live.poll_window(last, start + end)
        for _ in range(1 + batch % 2):
            sink(live.in_window(t.where("side = 'BUY'"), *window), batch)
        last = start + end
    return spark.read.parquet(f"{path}/batch=*").select("trade_key", "trade_ts")


@query(f"""WITH {EVENT_TRADES} SELECT trade_key, CAST(h.h AS INT) AS horizon_seconds, trade_ts + h.h AS due_at, CASE WHEN trade_ts + h.h > 1705000000 THEN 'wait' WHEN 1705000000 - (trade_ts + h.h) <= 300 THEN 'live' ELSE 'history' END AS path FROM trades CROSS JOIN (VALUES (900), (3600), (86400)) h(h)""")
def j7_routed_observations(spark: SparkSession, d: str) -> DataFrame:
    return live.routed(live.fan_out(event_trades(spark, d)), 1_705_000_000).select("trade_key", "horizon_seconds", "due_at", "path")


@query(f"{with_roles('resolutions')} SELECT condition_id, resolved_at % 40000 AS checked_at FROM resolutions WHERE terminal = 0 AND resolved_at % 40000 + 21600 <= 50000")
def j8_to_recheck(spark: SparkSession, d: str) -> DataFrame:
    return labels.to_recheck(role(spark, d, "resolutions").withColumn("checked_at", F.col("resolved_at") % 40_000), 50_000)


# Order books: a part's lines as asks and bids


_LEVELS = """levels AS (SELECT l_partkey AS asset_id, CASE WHEN l_returnflag = 'R' THEN 'bid' ELSE 'ask' END AS side, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 200000 END + CAST(round(l_discount * 1000000) AS BIGINT) + 10000 AS price, CAST(sum(l_quantity) AS BIGINT) * 4000000 AS size FROM lineitem GROUP BY 1, 2, 3)"""


def _levels(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    bid = F.col("l_returnflag") == "R"
    price = F.when(bid, 0).otherwise(200_000) + F.round(F.col("l_discount") * S.MILLION).cast("bigint") + 10_000
    return i.groupBy(F.col("l_partkey").alias("asset_id"), F.when(bid, "bid").otherwise("ask").alias("side"), price.alias("price")).agg((F.sum("l_quantity").cast("bigint") * 4_000_000).alias("size"))


@query(f"WITH {_LEVELS} SELECT asset_id, side, CAST(row_number() OVER (PARTITION BY asset_id, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END) - 1 AS INT) AS level_number, price AS price_ppm, size AS size_microshares FROM levels")
def a10_f9_book_levels(spark: SparkSession, d: str) -> DataFrame:
    return book.levels(book.of_levels(_levels(spark, d), "asset_id", "side", "price", "size"), "asset_id")


_LIVE = f"""{_LEVELS}, b AS (SELECT asset_id, min(CASE WHEN side = 'ask' THEN price END) AS ask, max(CASE WHEN side = 'bid' THEN price END) AS bid FROM levels GROUP BY 1),
    x AS (SELECT l.asset_id, sum(CASE WHEN price <= ask + 10000 THEN size END) AS d1, sum(CASE WHEN price <= ask + 50000 THEN size END) AS d5 FROM levels l JOIN b USING (asset_id) WHERE side = 'ask' GROUP BY 1),
    due AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS trade_key, l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS asset_id, 900 AS horizon_seconds, 1000 AS due_at, 1000 + l_orderkey % 400 AS now FROM lineitem)"""


@query(f"""WITH {_LIVE} SELECT trade_key, horizon_seconds, CASE WHEN now > due_at + 300 THEN 'history' ELSE 'live' END AS path, CASE WHEN now <= due_at + 300 THEN CASE WHEN ask IS NULL THEN 'price_unavailable' ELSE 'observed_pending_resolution' END END AS status,
    CASE WHEN now <= due_at + 300 AND ask IS NOT NULL THEN now END AS observed_at, CASE WHEN now <= due_at + 300 THEN ask END AS entry_price_ppm, CASE WHEN now <= due_at + 300 AND ask IS NOT NULL THEN bid END AS best_bid_ppm,
    CASE WHEN now <= due_at + 300 THEN ask - bid END AS spread_ppm, CAST(CASE WHEN now <= due_at + 300 THEN d1 END AS BIGINT) AS ask_depth_1c, CAST(CASE WHEN now <= due_at + 300 THEN d5 END AS BIGINT) AS ask_depth_5c FROM due LEFT JOIN b USING (asset_id) LEFT JOIN x USING (asset_id)""")
def j10_live_labels(spark: SparkSession, d: str) -> DataFrame:
    books = book.of_levels(_levels(spark, d), "asset_id", "side", "price", "size")
    i = table(spark, d, "lineitem")
    due = i.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_key"), (F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 1_000_000_000).otherwise(0)).alias("asset_id"), F.lit(900).alias("horizon_seconds"), F.lit(1000).alias("due_at"), (F.col("l_orderkey") % 400 + 1000).alias("now"))
    return labels.live_labels(due, books).drop("fills", "price_source")


@query(f"""{with_roles('books')}, k AS (SELECT order_key % 50000 AS k, trade_ts, trade_key, CASE WHEN order_key % 4 = 0 AND line = 2 THEN 'failed' ELSE 'complete' END AS status, price_ppm FROM fills)
    SELECT k, arg_min(trade_key, (trade_ts, trade_key)) AS trade_key, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE arg_min(status, (trade_ts, trade_key)) END AS status, arg_min(price_ppm, (trade_ts, trade_key)) AS price_ppm FROM k GROUP BY 1""")
def e30_first_books(spark: SparkSession, d: str) -> DataFrame:
    f = role(spark, d, "fills")
    status = F.when((F.col("order_key") % 4 == 0) & (F.col("line") == 2), "failed").otherwise("complete")
    rows = f.select((F.col("order_key") % 50_000).alias("k"), "trade_ts", "trade_key", status.alias("status"), "price_ppm")
    return book.first_books(rows, ["k"], ["trade_ts", "trade_key"]).select("k", "trade_key", "status", "price_ppm")


# Lookups


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def a5_lookup(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return readers.lookup(tags, table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", "n_name")


@query("SELECT p_partkey AS market_id FROM part WHERE p_size > 20 AND p_type = 'SMALL' AND p_partkey < 150 ORDER BY p_partkey DESC LIMIT 100")
def a6_market_page(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").select(F.col("p_partkey").alias("market_id"), (F.col("p_size") > 20).alias("closed"), F.array("p_type").alias("tags"))
    return readers.market_page(m, True, "SMALL", 150).select("market_id")


@query("""SELECT p_partkey AS condition_id, CASE WHEN n IS NULL THEN 'missing_resolution' WHEN n > 1 THEN 'ambiguous_response' END AS lookup_error, CASE WHEN n = 1 THEN s END AS s FROM part LEFT JOIN (SELECT s_suppkey % 40 AS k, count(*) AS n, min(s_name) AS s FROM supplier GROUP BY 1) ON k = p_partkey""")
def a8_resolution_lookup(spark: SparkSession, d: str) -> DataFrame:
    closed = table(spark, d, "supplier").select((F.col("s_suppkey") % 40).alias("condition_id"), F.col("s_name").alias("s"))
    return labels.resolution_lookup(table(spark, d, "part").select(F.col("p_partkey").alias("condition_id")), closed)


@query(f"WITH {EVENT_TRADES} SELECT asset_id, max(trade_ts) AS t, arg_max(price_ppm, (trade_ts, price_ppm)) AS price_ppm FROM trades WHERE asset_id = 'click' AND trade_ts BETWEEN 1704100000 AND 1705900000 GROUP BY asset_id, trade_ts // 3600")
def a9_price_history(spark: SparkSession, d: str) -> DataFrame:
    t = event_trades(spark, d).select("asset_id", F.col("trade_ts").alias("t"), "price_ppm")
    return readers.price_history(t, "click", 1_704_100_000, 1_705_900_000, 60)


# Insert-or-ignore under several keys


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 % 2 = 0")
def e27_several_keys(spark: SparkSession, d: str) -> DataFrame:
    """Chains of six rows: each shares one key with the row before and another with the row after, so every second one stays."""
    n = F.col("o_orderkey")
    a = F.floor(n / 2)
    b = F.when((n % 6 != 0) & (n % 6 != 5), F.floor((n + 1) / 2))
    rows = table(spark, d, "orders").select("o_orderkey", a.alias("a"), b.alias("b"), F.col("o_orderkey").cast("string").alias("c"))
    return ingest.first_wins(rows, [["a"], ["b"], ["c"]], ["o_orderkey"]).select("o_orderkey")


# Training sets


_SETS = """start AS (SELECT min(trade_ts) AS s FROM scoped), base AS (SELECT s.*, m.start_ts, m.end_ts, w.n AS total, w.b AS buy_notional, w.c AS observed_trade_count FROM scoped s JOIN markets m ON m.condition_id = s.condition_id LEFT JOIN (SELECT proxy_wallet AS pw, CAST(sum(notional_microusd) AS BIGINT) AS n, CAST(sum(notional_microusd) FILTER (side = 'BUY') AS BIGINT) AS b, count(*) AS c FROM fills WHERE line < 3 GROUP BY 1) w ON w.pw = s.proxy_wallet)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    s = scoped(spark, d).drop("event_slug")
    f, m = tables(spark, d, "fills", "markets")
    w = f.where("line < 3").groupBy("proxy_wallet").agg(F.sum("notional_microusd").alias("total"), F.sum(F.when(F.col("side") == "BUY", F.col("notional_microusd"))).alias("buy_notional"), F.count("*").alias("observed_trade_count"))
    rows = s.join(m.select("condition_id", "start_ts", "end_ts"), "condition_id").join(w, "proxy_wallet", "left")
    zero = {c: F.when(F.col("observed_trade_count").isNotNull(), F.lit(10)) for _, c, _ in dataset.WALLET_FIELDS if c != "observed_trade_count"}
    more = {"buy_count": F.lit(None).cast("long"), "sell_count": F.lit(None).cast("long"), "history_truncated": (F.col("line") == 1).cast("int"), "size_vs_median_milli": F.when(F.col("line") > 2, F.col("notional_microusd") % 9000), "burst_size": F.col("line"), "score": F.lit(1), "bucket": F.lit("low"), "split": F.when(F.col("order_key") % 3 == 0, "test").otherwise("train"), "split_basis": F.when(F.col("order_key") % 2 == 0, "after_cutoff").otherwise("overlap_random")}
    return dataset.features_of(rows.withColumns({**zero, **more}))


@query(sql("""SELECT trade_key, round(log10(notional_microusd / 1000000.0), 6) AS log_notional, CASE WHEN line > 2 THEN (notional_microusd % 9000) / 1000.0 END AS size_vs_median, observed_trade_count AS wallet_observed_trade_count, CASE WHEN observed_trade_count IS NOT NULL THEN round(10 * 0.000001, 9) END AS wallet_mean_notional_usd,
    CASE WHEN observed_trade_count IS NOT NULL THEN 0 END AS wallet_buy_count, CASE WHEN total > 0 THEN round(coalesce(buy_notional, 0) / total, 9) END AS wallet_buy_notional_share, CAST(observed_trade_count IS NULL AS INT) AS missing_wallet_buy_count, CAST(line <= 2 AS INT) AS missing_size_vs_median,
    round((trade_ts - s) / (30.4375 * 86400), 6) AS months_since_dataset_start, round(1.0 / count(*) OVER (PARTITION BY condition_id), 9) AS market_weight FROM base, start""", "markets", more=f"{SCOPE}, {_SETS}"))
def b40_b41_b42_e25_features(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    rounded = {"log_notional": 6, "wallet_mean_notional_usd": 9, "wallet_buy_notional_share": 9, "months_since_dataset_start": 6, "market_weight": 9}
    return f.select("trade_key", "size_vs_median", "wallet_observed_trade_count", "wallet_buy_count", "missing_wallet_buy_count", "missing_size_vs_median", *[F.round(c, n).alias(c) for c, n in rounded.items()])


_BASIS = "sets AS (SELECT *, CASE WHEN order_key % 3 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN order_key % 2 = 0 THEN 'after_cutoff' ELSE 'overlap_random' END AS split_basis FROM base)"


@query(sql("SELECT split, split_basis, count(DISTINCT condition_id) AS markets, count(*) AS trades FROM sets GROUP BY 1, 2", "markets", more=f"{SCOPE}, {_SETS}, {_BASIS}"))
def e22_split_basis(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_basis(_features(spark, d))


@query(sql("""SELECT measure, n, round(n / (SELECT count(*) FROM sets), 6) AS share FROM (SELECT 'history_truncated' AS measure, count(*) FILTER (line = 1) AS n FROM sets UNION ALL SELECT 'in_bursts', count(*) FILTER (line > 1) FROM sets
    UNION ALL SELECT 'missing_hours_to_scheduled_end', count(*) FILTER (end_ts IS NULL) FROM sets UNION ALL SELECT 'missing_size_vs_median', count(*) FILTER (line <= 2) FROM sets UNION ALL SELECT 'missing_wallet_buy_notional_share', count(*) FILTER (total IS NULL) FROM sets)""", "markets", more=f"{SCOPE}, {_SETS}, {_BASIS}"))
def e23_dataset_quality(spark: SparkSession, d: str) -> DataFrame:
    return dataset.quality(_features(spark, d), ("hours_to_scheduled_end", "size_vs_median", "wallet_buy_notional_share"))


@query(f"{with_roles('fills', 'labels_')} SELECT '15m' AS horizon, coalesce(status, 'missing') AS status, count(*) AS n FROM fills f LEFT JOIN labels_ l ON l.trade_key = f.trade_key AND horizon_seconds = 900 GROUP BY 2")
def e23_label_statuses(spark: SparkSession, d: str) -> DataFrame:
    f, l = tables(spark, d, "fills", "labels_")
    return dataset.label_statuses(dataset.labels_of(f.withColumn("split", F.lit("train")), l, {900: "15m"}), ["15m"])


# Model


_ROWS = """rows AS (SELECT f.trade_key, f.condition_id, m.canonical_category AS category, CAST(f.condition_id % 5 AS INT) AS cv_fold, f.price_ppm / 1000000.0::DOUBLE AS price, CAST(f.order_key % 2 AS INT) AS label, 1.0::DOUBLE / 2 AS market_weight, CASE WHEN f.line = 1 THEN 4.0 ELSE 1.0 END::DOUBLE AS sample_weight,
    CASE WHEN f.line <> 2 THEN (f.price_ppm + 10000) / 1000000.0::DOUBLE END AS entry_price, CASE WHEN f.line <> 2 THEN (CASE WHEN f.order_key % 2 = 1 THEN 1000000 ELSE 0 END - f.price_ppm) / 1000000.0::DOUBLE END AS gross_pnl, CASE WHEN f.line = 3 THEN NULL ELSE f.notional_microusd / 1000000.0::DOUBLE END AS notional_usd, CAST(f.line = 3 AS INT) AS missing_size_vs_median
    FROM fills f JOIN cohort_markets m ON m.condition_id = f.condition_id), p AS (SELECT *, 0.05 + (size_ / 60.0) AS p FROM (SELECT r.*, f.size_microshares / 1000000 AS size_ FROM rows r JOIN fills f USING (trade_key)))"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    f, m = tables(spark, d, "fills", "cohort_markets")
    line, ppm = F.col("line"), F.col("price_ppm")
    return f.join(m.select("condition_id", F.col("canonical_category").alias("category")), "condition_id").select(
        "trade_key", "condition_id", "category", (F.col("condition_id") % 5).cast("int").alias("cv_fold"), (ppm / S.MILLION).alias("price"), (F.col("order_key") % 2).cast("int").alias("label"), F.lit(0.5).alias("market_weight"), F.when(line == 1, 4.0).otherwise(1.0).alias("sample_weight"),
        F.when(line != 2, (ppm + 10_000) / S.MILLION).alias("entry_price"), F.when(line != 2, (F.when(F.col("order_key") % 2 == 1, S.MILLION).otherwise(0) - ppm) / S.MILLION).alias("gross_pnl"),
        F.when(line != 3, F.col("notional_microusd") / S.MILLION).alias("notional_usd"), (line == 3).cast("int").alias("missing_size_vs_median"), (F.col("size_microshares") / S.MILLION / 60 + 0.05).alias("p"),
    )


def rows_sql(select: str) -> str:
    return f"{with_roles('fills', 'cohort_markets')}, {_ROWS} {select}"


@query(rows_sql("""SELECT 'log_notional_usd' AS feature, round(median(ln(1 + notional_usd)), 6) AS fill, round(avg(coalesce(ln(1 + notional_usd), (SELECT median(ln(1 + notional_usd)) FROM rows))), 6) AS mean, round(stddev_pop(coalesce(ln(1 + notional_usd), (SELECT median(ln(1 + notional_usd)) FROM rows))), 6) AS scale FROM rows
    UNION ALL SELECT 'logit_price', NULL, round(avg(ln(q / (1 - q))), 6), round(stddev_pop(ln(q / (1 - q))), 6) FROM (SELECT least(greatest(price, 0.001), 0.999) AS q FROM rows)
    UNION ALL SELECT 'missing_size_vs_median', NULL, round(avg(missing_size_vs_median), 6), round(stddev_pop(missing_size_vs_median), 6) FROM rows
    UNION ALL SELECT 'category=SMALL', NULL, round(avg(CAST(category = 'SMALL' AS INT)), 6), round(stddev_pop(CAST(category = 'SMALL' AS INT)), 6) FROM rows"""))
def m5_b47_feature_builder(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    b = model.Builder(model.Inputs().present(rows.columns), model.categories_of(rows)).fit(rows, "full")
    names = ["log_notional_usd", "logit_price", "missing_size_vs_median", "category=SMALL"]
    out = [(n, round(b.fill[n], 6) if n in b.fill else None, round(b.mean[n], 6), round(b.scale[n], 6)) for n in names]
    return spark.createDataFrame(out, "feature string, fill double, mean double, scale double")


@query(rows_sql("SELECT weighting, round(avg(w), 9) AS mean, round(max(w), 9) AS most FROM (SELECT weighting, w / avg(w) OVER (PARTITION BY weighting) AS w FROM (SELECT 'none' AS weighting, 1.0::DOUBLE AS w FROM rows UNION ALL SELECT 'market', market_weight FROM rows UNION ALL SELECT 'sample', sample_weight FROM rows UNION ALL SELECT 'sample_x_market', sample_weight * market_weight FROM rows)) GROUP BY 1"))
def m6_training_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    parts = [rows.select(F.lit(w).alias("weighting"), model.weight(w).alias("w")) for w in model.WEIGHTINGS]
    both = reduce(DataFrame.unionByName, parts).groupBy("weighting").agg(F.avg("w").alias("m"), F.max("w").alias("x"))
    return both.select("weighting", F.round(F.col("m") / F.col("m"), 9).alias("mean"), F.round(F.col("x") / F.col("m"), 9).alias("most"))


_LOSS = "-(label * ln(q) + (1 - label) * ln(1 - q))"


@query(rows_sql(f"""SELECT 'market' AS weights, cv_fold, round(sum({_LOSS} * sample_weight * market_weight) / sum(sample_weight * market_weight), 8) AS log_loss, round(sum((q - label) ** 2 * sample_weight * market_weight) / sum(sample_weight * market_weight), 8) AS brier FROM (SELECT *, least(greatest(p, 0.000001), 0.999999) AS q FROM p) GROUP BY 2
    UNION ALL SELECT 'trade', cv_fold, round(sum({_LOSS} * sample_weight) / sum(sample_weight), 8), round(sum((q - label) ** 2 * sample_weight) / sum(sample_weight), 8) FROM (SELECT *, least(greatest(p, 0.000001), 0.999999) AS q FROM p) GROUP BY 2"""))
def m7_evaluation_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    parts = [model.metrics(rows, ["cv_fold"], w).select(F.lit(n).alias("weights"), "cv_fold", F.round("log_loss", 8).alias("log_loss"), F.round("brier", 8).alias("brier")) for n, w in (("market", model.MARKET), ("trade", model.TRADE))]
    return parts[0].unionByName(parts[1])


@query("SELECT weighting, features, penalty, n FROM (VALUES ('price_only', 'none', 1), ('price_category', 'l2', 9), ('full', 'l2', 9), ('full', 'elasticnet(0.5)', 9), ('full_interactions', 'l2', 9), ('full_interactions', 'elasticnet(0.5)', 9)) x(features, penalty, n) CROSS JOIN (VALUES ('none'), ('sample'), ('market'), ('sample_x_market')) w(weighting)")
def m8_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(c.weighting, c.features, c.penalty) for c in model.grid()], "weighting string, features string, penalty string")
    return rows.groupBy("weighting", "features", "penalty").agg(F.count("*").cast("int").alias("n"))


@query(rows_sql("""SELECT trade_key, round((SELECT sum(label * sample_weight) / sum(sample_weight) FROM rows o WHERE o.cv_fold <> r.cv_fold), 9) AS p_constant, round(least(greatest(price, 0.001), 0.999), 9) AS p_price FROM rows r"""))
def m12_baselines(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).drop("p").withColumn("heuristic_score", F.col("cv_fold"))
    return model.with_baselines(rows, 5).select("trade_key", F.round("p_constant", 9).alias("p_constant"), F.round("p_price", 9).alias("p_price"))


@query(rows_sql(f"""SELECT predictor, count(*) AS n, round(sum({_LOSS} * w) / sum(w), 8) AS log_loss FROM (SELECT 'p_price' AS predictor, least(greatest(price, 0.001), 0.999) AS q, label, sample_weight * market_weight AS w FROM rows WHERE entry_price IS NOT NULL
    UNION ALL SELECT 'p_entry', least(greatest(entry_price, 0.001), 0.999), label, sample_weight * market_weight FROM rows WHERE entry_price IS NOT NULL) GROUP BY 1"""))
def m12_delayed_price(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("p_price", F.greatest(F.least(F.col("price"), F.lit(0.999)), F.lit(0.001)))
    return model.delayed_price(rows).select("predictor", "n", F.round("log_loss", 8).alias("log_loss"))


@query(rows_sql("""SELECT "group", count(*) AS trades, count(DISTINCT condition_id) AS markets, round(sum(gross_pnl * sample_weight) / sum(sample_weight), 8) AS mean_pnl_trade, round(sum(gross_pnl * sample_weight * market_weight) / sum(sample_weight * market_weight), 8) AS mean_pnl_market
    FROM (SELECT 'all_with_delayed_price' AS "group", * FROM p WHERE entry_price IS NOT NULL UNION ALL SELECT 'flagged', * FROM p WHERE entry_price IS NOT NULL AND p - entry_price > 0.02) GROUP BY 1"""))
def m13_follow_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    return model.follow_diagnostic(_rows(spark, d), resamples=0).select("group", "trades", "markets", F.round("mean_pnl_trade", 8).alias("mean_pnl_trade"), F.round("mean_pnl_market", 8).alias("mean_pnl_market"))


@query(rows_sql("""SELECT category, round(sum(a * (below + b / 2)) / (sum(a) * sum(b)), 9) AS auc FROM (SELECT *, coalesce(sum(b) OVER (PARTITION BY category ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT category, p, sum(CASE WHEN label = 1 THEN sample_weight * market_weight ELSE 0 END) AS a,
    sum(CASE WHEN label = 0 THEN sample_weight * market_weight ELSE 0 END) AS b FROM p GROUP BY 1, 2)) GROUP BY 1"""))
def e32_e35_auc_by_category(spark: SparkSession, d: str) -> DataFrame:
    return model.auc(_rows(spark, d), by=["category"]).select("category", F.round("auc", 9).alias("auc"))


@query(rows_sql("""SELECT candidate, w, round(avg(v - base), 9) AS delta, round(stddev_samp(v - base) / sqrt(count(*)), 9) AS delta_se FROM (SELECT category AS candidate, 'none' AS w, cv_fold, avg(p) AS v FROM p GROUP BY 1, 3) JOIN (SELECT cv_fold, avg(p) AS base FROM p WHERE category = 'SMALL' GROUP BY 1) USING (cv_fold) GROUP BY 1, 2"""))
def f13_fold_deltas(spark: SparkSession, d: str) -> DataFrame:
    per_fold = _rows(spark, d).groupBy(F.col("category").alias("candidate"), F.lit("none").alias("w"), "cv_fold").agg(F.avg("p").alias("log_loss"))
    return model.fold_deltas(per_fold, ["w"], F.col("candidate") == "SMALL").select("candidate", "w", F.round("delta", 9).alias("delta"), F.round("delta_se", 9).alias("delta_se"))


# The gate


@query(sql(f"""SELECT name, CAST(n AS BIGINT) = 0 AS passed, CAST(n AS BIGINT) AS failures, CASE WHEN name = 'abandoned_candidate_jobs' THEN 'warning' ELSE 'error' END AS severity FROM (
    SELECT 'tables_readable' AS name, 0 AS n UNION ALL SELECT 'foreign_keys', 0 UNION ALL SELECT 'cohort_complete', 0 UNION ALL SELECT 'discovery_frozen', 0 UNION ALL SELECT 'resolution_contract', 0
    UNION ALL SELECT 'selected_market_scans_complete', count(*) FILTER (fetch_status <> 'complete') FROM cohort_markets WHERE selection_status = 'selected'
    UNION ALL SELECT 'selected_markets_verified', count(*) FROM cohort_markets m WHERE selection_status = 'selected' AND NOT EXISTS (SELECT 1 FROM resolutions r WHERE r.condition_id = m.condition_id AND r.terminal = 1 AND r.source = 'authority' AND r.winner IS NOT NULL)
    UNION ALL SELECT 'queue_drained', (SELECT count(*) FROM jobs WHERE cohort_name IN ('main', 'main:live') AND status IN ('pending', 'leased')) - (SELECT count(*) FROM ({_ABANDONED}))
    UNION ALL SELECT 'abandoned_candidate_jobs', (SELECT count(*) FROM ({_ABANDONED})) UNION ALL SELECT 'no_dead_jobs', count(*) FROM jobs WHERE cohort_name IN ('main', 'main:live') AND status = 'dead'
    UNION ALL SELECT 'modeling_scope_nonempty', CAST(count(*) = 0 AS INT) FROM scoped UNION ALL SELECT 'selected_enrichment_jobs_terminal', count(*) FROM scoped WHERE enrichment_status IN ('pending', 'failed') UNION ALL SELECT 'trade_keys_unique', count(*) - count(DISTINCT trade_key) FROM scoped
    UNION ALL SELECT 'trade_outcomes_aligned', count(*) FILTER (o.condition_id <> s.condition_id) + count(*) FILTER (o.outcome_index IS NULL) FROM scoped s LEFT JOIN outcomes o ON o.asset_id = s.asset_id
    UNION ALL SELECT 'completed_enrichments_have_features', count(*) FROM scoped s WHERE enrichment_status = 'complete' AND NOT EXISTS (SELECT 1 FROM features f WHERE f.trade_key = s.trade_key)
    UNION ALL SELECT 'label_' || horizon_seconds || '_coverage', missing_rows FROM la
    UNION ALL SELECT 'label_' || horizon_seconds || '_integrity', other_status_rows + incomplete_rows + scheduled_mismatches + observed_mismatches + invalid_prices + winner_mismatches + pnl_mismatches FROM la)""",
    "labels_", "outcomes", "resolutions", "jobs", "features", more=f"{SCOPE}, {_LABEL_AUDIT}"))
def m_audit_gate(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit(*tables(spark, d, "cohorts", "cohort_markets", "resolutions", "jobs", "fills", "outcomes", "labels_", "features"), "main")
