"""A cohort's tables on the sample tables: markets from part, trades from lineitem and orders, wallets from customer.

Each role is one SELECT in the SQL that Spark and DuckDB share, so that a query and its comparison start from the same rows.
@epoch(x) stands for the seconds of a timestamp, and other roles are named as tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.roles import table

TABLES = ("part", "supplier", "customer", "orders", "lineitem", "events", "nation", "region")
ROLES: dict[str, str] = {
    "cohorts": """SELECT 'main' AS cohort_name, 820000000 AS window_start, 980000000 AS window_end, 'complete' AS phase, 1 AS discovery_complete, 1 AS resolution_required,
        'authority' AS resolution_source, 'complete' AS resolution_status, 150 AS category_limit""",
    "cohort_markets": """SELECT 'main' AS cohort_name, p_partkey AS condition_id, p_type AS canonical_category, p_name AS title,
        CASE WHEN p_size % 10 = 0 THEN '' WHEN p_size % 10 = 1 THEN NULL ELSE p_brand END AS event_id, CASE WHEN p_size % 20 < 2 THEN NULL ELSE lower(p_brand) END AS event_slug,
        p_partkey * 7919 % 100003 AS random_rank, p_partkey * 31 % 40009 AS discovery_ordinal, CASE WHEN p_size > 45 THEN 0 ELSE 1 END AS eligible,
        CASE WHEN p_size > 48 THEN 'missing_title' WHEN p_size > 45 THEN 'category_not_targeted' END AS eligibility_reason,
        CASE WHEN p_size > 45 THEN 'ineligible' WHEN p_size % 7 = 0 THEN 'redundant' WHEN p_size % 7 = 1 THEN 'not_selected' ELSE 'selected' END AS selection_status,
        CASE WHEN p_size > 45 THEN NULL WHEN p_size % 7 = 0 THEN 'semantic_similarity' WHEN p_size % 14 = 1 THEN 'random_reject' WHEN p_size % 7 = 1 THEN 'category_limit' END AS selection_reason,
        CASE WHEN p_size > 45 OR p_size % 7 < 2 THEN 'not_selected' WHEN p_size % 11 = 0 THEN 'failed' WHEN p_size % 13 = 0 THEN 'pending' ELSE 'complete' END AS fetch_status,
        p_size % 4 AS qualifying_trade_count, CASE WHEN p_size % 7 = 0 THEN p_partkey + 1 END AS duplicate_of_condition_id, CASE WHEN p_size % 7 = 0 THEN 900000 + p_size END AS similarity_ppm FROM part""",
    "markets": """SELECT p_partkey AS condition_id, CASE WHEN p_size = 13 THEN NULL ELSE p_type END AS category, lower(p_brand) AS event_slug, p_name AS title, concat('m-', CAST(p_partkey AS STRING)) AS slug,
        CASE WHEN p_size % 8 = 0 THEN NULL ELSE 780000000 + p_size * 86400 * 20 END AS start_ts, CASE WHEN p_size % 6 = 0 THEN NULL ELSE 990000000 + p_size * 86400 END AS end_ts FROM part""",
    "outcomes": """SELECT p_partkey * 2 + x.i AS asset_id, CASE WHEN p_size = 50 THEN p_partkey + 1 ELSE p_partkey END AS condition_id, CASE WHEN x.i = 0 THEN 'Yes' ELSE 'No' END AS outcome_name,
        CASE WHEN p_size = 49 THEN NULL ELSE x.i END AS outcome_index FROM part CROSS JOIN (VALUES (0), (1)) AS x(i)""",
    "resolutions": """SELECT p_partkey AS condition_id, CASE WHEN p_size % 9 = 1 THEN 0 ELSE 1 END AS terminal, CASE WHEN p_size % 9 = 1 THEN 'open' ELSE 'resolved' END AS status,
        CASE WHEN p_size % 9 = 1 THEN 'not_closed' ELSE 'terminal_outcome_prices' END AS quality, CASE WHEN p_size % 9 = 1 THEN NULL ELSE p_size % 2 END AS winner,
        CASE WHEN p_size % 9 = 2 THEN 'hearsay' ELSE 'authority' END AS source, 985000000 + p_size * 86400 AS resolved_at, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS was_disputed FROM part WHERE p_size % 9 <> 0""",
    "fills": """SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS trade_key, o_custkey AS proxy_wallet, l_partkey AS condition_id,
        l_partkey * 2 + l_suppkey % 2 AS asset_id, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(round(l_discount * 10000000) AS BIGINT) AS price_ppm,
        CAST(round(l_extendedprice * 1000000) AS BIGINT) AS notional_microusd, CAST(l_quantity AS BIGINT) * 1000000 AS size_microshares,
        @epoch(l_shipdate) + (l_orderkey * 37 + l_linenumber * 7919) % 86400 AS trade_ts, @epoch(l_shipdate) + 100000 AS ingested_at, CASE WHEN o_orderpriority = '1-URGENT' THEN 'live' ELSE 'backfill' END AS source_mode,
        CASE WHEN l_linenumber = 7 THEN 'not_selected' WHEN l_linenumber = 6 AND l_linestatus = 'F' THEN 'failed' WHEN l_linenumber = 6 THEN 'pending' ELSE 'complete' END AS enrichment_status,
        l_orderkey AS order_key, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "features": """SELECT trade_key, CAST(v.v AS INT) AS feature_version, proxy_wallet AS wallet_snapshot_id, CASE WHEN line = 2 THEN NULL ELSE notional_microusd % 9000 + v.v END AS size_vs_median_milli,
        CASE WHEN line = 4 THEN NULL ELSE condition_id * 60 END AS seconds_to_resolution, line AS same_asset_buys_1h FROM fills CROSS JOIN (VALUES (1), (2)) AS v(v) WHERE enrichment_status = 'complete' AND (v.v = 1 OR order_key % 5 > 0)""",
    "wallets": """SELECT c_custkey AS wallet_snapshot_id, c_custkey AS proxy_wallet, c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN 'unavailable' WHEN c_acctbal < 5000 THEN 'partial' ELSE 'complete' END AS completeness,
        CASE WHEN c_custkey % 3 = 0 THEN concat('lifetime_age_unknown;HISTORY_Truncated_at_100_pages;raw_history_fetch_id:', CAST(c_custkey + 10 AS STRING)) WHEN c_custkey % 3 = 1 THEN concat('history_window_complete;history_fetch_id:', CAST(c_custkey + 10 AS STRING))
        ELSE 'history_window_complete' END AS missing_reason FROM customer""",
    "scores": """SELECT trade_key, CAST(v.v AS INT) AS score_version, CAST((size_microshares / 1000000 + v.v) % 12 AS INT) AS score,
        CASE WHEN CAST((size_microshares / 1000000 + v.v) % 12 AS INT) >= 8 THEN 'high' WHEN CAST((size_microshares / 1000000 + v.v) % 12 AS INT) >= 5 THEN 'medium' ELSE 'low' END AS bucket
        FROM fills CROSS JOIN (VALUES (1), (2)) AS v(v) WHERE line < 6 AND (v.v = 1 OR line <> 3)""",
    "books": """SELECT trade_key, asset_id, CASE WHEN line = 1 THEN 'post_detection' ELSE 'label' END AS kind, CASE WHEN order_key % 4 = 0 THEN 'failed' WHEN order_key % 4 = 1 THEN 'historical_unavailable' ELSE 'complete' END AS status,
        trade_ts + 5 AS requested_at, price_ppm + 10000 AS best_ask_ppm, price_ppm AS best_bid_ppm FROM fills WHERE line < 3""",
    "labels_": """SELECT trade_key, CAST(h.h AS INT) AS horizon_seconds, trade_ts + h.h + CASE WHEN line = 4 AND h.h = 3600 THEN 1 ELSE 0 END AS scheduled_at,
        CASE WHEN line = 2 THEN NULL ELSE trade_ts + h.h + order_key % 310 END AS observed_at, CASE WHEN line = 2 THEN NULL WHEN line = 5 THEN price_ppm + 10 ELSE price_ppm END AS entry_price_ppm,
        CASE WHEN line = 1 AND order_key % 3 = 0 THEN 'unavailable_before_horizon' WHEN line = 2 THEN 'price_unavailable' WHEN line = 3 AND h.h = 900 AND order_key % 7 = 0 THEN 'observed_pending_resolution' ELSE 'complete' END AS status,
        CASE WHEN line = 2 THEN NULL WHEN order_key % 2 = 0 THEN 'historical_price_history' ELSE 'historical_trade_print' END AS price_source, CASE WHEN line = 2 THEN NULL ELSE 'approximate' END AS price_quality,
        CASE WHEN line = 2 THEN NULL ELSE order_key % 2 END AS outcome_won, CASE WHEN line = 2 THEN NULL WHEN order_key % 2 = 1 THEN 1000000 - price_ppm ELSE -price_ppm END AS gross_pnl, CASE WHEN line = 1 THEN 'schedule' END AS fee_source
        FROM fills CROSS JOIN (VALUES (900), (3600), (86400)) AS h(h) WHERE NOT (line = 5 AND h.h = 86400)""",
    "scenarios": """SELECT trade_key, horizon_seconds, CAST(n.n AS BIGINT) * 1000000 AS target_notional_microusd, CASE WHEN n.n = 1000 AND entry_price_ppm > 50000 THEN NULL ELSE entry_price_ppm + 1000 * n.n END AS average_fill_price_ppm
        FROM labels_ CROSS JOIN (VALUES (100), (500), (1000)) AS n(n) WHERE entry_price_ppm IS NOT NULL""",
    "jobs": """SELECT o_orderkey AS job_id, concat('job-', CAST(o_orderkey AS STRING)) AS job_key, CASE WHEN o_custkey % 4 = 0 THEN 'main:live' WHEN o_custkey % 31 = 1 THEN 'other' ELSE 'main' END AS cohort_name,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'verify_resolution' WHEN o_orderpriority = '2-HIGH' THEN 'scan_market' WHEN o_orderpriority = '3-MEDIUM' THEN 'observe_entry' ELSE 'enrich_trade' END AS job_kind,
        CASE WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN 'leased' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' AND o_custkey % 5 = 0 THEN 'dead' ELSE 'succeeded' END AS status, o_custkey AS entity_id,
        o_custkey % 9 AS attempts, CASE WHEN o_custkey % 6 = 0 THEN 'Skipped: unknown trade' WHEN o_custkey % 6 = 1 THEN 'timeout' END AS last_error, o_custkey % 40 AS priority, @epoch(o_orderdate) AS available_at, @epoch(o_orderdate) + o_orderkey % 1000 AS updated_at FROM orders""",
    "fetches": """SELECT c_custkey + 10 AS fetch_id, c_custkey AS proxy_wallet, 840000000 + c_custkey % 100 * 86400 AS window_start, 842591999 + c_custkey % 100 * 86400 AS window_end,
        CASE WHEN c_custkey % 3 = 0 THEN 'truncated' WHEN c_custkey % 7 = 0 THEN 'failed' ELSE 'complete' END AS status FROM customer""",
    "summaries": """SELECT c_custkey + 10 AS fetch_id, CAST(round(c_acctbal * 100) AS BIGINT) AS median_notional_microusd, c_mktsegment AS note FROM customer WHERE c_custkey % 11 <> 0""",
    "streams": """SELECT 'main' AS cohort_name, s_nationkey AS canonical_category, CONCAT('tag-', CAST(s_suppkey AS STRING)) AS tag_slug, s_suppkey % 17 AS pages_fetched, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS exhausted FROM supplier""",
}


def _words(sql: str) -> set[str]:
    return set(re.findall(r"\w+", sql))


def needed(*names: str) -> list[str]:
    """The roles that these need, themselves included, in the order of ROLES."""
    found: set[str] = set()
    queue = list(names)
    while queue:
        n = queue.pop()
        if n not in found:
            found.add(n)
            queue += [x for x in _words(ROLES[n].split("FROM", 1)[-1] if "FROM" in ROLES[n] else "") if x in ROLES and x != n]
    return [n for n in ROLES if n in found]


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = "WITH " + ", ".join(f"{n} AS ({ROLES[n]})" for n in needed(name)) + f" SELECT * FROM {name}"
    used = [t for t in TABLES if t in _words(sql)]
    sql = re.sub(r"@epoch\((\w+)\)", r"unix_timestamp(\1)", sql)
    sql = re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", sql) if used else sql
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def with_roles(*names: str) -> str:
    """WITH and the roles in DuckDB's SQL."""
    sql = "WITH " + ", ".join(f"{n} AS ({ROLES[n]})" for n in needed(*names))
    return re.sub(r"@epoch\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", sql)
