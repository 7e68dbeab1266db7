"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, chat, licenses, lm, mixing, ngram_join, quality, secrets, toxicity
from tidemark.llm.common import table


def with_path(docs: DataFrame) -> DataFrame:
    """The documents as files: a directory of a hundred ids in a directory of the source."""
    shard = F.floor(F.col("doc_id") / 100).cast("string")
    return docs.withColumn("path", F.concat_ws("/", "source", shard, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(with_path(table(spark, sf_dir, "documents")), path_col="path")
    return found.withColumn("secret_sha256", F.sha2("secret", 256)).drop("secret")


def op2_block_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


#: Domains of the labelled table, and the shares of tokens that each should have.
DOMAINS = {"clean": 0.94, "noisy": 0.06}


def domain_of_labels():
    return F.when(F.col("quality") == 0, "noisy").when(F.col("quality") == 1, "clean")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates for the shares of DOMAINS at the present number of tokens."""
    shares = list(DOMAINS.values())
    mixed, fit = mixing.mix_to_targets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), domain_of_labels(), list(DOMAINS), lambda totals: totals.sum() * np.array(shares))
    return mixed.select("doc_id", "n_tokens", *[F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies", F.lit(fit.gap).alias("gap"), F.lit(fit.converged).alias("converged"))


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.fit_and_score(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(with_path(table(spark, sf_dir, "documents")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("evidence", F.transform("evidence", lambda x: x.id))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation of an even id as chosen, with the next id's as rejected."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.where("conv_id is not null").select(F.floor(F.col("conv_id") / 2).alias("pair_id")).distinct()
    pairs = pairs.select("pair_id", (2 * F.col("pair_id")).alias("chosen_id"), (2 * F.col("pair_id") + 1).alias("rejected_id"))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ";")
    return chat.preference_pairs(turns, pairs).withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_frequency_filter(table(spark, sf_dir, "documents")).drop("host")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_block_matrix": op2_block_matrix,
    "op3_mixing": op3_mixing,
    "op4_deleted_interpolation": op4_deleted_interpolation,
    "op5_license_scan": op5_license_scan,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_preference_format": op9_preference_format,
    "op10_line_frequency": op10_line_frequency,
}
ORACLE: dict[str, str] = {
    "op2_block_matrix": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_preference_format": """
        WITH t AS (
            SELECT conv_id, turn, min({'role': coalesce(role, 'user'), 'text': coalesce(text, '')}) AS m
            FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
        o AS (SELECT conv_id, turn, m.role AS role, m.text AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t),
        p AS (SELECT DISTINCT conv_id // 2 AS pair_id FROM o),
        j AS (
            SELECT coalesce(a.conv_id // 2, b.conv_id // 2) AS pair_id, coalesce(a.k, b.k) AS k,
                   coalesce(a.role = b.role AND a.text = b.text, false) AS alike
            FROM (SELECT * FROM o WHERE conv_id % 2 = 0) a FULL JOIN (SELECT * FROM o WHERE conv_id % 2 = 1) b
              ON a.conv_id + 1 = b.conv_id AND a.k = b.k),
        n AS (SELECT pair_id, coalesce(min(CASE WHEN NOT alike THEN k END) - 1, count(*)) AS n FROM j GROUP BY pair_id),
        r AS (
            SELECT o.*, n.pair_id, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece
            FROM o JOIN n ON o.conv_id // 2 = n.pair_id),
        e AS (SELECT *, sum(CASE WHEN k > n THEN length(piece) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS stop FROM r),
        c AS (
            SELECT pair_id, conv_id % 2 AS side, any_value(n) AS n,
                   coalesce(string_agg(CASE WHEN k <= n THEN piece END, '' ORDER BY k), '') AS prompt,
                   coalesce(string_agg(CASE WHEN k > n THEN piece END, '' ORDER BY k), '') AS done,
                   coalesce(string_agg(CASE WHEN k > n AND role = 'assistant' THEN (stop - length(text) - 8)::BIGINT::VARCHAR || '-' || (stop - 1)::BIGINT::VARCHAR END, ';' ORDER BY k), '') AS mask
            FROM e GROUP BY pair_id, conv_id % 2)
        SELECT p.pair_id, CAST(coalesce(a.n, b.n) AS INTEGER) AS n_prompt_turns, coalesce(a.prompt, '') AS prompt,
               a.done AS chosen, a.mask AS chosen_mask, b.done AS rejected, b.mask AS rejected_mask,
               coalesce(a.done <> b.done, false) AS is_preference
        FROM p LEFT JOIN (SELECT * FROM c WHERE side = 0) a USING (pair_id) LEFT JOIN (SELECT * FROM c WHERE side = 1) b USING (pair_id)""",
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, g FROM (
                SELECT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 5)
                UNION ALL SELECT doc_id, 'short ' || array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS MATERIALIZED (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach(u, v) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v),
        least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
        equal AS (SELECT doc_id, count(*) OVER (PARTITION BY h) AS class_size FROM (SELECT doc_id, string_agg(g, '|' ORDER BY g) AS h FROM s GROUP BY doc_id))
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(class_size, 1) AS class_size
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON u = d.doc_id LEFT JOIN equal e ON e.doc_id = d.doc_id""",
    "op10_line_frequency": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
        twice AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
        r AS (SELECT doc_id, count(DISTINCT k + j) AS n_repeat_words FROM twice, range(8) t(j) WHERE n > 1 GROUP BY doc_id),
        l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
        x AS (SELECT doc_id, source, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM l),
        y AS (SELECT doc_id, source, line, array_to_string(v, ' ') AS norm, len(v) AS words FROM x WHERE len(v) > 0),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM y GROUP BY doc_id),
        hosts AS (SELECT source, count(*) AS total FROM d GROUP BY source),
        often AS (SELECT source, norm FROM y JOIN hosts USING (source) GROUP BY source, norm HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > 0.10 * any_value(total)),
        gone AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS n FROM y JOIN often USING (source, norm) GROUP BY doc_id),
        m AS (
            SELECT d.doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
            FROM d LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
        f AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                   n_removed_words > 0 AND (n_words - n_removed_words < 20 OR n_words - n_removed_words < 0.5 * n_words) AS depleted FROM m)
        SELECT *, NOT base_failed AND NOT depleted AS kept FROM f""",
}
