"""The corpus pipeline: documents to token ids, in five stages that each work on all that the one before kept.

Every stage but the last returns the columns of documents. run() writes each stage's result as Parquet in the shared folder and
reads it again for the next; a stage's input and its intermediate tables are deleted once its result is written, so at most two
copies of the documents are there at a time, and the last one stays, as the result is read from it. SQL can't express the stages
(see tests/llm for brute-force versions).

Defined results: null and empty texts pass all stages (they are not toxic unless labelled empty texts are, have no near copies,
no secrets and no tokens) unless the mixing thins them out; documents without an id are no near copies of any; repeated rows of
one id are near copies of each other under the same id and both stay; an empty table gives an empty result; further columns
of documents are kept until the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, ngram_join, secrets, toxicity
from tidemark.llm.common import scope, shared_folder, table
from tidemark.llm.queries import DOMAINS, domain_of_labels
from tidemark.scratch import delete

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    found = ngram_join.near_duplicates(docs)
    return docs.join(found.where("component_id < doc_id").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars counts the new text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Noisy documents are thinned out to their share beside the clean ones, which all stay."""
    return mixing.thin_to_shares(docs, table(spark, sf_dir, "labels"), domain_of_labels(), list(DOMAINS), list(DOMAINS.values()))[0]


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, with digests of the ids and of the text they decode to."""
    coded = bpe.encode_decode(docs)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("secrets", hide_secrets), ("mixing", mix_domains), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{k}-{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
