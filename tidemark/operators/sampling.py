"""Seeded cohorts: ranks by hash, admission, quotas, and the greedy choice of non-redundant items."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.numbering import numbered
from tidemark.scratch import cut


def eligibility(excluded: Column, category: Column, title: Column, created: Column, ended: Column, start: int, end: int) -> Column:
    """The first reason against a candidate, or "eligible"."""
    return (
        F.when(excluded, "excluded").when(category.isNull(), "category_not_targeted").when(F.coalesce(F.trim(title), F.lit("")) == "", "missing_title")
        .when(created > end, "created_after_window").when(ended < start, "ended_before_window").otherwise("eligible")
    )


def ranked(candidates: DataFrame, seed: int, rate: float, category: str, key: str) -> DataFrame:
    """Adds random_rank (64 hex digits) and is_admitted."""
    rows = candidates.withColumn("random_rank", S.random_rank(seed, F.col(category), F.col(key)))
    return rows.withColumn("is_admitted", S.admitted(F.col("random_rank"), round(rate * S.MILLION)))


def top_by_rank(rows: DataFrame, category: str, quota: int, order: list[str]) -> DataFrame:
    w = Window.partitionBy(category).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota)


def missing_embeddings(texts: DataFrame, known: DataFrame, key: str = "text_hash") -> DataFrame:
    """Texts, one for each hash, that have no vector yet."""
    return texts.groupBy(key).agg(F.min("title").alias("title")).join(known.select(key), key, "left_anti")


def with_vectors(markets: DataFrame, embeddings: DataFrame, model: str, key: str = "text_hash") -> DataFrame:
    """Markets with the vector of their title by one model; those without one drop out."""
    return markets.join(embeddings.where(F.col("model_name") == model).select(key, "embedding", "generation_device"), key)


def embedded(texts: DataFrame, make_embedder: Callable[[str], Callable[[list[str]], np.ndarray]], devices: tuple[str, ...] = ("cuda", "mps", "cpu"), batch: int = 64, key: str = "text_hash", text: str = "title") -> DataFrame:
    """(key, embedding array<float> of length 1, generation_device) of texts, by a model that is made once in each task.

    ``make_embedder`` gives the function for a device, or raises where the device is not there: the next one is tried, and
    a single device is taken as asked for. A batch that does not fit in memory is halved. Empty, zero or non-finite vectors
    are errors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = device = None
        for name in devices:
            try:
                embed, device = make_embedder(name), name
                break
            except Exception:
                if name == devices[-1]:
                    raise
        size = batch
        for rows in batches:
            found, todo = [], rows[text].tolist()
            while todo:
                try:
                    made = np.asarray(embed(todo[:size]), float)
                except MemoryError:
                    if size == 1:
                        raise
                    size //= 2
                    continue
                norms = np.linalg.norm(made, axis=1) if made.ndim == 2 and made.shape[1] else np.zeros(1)
                if not np.isfinite(norms).all() or (norms <= 0).any():
                    raise ValueError("an empty, zero or non-finite vector")
                found += (made / norms[:, None]).astype(np.float32).tolist()
                todo = todo[size:]
            yield pd.DataFrame({key: rows[key], "embedding": found, "generation_device": device})

    return texts.select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<float>, generation_device string")


class _Chosen:
    """What a category has chosen so far."""

    def __init__(self, quota: int, rows: pd.DataFrame, key: str, vector: str, events: list[str]) -> None:
        self.quota, self.names, self.vectors = quota, rows[key].tolist(), [np.asarray(v, float) for v in rows[vector]]
        self.events: list[dict] = [{e: n for e, n in zip(rows[c], rows[key], strict=True) if e} for c in events]

    def verdict(self, vector: np.ndarray, events: list, threshold: float) -> tuple[str, str | None, object, int | None]:
        if len(self.names) >= self.quota:
            return "not_selected", "category_limit", None, None
        for kind, known, e in zip(("same_event_id", "same_event_slug"), self.events, events, strict=False):
            if e and e in known:
                return "redundant", kind, known[e], S.MILLION
        if self.names:
            near = np.stack(self.vectors) @ vector
            at = int(near.argmax())
            ppm = int(np.clip(round(float(near[at]) * S.MILLION), -S.MILLION, S.MILLION))
            if ppm >= round(threshold * S.MILLION):
                return "redundant", "semantic_similarity", self.names[at], ppm
        return "selected", None, None, None

    def take(self, name: object, vector: np.ndarray, events: list) -> None:
        self.names.append(name)
        self.vectors.append(vector)
        for known, e in zip(self.events, events, strict=True):
            if e:
                known[e] = name


def greedy_distinct(candidates: DataFrame, category: str, key: str, vector: str, events: list[str], threshold: float, quota: int, second_pass: bool = True, batch: int | None = None) -> DataFrame:
    """(key, category, status, reason, similar_to, similarity_ppm): choice by random_rank within each category.

    An item of a chosen event (``events``: the columns of its id and slug), or within ``threshold`` of a chosen item, is
    redundant; after ``quota`` items the rest is not selected. The admitted come first; with second_pass the others follow
    if there is room, without replacing earlier choices. Choosing is sequential by its definition, so a category goes
    through in batches by rank: a task holds one batch and at most ``quota`` chosen items, whatever the size of the category,
    and the rounds end once all categories are full or through. Null vectors are not candidates.
    """
    spark = candidates.sparkSession
    kinds = dict(candidates.dtypes)
    size = batch or max(1000, 4 * quota)
    columns = [key, category, *events, "admitted", "random_rank"]
    usable = candidates.where(F.col(vector).isNotNull()) if second_pass else candidates.where(F.col(vector).isNotNull() & F.col("admitted"))
    part = F.concat(F.when(F.col("admitted"), "0").otherwise("1"), F.substring("random_rank", 1, 3))
    placed = cut(numbered(usable.select(*columns, vector), "place", part, ["random_rank", key], [category]))
    left = {r[0]: r[1] for r in placed.groupBy(category).agg(F.count("*")).collect()}
    schema = ", ".join([f"{c} {kinds[c]}" for c in [key, category, *events, vector]] + ["status string", "reason string", f"similar_to {kinds[key]}", "similarity_ppm long"])

    def choose(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        state = _Chosen(quota, chosen, key, vector, events)
        out = []
        for r in rows.to_dict("records"):
            unit = np.asarray(r[vector], float)
            unit = unit / (np.linalg.norm(unit) or 1.0)
            its = [r[c] for c in events]
            status, reason, other, ppm = state.verdict(unit, its, threshold)
            if status == "selected":
                state.take(r[key], unit, its)
            elif reason == "category_limit" and not r["admitted"]:
                reason = "random_reject"
            out.append((r[key], r[category], *its, unit.astype(np.float32) if status == "selected" else None, status, reason, other, ppm))
        names = [key, category, *events, vector, "status", "reason", "similar_to", "similarity_ppm"]
        return pd.DataFrame(out, columns=names).astype({"similarity_ppm": "Int64"})

    decided, chosen, done = [], spark.createDataFrame([], schema), 0
    while left:
        rows = placed.where(F.col("place").between(done, done + size - 1) & F.col(category).isin(*left)) if None not in left else placed.where(F.col("place").between(done, done + size - 1))
        found = cut(rows.groupBy(category).cogroup(chosen.groupBy(category)).applyInPandas(lambda a, b: choose(a, b) if len(a) else choose(a.assign(place=[]), b), schema))
        decided.append(found)
        chosen = chosen.unionByName(found.where("status = 'selected'"))
        done += size
        full = {r[0] for r in chosen.groupBy(category).agg(F.count("*").alias("n")).where(F.col("n") >= quota).collect()}
        left = {c: n for c, n in left.items() if n > done and c not in full}
    columns = [key, category, "status", "reason", "similar_to", "similarity_ppm"]
    seen = reduce(DataFrame.unionByName, [d.select(*columns) for d in decided]) if decided else spark.createDataFrame([], schema).select(*columns)
    unseen = candidates.where(F.col(vector).isNotNull()).select(key, category, "admitted").join(seen.select(key), key, "left_anti")
    reason = F.when(F.col("admitted"), "category_limit").otherwise("random_reject")
    return seen.unionByName(unseen.select(key, category, F.lit("not_selected").alias("status"), reason.alias("reason"), F.lit(None).cast(kinds[key]).alias("similar_to"), F.lit(None).cast("long").alias("similarity_ppm")))
