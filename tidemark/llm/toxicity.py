"""Toxicity by nearest labelled examples.

Texts are sparse vectors over all words of the labelled examples: term frequency x inverse document frequency x relevance
frequency (tf.idf.rf: words that stand more often in label-1 examples weigh more; no word is left out). The k nearest
examples by exact cosine come from an inverted index with block maxima: rare words are looked up (longer lists as rows of a
product), the commonest give each block of examples a bound, and only examples whose bound reaches the k-th best are scored, in
double precision. The neighbours are the evidence; their votes, weighted by nearness, become calibrated probabilities by isotonic regression on examples, each
scored without itself.

The classifier is fitted on a bounded sample of labelled rows (``max_examples``, by hash order), calibrated on
``calibrate_on`` of them; document frequencies are counted over all documents. What is sent to the executors is bounded by
the words of these examples. Words that no example has are no part of a vector. Ties between examples go by their vectors
and labels, never by their ids.

Defined results: a null or empty text, or one without known words, has no neighbours and gets the share of label 1 among
such examples; with no usable labels each score is 0; a document labelled twice counts as toxic if any label says so;
null labels and ids are left out; other columns are dropped (score) or kept (reject).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_remainder, cut, pick, portions

MAX_EXAMPLES = 3_000
#: Examples scored without themselves to calibrate the votes, evenly from all.
CALIBRATE = 3_000
NEIGHBOURS = 15
#: The power of the relevance frequency.
RELEVANCE = 2.0
#: Words in at least one of so many examples are common: they have block maxima instead of lists.
SHARE = 4
#: Lists of at least one of so many examples are kept as rows.
LONG = 64
#: Examples in a block, common words and long lists at most, and texts in one product with them.
BLOCK, COMMON, TEXTS = 4, 1024, 64
#: Above the error of a bound in single precision: at most COMMON + 8 roundings of sums that are 1 at most, for two sides.
MARGIN = 2 * (COMMON + 8) * 2.0**-24
_words = re.compile(r"[^\W\d_]+").findall
#: The same for lower-case ASCII texts.
_ascii_words = re.compile(r"[a-z]+").findall


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return _ascii_words(text.lower()) if text.isascii() else _words(text.lower())


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Index:
    """Unit vectors of examples by example, and by term with block maxima."""

    def __init__(self, n: int, postings: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        terms = np.repeat(np.array(list(postings), np.int32), [len(r) for r, _ in postings.values()])
        rows = np.concatenate([r for r, _ in postings.values()]) if postings else np.zeros(0, np.int64)
        order = np.lexsort((terms, rows))
        weights = np.concatenate([w for _, w in postings.values()])[order] if postings else np.zeros(0)
        self._fill(np.searchsorted(rows[order], np.arange(n + 1)), terms[order], weights)

    @classmethod
    def of(cls, first: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> Index:
        """From each example's terms and weights, one example after the other; it begins at ``first``, which has the end as well."""
        index = cls.__new__(cls)
        index._fill(first, terms, weights)
        return index

    def _fill(self, first: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        self.n, self.n_terms = len(first) - 1, int(terms.max()) + 1 if len(terms) else 0
        self.first, self.terms, self.weights = first, terms, weights

    def _ready(self) -> None:
        """The lists and the block maxima, made where they are used."""
        if hasattr(self, "rows_of"):
            return
        rows = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.first))
        counts = np.bincount(self.terms, minlength=self.n_terms)
        often = np.argsort(-counts, kind="stable")
        common = np.sort(often[:COMMON][counts[often[:COMMON]] * SHARE >= max(self.n, 1)])
        long = often[len(common) :][:COMMON]
        long = np.sort(long[counts[long] * LONG >= max(self.n, 1)])
        self.row_of = np.full(self.n_terms, -1, np.int32)
        self.row_of[long] = np.arange(len(long))
        self.place = np.full(self.n_terms, -1, np.int32)
        self.place[common] = np.arange(len(common))
        at = self.place[self.terms]
        self.most = np.zeros((len(common), -(-self.n // BLOCK)), np.float32)
        np.maximum.at(self.most, (at[at >= 0], rows[at >= 0] // BLOCK), np.nextafter(self.weights[at >= 0].astype(np.float32), np.float32(2)))
        listed = self.row_of[self.terms]
        self.rows = np.zeros((len(long), self.n), np.float32)
        self.rows[listed[listed >= 0], rows[listed >= 0]] = self.weights[listed >= 0]
        rest = np.flatnonzero((at < 0) & (listed < 0))
        rest = rest[np.argsort(self.terms[rest], kind="stable")]
        self.sizes = np.where((self.place < 0) & (self.row_of < 0), counts, 0)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.rows_of, self.weights_of = rows[rest], self.weights[rest].astype(np.float32)
        self.scratch = np.zeros(self.n_terms)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("n", "n_terms", "terms", "weights", "first")}

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query (terms, weights): the k examples of the largest positive cosine, as (cosine, example), nearest first, ties to the smaller example."""
        self._ready()
        out = []
        for i in range(0, len(queries), TEXTS):
            some = queries[i : i + TEXTS]
            q, r = np.zeros((len(some), len(self.most)), np.float32), np.zeros((len(some), len(self.rows)), np.float32)
            for j, (t, x) in enumerate(some):
                for made, place in ((q, self.place), (r, self.row_of)):
                    at = place[t]
                    made[j, at[at >= 0]] = x[at >= 0]
            bounds = np.repeat(q @ self.most, BLOCK, axis=1)[:, : self.n] + r @ self.rows
            for j, (t, x) in enumerate(some):
                out.append(self._best(bounds[j], t, x, k, without[i + j] if without else -1))
        return out

    def _cosines(self, near: np.ndarray) -> np.ndarray:
        """Of the query in the scratch and some examples, in double precision."""
        sizes = self.first[near + 1] - self.first[near]
        at = _spans(self.first[near], sizes)
        return np.bincount(np.repeat(np.arange(len(near)), sizes), self.scratch[self.terms[at]] * self.weights[at], len(near))

    def _best(self, bounds: np.ndarray, t: np.ndarray, x: np.ndarray, k: int, without: int) -> list[tuple[float, int]]:
        sizes = self.sizes[t]
        at = _spans(self.starts[t], sizes)
        upper = np.bincount(self.rows_of[at], np.repeat(x, sizes) * self.weights_of[at], self.n) + bounds
        if without >= 0:
            upper[without] = 0
        self.scratch[t] = x
        first = k + k // 3
        near = np.argpartition(upper, self.n - first)[self.n - first :] if self.n > first else np.arange(self.n)
        near = near[upper[near] > 0]
        exact = self._cosines(near)
        if self.n > first:
            # The k-th best of these is a floor; whoever's bound reaches it is scored as well.
            floor = np.partition(exact, len(exact) - k)[len(exact) - k] - MARGIN if len(exact) >= k else 0.0
            upper[near] = 0
            more = np.flatnonzero((upper >= floor) & (upper > 0))
            near, exact = np.concatenate([near, more]), np.concatenate([exact, self._cosines(more)])
            ahead = np.argsort(near)
            near, exact = near[ahead], exact[ahead]
        self.scratch[t] = 0
        order = np.argsort(-exact, kind="stable")[:k]
        return [(c, i) for c, i in zip(exact[order].tolist(), near[order].tolist(), strict=True) if c > 0]

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """As nearest_of, for one query by term."""
        known = sorted((t, x) for t, x in query.items() if 0 <= t < self.n_terms)
        return self.nearest_of([(np.array([t for t, _ in known], np.int64), np.array([x for _, x in known], float))], k, [without])[0] if known else []


def counted(text: str | None, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The known words of a text, ascending, and how often each is in it."""
    return np.unique(np.array([known[w] for w in words_of(text) if w in known], np.int64), return_counts=True)


def unit(x: np.ndarray) -> np.ndarray:
    return x / math.sqrt(x @ x) if len(x) else x


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nondecreasing fit of y on x: knots and values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        if blocks and blocks[-1][1] == a:
            blocks[-1][2] += b
            blocks[-1][3] += 1
        else:
            blocks.append([a, a, b, 1])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, end, s, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], end, blocks[-1][2] + s, blocks[-1][3] + n]
    knots = [z for a, b, _, _ in blocks for z in (a, b)]
    # Half a row of either label keeps the scores off 0 and 1.
    return np.array(knots), np.array([(s + 0.5) / (n + 1) for _, _, s, n in blocks for _ in (0, 1)])


@dataclass
class Model:
    known: dict[str, int]
    #: The weight of each word: inverse document frequency x relevance.
    weight: np.ndarray
    index: Index
    labels: np.ndarray
    ids: list
    prior: float
    empty: float
    k: int = NEIGHBOURS
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def vote(self, near: list[tuple[float, int]]) -> float:
        weights = np.array([c * c for c, _ in near])
        return float((weights @ self.labels[[i for _, i in near]] + 0.5 * self.prior) / (weights.sum() + 0.5))

    def example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of an example and their weights."""
        at = slice(self.index.first[i], self.index.first[i + 1])
        return self.index.terms[at], self.index.weights[at]

    def near(self, found: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """The neighbours of each text, from its words and their weights; none for a text without words."""
        full = [i for i, (t, _) in enumerate(found) if len(t)]
        out: list[list[tuple[float, int]]] = [[] for _ in found]
        for i, x in zip(full, self.index.nearest_of([(found[i][0], unit(found[i][1])) for i in full], self.k, [without[i] for i in full] if without else None), strict=True):
            out[i] = x
        return out

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """The score and the neighbours of each text."""
        for i in range(0, len(texts), TEXTS):
            found = [(t, (1 + np.log(c)) * self.weight[t]) for t, c in (counted(x, self.known) for x in texts[i : i + TEXTS])]
            for near in self.near(found):
                yield (float(np.interp(self.vote(near), self.knots, self.values)) if near and len(self.knots) else self.empty), near


def _sample(labels: DataFrame, limit: int) -> DataFrame:
    """Labelled ids in hash order; the limit bounds what is sent to the executors."""
    rows = labels.where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS, relevance: float = RELEVANCE, calibrate_on: int = CALIBRATE) -> tuple[Broadcast, np.ndarray, np.ndarray]:
    """docs: (id, text); labels: (id, y) of the rows to learn from. Gives the model, sent to the executors, and its knots and values."""
    spark = docs.sparkSession
    chosen = cut(docs.join(F.broadcast(_sample(labels, max_examples)), "id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        rows = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y"), strict=True):
                counts[y.as_py()].update(set(words_of(text.as_py())))
                rows[y.as_py()] += 1
        both = [""] + list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(both), pa.array([rows[0]] + [counts[0][w] for w in both[1:]], pa.int64()), pa.array([rows[1]] + [counts[1][w] for w in both[1:]], pa.int64())], names=["w", "n0", "n1"])

    # The words in their order after "", which has the numbers of rows.
    words = chosen.mapInArrow(sets, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().sort_by("w")
    d0, d1 = words.column("n0").to_numpy(), words.column("n1").to_numpy()
    n0, n1 = (int(d0[0]), int(d1[0])) if len(d0) else (0, 0)
    n, d0, d1 = n0 + n1, d0[1:], d1[1:]
    if not n:
        none = Index.of(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0))
        return spark.sparkContext.broadcast(Model({}, np.zeros(0), none, np.zeros(0), [], 0.0, 0.0, k)), np.zeros(0), np.zeros(0)
    known = {w: i for i, w in enumerate(words.column("w").slice(1).to_pylist())}
    del words
    shared = spark.sparkContext.broadcast(known)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts, n = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for part in portions(batch, "text"):
                found = [known[w] for text in part.column("text").to_pylist() for w in set(words_of(text)) if w in known]
                counts += np.bincount(np.array(found, np.int64), minlength=len(known))
                n += part.num_rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some]).astype(np.int32)), pa.array(np.concatenate([[n], counts[some]]))], names=["t", "n"])

    found = docs.select("text").mapInArrow(frequencies, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(known) + 1, np.int64)
    df[found.column("t").to_numpy()] = found.column("n").to_numpy()
    del found
    weight = np.log((df[-1] + 1) / (df[:-1] + 0.5)) * np.log2(2 + d1 / np.maximum(d0, 1)) ** relevance

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(x.as_py(), shared.value) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([t.astype(np.int32).tobytes() for t, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())], names=["id", "y", "t", "c"])

    rows = chosen.mapInArrow(bags, f"id {docs.schema['id'].dataType.simpleString()}, y int, t binary, c binary").toArrow().to_pylist()
    shared.destroy()  # the model has the words of its own
    # Examples without words are not in the index. The others lie in the order of their vectors and labels, so that ids decide nothing.
    blank, rows = [r["y"] for r in rows if not r["t"]], sorted((r for r in rows if r["t"]), key=lambda r: (r["t"], r["c"], r["y"], r["id"]))
    first = np.cumsum([0] + [len(r["t"]) // 4 for r in rows])
    terms, counts = (np.frombuffer(b"".join(r[x] for r in rows), np.int32) for x in ("t", "c"))
    ids, y = [r["id"] for r in rows], np.array([r["y"] for r in rows], float)
    del rows
    x = (1 + np.log(counts)) * weight[terms]
    sizes = np.diff(first)
    index = Index.of(first, terms, x / np.repeat(np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), x * x, len(sizes))), sizes))
    prior = n1 / n
    sent = spark.sparkContext.broadcast(Model(known, weight, index, y, ids, prior, (sum(blank) + prior) / (len(blank) + 1), k))
    step = max(1, -(-len(ids) // calibrate_on))
    del index, terms, counts, x, known
    pa.default_memory_pool().release_unused()

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            picked = batch.column("id").to_pylist()
            found = [(model.vote(a), model.labels[i]) for i, a in zip(picked, model.near([model.example(i) for i in picked], picked), strict=True) if a]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64())], names=["v", "y"])

    pairs = spark.range(0, len(ids), step).mapInArrow(votes, "v double, y double").toArrow().sort_by([("v", "ascending"), ("y", "ascending")]) if ids else None
    knots, values = isotonic(pairs.column("v").to_numpy(), pairs.column("y").to_numpy()) if pairs else (np.zeros(0), np.zeros(0))
    return sent, knots, values


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out=None, **options) -> DataFrame:
    """Scores every document: id_col, held_out, score, predicted, evidence array<struct<id, cosine, label>> (nearest three).

    Labels are learned only from rows for which ``held_out`` (a condition on the column "id") is false.
    """
    rows = pick(docs, id=id_col, text=text_col)
    held = F.coalesce(held_out if held_out is not None else crc_remainder("id", 5) == 0, F.lit(False))
    shared, knots, values = fit(rows, pick(labels, id=id_col, y=label_col).where(~held), **options)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.knots, model.values = knots, values
        for batch in batches:
            kinds = pa.list_(pa.struct([("id", batch.schema.field("id").type), ("cosine", pa.float64()), ("label", pa.int32())]))
            for part in portions(batch, "text"):
                found = list(model.scores(part.column("text").to_pylist()))
                evidence = [[{"id": model.ids[i], "cosine": c, "label": int(model.labels[i])} for c, i in near[:3]] for _, near in found]
                scores = pa.array([s for s, _ in found], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), scores, pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array(evidence, kinds)], names=[id_col, "held_out", "score", "predicted", "evidence"])

    return rows.withColumn("held_out", held).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, evidence array<struct<id: {kind}, cosine: double, label: int>>")


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, held_out=None, **options) -> DataFrame:
    """docs, all columns, without the documents that score ``threshold`` or more. The texts are read where they lie."""
    rows = pick(docs, id=id_col, text=text_col)
    held = F.coalesce(held_out if held_out is not None else crc_remainder("id", 5) == 0, F.lit(False))
    shared, knots, values = fit(rows, pick(labels, id=id_col, y=label_col).where(~held), **options)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.knots, model.values = knots, values
        for batch in batches:
            for part in portions(batch, at):
                yield part.filter(pa.array([s < threshold for s, _ in model.scores(part.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
