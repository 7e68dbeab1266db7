"""Scores of a language model with deleted interpolation.

P(w | h) = a2 c(h, w) / c(h) + a1 c(w) / N + a0 / (V + 1), with weights by bucket of the context's frequency c(h) (powers of
two). The weights are learned by expectation-maximisation: one part of the training documents is deleted from the counts,
and its tokens are predicted from the rest. For this only a histogram of the three estimates by bucket is gathered, with
ratios in ``steps`` to an octave (a quarter octave by default; more steps come as close to the plain estimates as wanted, for a
larger histogram), so it has a bounded size; the counts themselves never leave the executors. The scores use the counts of all
training documents, over all words, without pruning and without such steps.

Words are runs of other than ASCII white space with A-Z as a-z; each text ends with an end token, and the first word's
context is a start symbol. 64-bit hashes stand for words and pairs of words. Counts travel by chunks and buckets (see
counts), and a pair of words that is in every document is one entry for each chunk.

Defined results: a null or empty text is the end token alone; a null id counts as the empty text when documents are dealt
to parts; with no training documents at all every token gets the uniform estimate; repeated rows are separate documents;
other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import counts as C
from tidemark.llm.common import cut, mix, pick, texts_in, word_hashes

START, END = (mix(np.array([x], np.uint64))[0] for x in (101, 102))
_UNI, _BI = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)
_ONE = np.uint64(1)
BUCKETS = 48
STEPS = 4
_COUNTS = "chunk long, bucket int, answer binary, words long, tokens long, deleted long"


def uni_key(h: np.ndarray) -> np.ndarray:
    return mix(h ^ _UNI) | _ONE


def bi_key(context: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(context) * _BI + h) & ~_ONE


_START_KEY = uni_key(np.array([START]))[0]


def tokens_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: hashes of the tokens with the end tokens, their contexts, and the row of each."""
    for i, j, data, starts, ends in texts_in(column):
        h, row = word_hashes(data, starts, ends)
        n = np.bincount(row, minlength=j - i)
        last = np.cumsum(n + 1) - 1
        tokens = np.empty(len(h) + j - i, np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[last] = False
        tokens[last] = END
        tokens[inside] = h
        context = np.empty_like(tokens)
        context[1:] = tokens[:-1]
        context[last - n] = START
        yield tokens, context, np.repeat(np.arange(i, j), n + 1)


def chunk_keys(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of a chunk: unigram keys, keys of the contexts, pair keys, rows."""
    found = list(tokens_of(docs.column("text")))
    if not found:
        return tuple(np.zeros(0, np.uint64) for _ in range(4))  # type: ignore[return-value]
    tokens, context, rows = (np.concatenate(x) for x in zip(*found, strict=True))
    return uni_key(tokens), uni_key(context), bi_key(context, tokens), rows


def _forward(buckets: int):
    def run(key, docs):
        uni, context, pair, rows = chunk_keys(docs)
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        learn = docs.column("learn").to_numpy(zero_copy_only=False).astype(bool)[rows]
        # The start symbol is a context as often as there are documents.
        keys, place = np.unique(np.concatenate([uni, context[first], pair]), return_inverse=True)
        weights = np.concatenate([learn, learn[first], learn])
        return C.sent(key[0].as_py(), keys, np.bincount(place, weights=weights, minlength=len(keys)).astype(np.int64), buckets)

    return run


def _total(deleted_from: int):
    def run(table: pa.Table) -> pa.Table:
        chunks, lengths, distinct, place, count = C.received(table)
        deleted = np.repeat(chunks >= deleted_from, lengths)
        all_ = np.bincount(place, weights=count, minlength=len(distinct)).astype(np.int64)
        out = np.bincount(place, weights=count * deleted, minlength=len(distinct)).astype(np.int64)
        answers, at = [], 0
        for n, c in zip(lengths, chunks, strict=True):
            p = place[at : at + n]
            packed = C.pack_counts(all_[p])
            # Only the deleted part asks for the counts without it.
            answers.append(len(packed).to_bytes(8, "little") + packed + (C.pack_counts(out[p]) if c >= deleted_from else b""))
            at += n
        uni = ((distinct & _ONE) == _ONE) & (distinct != _START_KEY)
        b = table.column("bucket")[0].as_py()
        sums = [int((uni & (all_ > 0)).sum()), int(all_[uni].sum()), int(out[uni].sum())]
        return pa.table([pa.array([*chunks.tolist(), -1], pa.int64()), pa.array([b] * (len(chunks) + 1), pa.int32()), pa.array([*answers, None], pa.binary()), *[pa.array([0] * len(chunks) + [x], pa.int64()) for x in sums]], names=["chunk", "bucket", "answer", "words", "tokens", "deleted"])

    return run


def _answered(docs: pa.Table, back: pa.Table, deleted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of the chunk: c(w), c(h), c(h, w) and its row; without the deleted part's counts if asked."""
    uni, context, pair, rows = chunk_keys(docs)
    place = np.unique(np.concatenate([uni, context, pair]), return_inverse=True)[1]
    counts = []
    for _, a in C.in_order(back):
        n = int.from_bytes(a[:8], "little")
        c = C.unpack_counts(a[8 : 8 + n])
        counts.append(c - C.unpack_counts(a[8 + n :]) if deleted else c)
    c = np.concatenate(counts)[place] if counts else np.zeros(0, np.int64)
    n = len(uni)
    return c[:n], c[n : 2 * n], c[2 * n :], rows


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2(count))."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


#: Octaves of a ratio on either side of 1; none is beyond 2^64 of the vocabulary.
OCTAVES = 130


def _cell(ratio: np.ndarray, steps: int) -> np.ndarray:
    """0 for a ratio of 0, else its logarithm in steps, from 1 on."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip(np.rint(steps * np.log2(ratio)), -OCTAVES * steps, OCTAVES * steps) + OCTAVES * steps + 1, 0).astype(np.int64)


def _histogram(words: int, tokens: int, steps: int):
    cells = 2 * OCTAVES * steps + 2

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        w, h, hw, _ = _answered(docs, back, deleted=True)
        pair = np.divide(hw, h, out=np.zeros(len(h)), where=h > 0) * (words + 1)
        single = w / max(tokens, 1) * (words + 1)
        found, n = np.unique((bucket_of(h) * cells + _cell(pair, steps)) * cells + _cell(single, steps), return_counts=True)
        return pa.table([pa.array(found), pa.array(n)], names=["cell", "n"])

    return run


def interpolate(cells: np.ndarray, n: np.ndarray, rounds: int = 60, steps: int = STEPS) -> np.ndarray:
    """Weights by bucket (uniform, single word, pair) that make the deleted tokens likeliest, by expectation-maximisation."""
    base = 2 * OCTAVES * steps + 2
    bucket = cells // (base * base)
    back = lambda x: np.where(x > 0, 2.0 ** ((x - OCTAVES * steps - 1) / steps), 0.0)
    estimates = np.stack([np.ones(len(cells)), back(cells % base), back(cells // base % base)], axis=1)
    weights = np.tile([0.1, 0.4, 0.5], (BUCKETS, 1))
    weights[0] = [0.2, 0.8, 0.0]
    start = weights.copy()
    for _ in range(rounds):
        share = weights[bucket] * estimates
        share *= (n / share.sum(axis=1))[:, None]
        # Two tokens of the starting weights keep each weight above 0, but for pairs of an unseen context.
        sums = 2 * start
        np.add.at(sums, bucket, share)
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def _scores(kind: pa.DataType, words: int, tokens: int, weights: np.ndarray, names: list[str]):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        w, h, hw, rows = _answered(docs, back)
        a = weights[bucket_of(h)]
        p = a[:, 0] / (words + 1) + a[:, 1] * (w / max(tokens, 1)) + a[:, 2] * np.divide(hw, h, out=np.zeros(len(h)), where=h > 0)
        if not tokens:
            p[:] = 1.0 / (words + 1)
        n = docs.num_rows
        add = lambda x: np.bincount(rows, weights=x, minlength=n)
        base = add(np.log10((w + 1) / (tokens + words + 1)))
        columns = [docs.column("id"), docs.column("held_out"), pa.array(np.bincount(rows, minlength=n), pa.int64()), pa.array(add(w > 0).astype(np.int64)), pa.array([tokens] * n, pa.int64()), pa.array(base), pa.array(add(np.log10(p)))]
        return pa.table(columns, names=names)

    return run


def fit_and_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held_out: int = 2, deleted: int = 3, chunk_text: int = C.CHUNK_TEXT, bucket_keys: int = C.BUCKET_KEYS, steps: int = STEPS) -> DataFrame:
    """Scores every text with a model of the texts whose crc32(id as text) mod ``parts`` is not ``held_out``.

    The training texts of part ``deleted`` serve to learn the weights. Returns id_col, held_out, n_tokens, n_known,
    train_tokens, base_score (add-one single words) and score, both log10 of the text's probability.
    """
    docs = pick(df, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = docs.schema["id"].dataType.simpleString()
    part = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % parts
    docs = docs.withColumn("part", part)
    all_bytes, deleted_bytes = C.text_bytes(docs, F.col("part") == deleted)
    first = C.parts(all_bytes - deleted_bytes, chunk_text)
    chunk = F.when(F.col("part") == deleted, C.dealt(C.parts(deleted_bytes, chunk_text), "id", "text", first=first)).otherwise(C.dealt(first, "id", "text"))
    texts = docs.select("id", "text", (F.col("part") == held_out).alias("held_out"), (F.col("part") != held_out).alias("learn"), chunk.alias("chunk"))
    buckets = C.parts(all_bytes // 6, bucket_keys)
    back = cut(texts.groupBy("chunk").applyInArrow(_forward(buckets), C.SENT).groupBy("bucket").applyInArrow(_total(first), _COUNTS))
    sums = back.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("words", "tokens", "deleted")]).first()
    answers = back.where("answer is not null").select("chunk", "bucket", "answer")
    apart = F.col("chunk") >= first
    cells = (
        texts.where(apart).groupBy("chunk").cogroup(answers.where(apart).groupBy("chunk"))
        .applyInArrow(_histogram(sums["words"], sums["tokens"] - sums["deleted"], steps), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    ).collect()
    weights = interpolate(np.array([r["cell"] for r in cells], np.int64), np.array([r["n"] for r in cells], float), steps=steps)
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(kind, sums["words"], sums["tokens"], weights, names), schema)
