import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import counts as C
from tidemark.llm import lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def part(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7


def weights_of(docs):
    """The weights by a plain expectation-maximisation without the histogram's steps."""
    toks = {i: ["<s>", *words(t), "</s>"] for i, t in docs}
    rest = [i for i in toks if part(i) not in (2, 3)]
    uni, bi, ctx = (Counter() for _ in range(3))
    for i in rest:
        t = toks[i]
        uni.update(t[1:])
        ctx.update(t[:-1])
        bi.update(zip(t, t[1:], strict=False))
    v = len(set(w for i in toks if part(i) != 2 for w in toks[i][1:]))
    n = sum(uni.values())
    events = [(min(ctx[h].bit_length(), lm.BUCKETS - 1), 1 / (v + 1), uni[w] / n, bi[h, w] / ctx[h] if ctx[h] else 0.0) for i in toks if part(i) == 3 for h, w in zip(toks[i], toks[i][1:], strict=False)]
    a = np.tile([0.1, 0.4, 0.5], (lm.BUCKETS, 1))
    a[0] = [0.2, 0.8, 0.0]
    start = a.copy()
    for _ in range(60):
        sums = 2 * start
        for b, *e in events:
            s = a[b] * e
            sums[b] += s / s.sum()
        a = sums / sums.sum(axis=1, keepdims=True)
    return a


@pytest.mark.parametrize("sizes", [{}, {"chunk_text": 3000, "bucket_keys": 200}])
def test_against_plain_counts(spark, sf_dir, sizes):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    docs = [(i, (t or "")[:600]) for i, t in docs] + [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "The the THE")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in lm.fit_and_score(df, **sizes).collect()}
    train = [i for i, _ in docs if part(i) != 2]
    toks = {i: [*words(t), None] for i, t in docs}
    c = Counter(w for i in train for w in toks[i])
    bi, ctx = Counter(), Counter()
    for i in train:
        t = ["<s>", *toks[i]]
        bi.update(zip(t, t[1:], strict=False))
        ctx.update(t[:-1])
    n, v = sum(c.values()), len(c)
    a = weights_of(docs)
    assert set(got) == set(toks)
    for i, t in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (part(i) == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        score = sum(math.log10(a[b][0] / (v + 1) + a[b][1] * c[w] / n + a[b][2] * (bi[h, w] / ctx[h] if ctx[h] else 0)) for h, w in zip(["<s>", *t], t, strict=False) for b in [min(ctx[h].bit_length(), lm.BUCKETS - 1)])
        assert math.isclose(r.score, score, rel_tol=0.02)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up_to_one():
    a = lm.interpolate(np.array([1_000_000 * 3 + 401 * 1000 + 401, 401_401]), np.array([5.0, 2.0]))
    assert np.allclose(a.sum(axis=1), 1) and a[0, 2] == 0 and (a[:, :2] > 0).all()


def test_edges(spark):
    assert lm.fit_and_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = next(i for i in range(100) if part(i) == 2)
    r = lm.fit_and_score(spark.createDataFrame([(one, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == 0.0
    twice = lm.fit_and_score(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string")).collect()
    assert len(twice) == 3


def test_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        k = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (C.unpack_keys(C.pack_keys(k)) == k).all()
        c = rng.integers(0, 400, n)
        assert (C.unpack_counts(C.pack_counts(c)) == c).all()
