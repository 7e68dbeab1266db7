import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T


def labelled(n=600):
    random.seed(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        words = [f"w{random.randint(0, 300)}".replace("1", "x").replace("2", "y") for _ in range(40)]
        words = ["".join(c for c in w if c.isalpha()) + random.choice("abcdefghij") for w in words]
        if bad:
            words[5:5] = random.sample(["vile", "rotten", "foul", "nasty"], 2)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_index_is_exact():
    rng = np.random.default_rng(0)
    n, terms = 500, 60
    x = rng.random((n, terms)) * (rng.random((n, terms)) < 0.08)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    index = T.Index(n, {t: (np.flatnonzero(x[:, t]), x[np.flatnonzero(x[:, t]), t]) for t in range(terms)})
    for i in range(0, n, 7):
        query = {t: x[i, t] for t in range(terms) if x[i, t]}
        cosines = x @ x[i]
        cosines[i] = -1
        want = np.sort(cosines[cosines > 0])[::-1][:15]
        got = index.nearest(query, 15, without=i)
        assert np.allclose([c for c, _ in got], want)
        assert all(math.isclose(cosines[j], c) for c, j in got)


def test_isotonic_is_nondecreasing_and_pools():
    knots, values = T.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(values) >= 0).all() and values[knots == 0.2][0] == values[knots == 0.3][0] == 0.5


def test_scores_of_held_out_rows(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame([(i, t, "q") for i, t in [*rows, (9000, None), (9001, ""), (9002, "vile rotten thing"), (9003, "vile"), (9003, "vile")]], "doc_id long, text string, score string")
    truth = dict(labels)
    got = T.score(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert Counter(r.predicted == truth[r.doc_id] for r in held)[True] >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[9000].score == by[9001].score < 0.5 and by[9002].predicted == 1 and by[9002].evidence[0].label == 1
    used = {e.id for r in got for e in r.evidence}
    assert not used & {r.doc_id for r in got if r.held_out}


def test_rejects_keep_all_columns(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame([(i, t, i * 2) for i, t in rows], "doc_id long, text string, n long")
    kept = T.reject(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert sum(i in left for i, y in labels if not y) >= 0.99 * sum(not y for _, y in labels)
    assert sum(i in left for i, y in labels if y) <= 3


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert T.score(docs, spark.createDataFrame([], "doc_id long, toxic int")).first().score == 0.0
    assert T.score(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_all_words_of_the_examples_count(spark):
    # Each text has words of its own: none is in several toxic examples, so no word by itself tells the labels apart.
    own = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in ("qa", "wb", "ec", "rd"))
    docs = [(i, own(i)) for i in range(200)] + [(1000, own(7))]
    labels = [(i, int(i % 10 == 7)) for i in range(200)]
    got = {r.doc_id: r for r in T.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), held_out=F.col("id") >= 1000).collect()}
    first = got[1000].evidence[0]
    assert (first.id, first.label) == (7, 1) and math.isclose(first.cosine, 1)


def test_scores_against_plain_cosines(spark):
    rows, labels = labelled(160)
    docs = spark.createDataFrame([*rows, (500, "vile foul wabc"), (501, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in T.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), held_out=F.col("id") % 4 == 0).collect()}
    texts, truth = dict(rows) | {500: "vile foul wabc", 501: ""}, dict(labels)
    learn = [i for i in truth if i % 4]
    words = {i: Counter(T.words_of(t)) for i, t in texts.items()}
    df, d = Counter(w for c in words.values() for w in c), [Counter(w for i in learn if truth[i] == y for w in words[i]) for y in (0, 1)]
    known = d[0].keys() | d[1].keys()

    def vector(i):
        v = {w: (1 + math.log(n)) * math.log((len(texts) + 1) / (df[w] + 0.5)) * math.log2(2 + d[1][w] / max(1, d[0][w])) ** 2 for w, n in words[i].items() if w in known}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors, prior = {i: vector(i) for i in texts}, sum(truth[i] for i in learn) / len(learn)

    def near(i):
        cosines = sorted(((sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), j) for j in learn if j != i), reverse=True)
        return [(c, j) for c, j in cosines[: T.NEIGHBOURS] if c > 0]

    def vote(found):
        return (sum(c * c * truth[j] for c, j in found) + 0.5 * prior) / (sum(c * c for c, _ in found) + 0.5)

    votes = sorted((vote(f), truth[i]) for i in learn if (f := near(i)))
    knots, values = T.isotonic(np.array([v for v, _ in votes]), np.array([y for _, y in votes], float))
    for i, r in got.items():
        found = near(i) if i not in learn else sorted([*near(i), (1.0, i)], reverse=True)[: T.NEIGHBOURS]
        assert np.allclose([e.cosine for e in r.evidence], [c for c, _ in found[:3]])
        assert math.isclose(r.score, np.interp(vote(found), knots, values) if found else prior, abs_tol=1e-9)
