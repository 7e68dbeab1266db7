import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import mixing as M


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(0)
    n = rng.integers(1, 500, 400)
    p = rng.dirichlet([0.4, 0.4, 0.4], 400)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n long, p array<double>").cache()
    for shares in ([0.5, 0.3, 0.2], [0.9, 0.08, 0.02], [1 / 3] * 3):
        fit = M.fit_rates(rows, lambda t, s=shares: t.sum() * np.array(s), 3)
        assert fit.gap < 1e-4
        r = np.array([x[0] for x in rows.select(M.rate_of(F.col("p"), fit.steps)).collect()])
        assert (r >= 0).all() and np.allclose((r * n) @ p, fit.targets, rtol=1e-3)


def test_impossible_targets_leave_a_gap(spark):
    rows = spark.createDataFrame([(10, [1.0, 0.0])] * 5, "n long, p array<double>")
    fit = M.fit_rates(rows, lambda t: np.array([25.0, 25.0]), 2)
    assert abs(fit.expected[0] - 25) < 1e-3 and fit.expected[1] == 0 and fit.gap > 0.4
    assert M.fit_rates(rows.limit(0), lambda t: t, 2).gap == 0


def corpus():
    random.seed(3)
    return [(i, " ".join(random.choice(["apple", "pear", "plum"] if i % 3 else ["Bolt##", "nut$$", "gear**"]) for _ in range(random.randint(5, 60)))) for i in range(240)]


def test_classifier_mixing_and_thinning(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "n", 1.5) for i, t in [*rows, (900, None), (901, ""), (902, "apple pear"), (902, "apple pear")]], "doc_id long, text string, lang string, rate double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows if i % 2] + [(None, 1), (4, None)], "doc_id long, quality int")
    kind = F.when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "noisy")
    mixed, fit = M.mix_to_targets(docs, labels, kind, ["clean", "noisy"], lambda t: t.sum() * np.array([0.8, 0.2]))
    got = {r.doc_id: r for r in mixed.collect()}
    assert mixed.count() == 244 and fit.gap < 1e-5
    assert all((got[i].p[0] > 0.5) == (i % 3 > 0) for i, _ in rows)
    assert all(got[i].n_tokens == len(t.split()) for i, t in rows) and got[900].n_tokens == 0
    assert all(r.rate >= 0 and int(r.rate) <= r.copies <= int(r.rate) + 1 for r in got.values())
    clash = docs.withColumn("_draw", F.lit(1)).withColumn("draw", F.lit(2))
    kept, fit = M.thin_to_shares(clash, labels, kind, ["clean", "noisy"], [0.9, 0.1])
    assert kept.columns == clash.columns and fit.converged
    assert abs(fit.expected[1] / fit.expected.sum() - 0.1) < 1e-3
    left = {r.doc_id for r in kept.collect()}
    assert all(i in left for i, _ in rows if i % 3)
    assert sum(i in left for i, _ in rows if i % 3 == 0) < 50
    plenty, fit = M.thin_to_shares(docs, labels, kind, ["clean", "noisy"], [0.1, 0.9])
    assert plenty.count() == docs.count() and fit.converged


def test_posteriors_against_plain_softmax():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    model = M.Classifier(["a", "b", "c"], rng.normal(size=(M.HASHED + M.FORM, 3)))
    texts = ["One two, two! #1", "", "words " * 50, "Ünïcode wörds and ÆØÅ $$$", "x"]
    n, p = model.posteriors(pa.array([*texts, None]))
    for i, t in enumerate([*texts, ""]):
        words, raw = t.encode().lower().split(), t.encode()
        h = [M.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0][0] for w in words]
        counts = {}
        for x in h:
            counts[int(x) % M.HASHED] = counts.get(int(x) % M.HASHED, 0) + 1
        v = {f: np.log1p(c) for f, c in counts.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        z = sum((x / norm * model.weights[f] for f, x in v.items()), np.zeros(3))
        size, m = max(len(raw), 1), max(len(words), 1)
        share = lambda chars: sum(b in chars for b in raw) / size  # noqa: E731, B023
        form = [1, np.log1p(len(words)) / 5, 5 * share(b".,;:!?"), 5 * share(b"#*$%&|<>"), 2 * share(bytes(range(65, 91))), 5 * share(b"0123456789"), len(set(h)) / m, np.log1p(size / m) / 3]
        z = z + np.array(form) @ model.weights[M.HASHED :]
        assert n[i] == len(words) and np.allclose(p[i], np.exp(z - z.max()) / np.exp(z - z.max()).sum())


def test_one_domain_and_empty_tables(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    kind = F.when(F.col("quality") == 1, "clean")
    mixed, _ = M.mix_to_targets(docs, none, kind, ["clean", "noisy"], lambda t: t)
    assert all(r.p[0] > 0.99 and abs(r.rate - 1) < 1e-6 for r in mixed.collect())
    assert M.mix_to_targets(docs.limit(0), none, kind, ["clean", "noisy"], lambda t: t)[0].count() == 0
