import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


def brute(rows, k, dims):
    out = []
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    for i, v in ok:
        if i % 20 == 0:
            found = sorted(((-sum(a * b for a, b in zip(v.tolist(), w.tolist(), strict=True)), j) for j, w in ok if j != i and len(w) == len(v)))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("cell", "block"), [(8, 2048), (1, 16)])
def test_exact_neighbours(spark, cell, block):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=16) * 10 ** rng.uniform(-3, 3)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(45)] + [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None, *[1.0] * 15]), (405, [float("inf")] * 16)]
    rows += [(500 + 10 * i, [1.0, -2.0 * i, 3.0]) for i in range(9)] + [(620, [1e-160, 1e-160, 0.0]), (640, [1e160, 0.0, 1e150]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, ann.nearest(df, F.col("id") % 20 == 0, 20, cell=cell, block=block).collect()))
    want = brute([r for r in rows], 20, 16)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 24)), rng.normal(size=(70, 24)) * rng.uniform(0.01, 1, size=(70, 1))
    a, b = (ann._Block(np.arange(len(v)).astype("<i8").tobytes(), v.astype("<f8").tobytes(), True, 24) for v in (x, y))
    near, error = ann.tile(a.quantise(a.norms), b.quantise(np.full(70, b.norms.max())))
    true = (x / a.norms[:, None]) @ (y / b.norms.max()).T
    assert (np.abs(true - near) <= error).all() and error.max() < 0.05


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df, F.col("id") % 20 == 0).count() == 0
