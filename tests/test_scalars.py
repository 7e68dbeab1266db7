import hashlib
import random
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.functions import scalars as S


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_fixed_point_is_exact_and_rounded_once(spark):
    random.seed(1)
    rows = [(f"{random.random():.7f}", f"{random.random() * 1000:.6f}") for _ in range(2000)] + [("0.25", "400"), ("0.0000005", "1"), ("0.5", "2000000000.5"), ("0.333333333333333333333", "3000000000"), ("1e-3", "12345678901.000000001"), ("x", "1"), ("", "1"), (None, "1")]
    exact = lambda x: int((x * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP))
    got = values(spark, rows, "p string, q string", S.millionths("p"), S.notional("p", "q"))
    for (p, q), (a, b) in zip(rows, got, strict=True):
        if p in ("x", "", None):
            assert (a, b) == (None, None)
        else:
            assert (a, b) == (exact(Decimal(p)), exact(Decimal(p) * Decimal(q)))


def test_times(spark):
    rows = [("1700000000",), ("1700000000.9",), ("2023-11-14T22:13:20Z",), ("2023-11-14T22:13:20",), ("2023-11-14T23:13:20+01:00",), ("soon",), ("",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", S.epoch_seconds(F.col("t")))] == [1700000000] * 5 + [None] * 3


def test_keys_and_samples(spark):
    rows = [(None, "a"), ("id-1", "b"), ("", "c")]
    got = values(spark, rows, "i string, k string", S.fingerprint("i", "k"), S.trade_key(F.col("i"), F.lit("print")), S.hash_sample(F.col("k")))
    for (i, k), (f, t, s) in zip(rows, got, strict=True):
        assert f == hashlib.sha256(f"{i or ''}\x1f{k}".encode()).hexdigest()
        assert t == (i or "print")
        assert s == (int(hashlib.sha256(k.encode()).hexdigest()[:16], 16) % 4 < 1)


@pytest.mark.parametrize("ppm", [1, 250_000, 999_999, 1_000_000])
def test_admission_by_text_order(spark, ppm):
    rows = [(str(i),) for i in range(2000)]
    got = values(spark, rows, "k string", S.random_rank(3, F.lit("c"), F.col("k")), S.admitted(S.random_rank(3, F.lit("c"), F.col("k")), ppm))
    for (k,), (rank, ok) in zip(rows, got, strict=True):
        assert rank == hashlib.sha256(f"3:c:{k}".encode()).hexdigest()
        assert ok == (int(rank, 16) * 1_000_000 < ppm << 256)


def test_short_horizon_markets(spark):
    rows = [("btc-updown-5m-17", "", None, None), ("x", "Bitcoin up or down?", 0, 300), ("x", "Bitcoin Up / Down", 0, 601), ("eth-up-or-down-5m", "", None, None), (None, None, None, None)]
    got = values(spark, rows, "s string, t string, a long, b long", S.short_horizon_evidence([F.col("s")], [F.col("t")], F.col("a"), F.col("b")))
    assert [r[0] for r in got] == ["slug", "title_and_duration", None, "slug", None]


def test_categories(spark):
    rows = [("Tech news", "pop-culture"), ("the Fed", "Sports "), ("plain", "nothing"), (None, None)]
    got = values(spark, rows, "t string, c string", S.category_prior(F.col("t")), S.canonical_category(F.col("c")))
    assert got == [("high", "culture"), ("medium", "sports"), ("low", None), ("low", None)]


def test_score_at_the_edges(spark):
    row = (6 * 86400, 5, True, 5_000_000_000, 10_000, 250_000, 0, "high", 3)
    names = "age prior complete notional ratio price remaining category young".split()
    rows = [row, (7 * 86400, 6, True, 4_999_999_999, 9_999, 250_001, 7 * 86400 + 1, "medium", 2), (None, 0, False, 0, None, 300_000, -1, "low", None)]
    parts = S.score_components(*[F.col(n) for n in names])
    got = values(spark, rows, "age long, prior long, complete boolean, notional long, ratio long, price long, remaining long, category string, young int", S.score_of(parts), S.score_bucket(S.score_of(parts)))
    assert got == [(16, "high"), (7, "medium"), (0, "low")]


def fill(asks, budget):
    left, cost, shares = budget, 0, 0
    for p, z in sorted(asks):
        whole = p * z // 10**6
        n = z if whole <= left else left * 10**6 // p if p else 0
        c = p * n // 10**6
        left, cost, shares = left - c, cost + c, shares + n
        if left <= 1:
            break
    return cost * 10**6 // shares if left <= 1 and shares else None


def test_book_fills_against_a_walk(spark):
    random.seed(2)
    books = [[(random.randrange(10_000, 990_000, 10_000), random.randrange(0, 400_000_000)) for _ in range(random.randrange(0, 12))] for _ in range(300)]
    kind = "a array<struct<price:long,size:long>>"
    got = values(spark, [(b,) for b in books], kind, *[book.average_fill(book.sorted_asks(F.col("a")), n * 10**6) for n in (100, 500)], book.depth_within(F.col("a"), 10_000))
    for b, (x, y, depth) in zip(books, got, strict=True):
        assert (x, y) == (fill(b, 100 * 10**6), fill(b, 500 * 10**6))
        assert depth == (sum(z for p, z in b if p <= min(b)[0] + 10_000) if b else None)


def test_titles_fold_compatibility_forms(spark):
    rows = [("Ｆｕｌｌ  width! ﬁt",), ("plain Title",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", S.normal_title(F.col("t")))] == ["full width fit", "plain title", None]


def test_books_from_levels_and_back(spark):
    rows = [(1, "ask", 30, 1), (1, "ask", 28, 1000), (1, "bid", 20, 5), (1, "bid", 25, 6), (2, "bid", 9, 9)]
    books = book.of_levels(spark.createDataFrame(rows, "k int, side string, price long, size long"), "k", "side", "price", "size")
    got = {(r.k, r.side, r.level_number): (r.price_ppm, r.size_microshares) for r in book.levels(books, "k").collect()}
    assert got == {(1, "ask", 0): (28, 1000), (1, "ask", 1): (30, 1), (1, "bid", 0): (25, 6), (1, "bid", 1): (20, 5), (2, "bid", 0): (9, 9)}


def test_cosines_are_rounded_once(spark, tmp_path):
    import __spark_entry__ as e

    # 0.7454995...: millionths would be 745500, which ends at 746000.
    rows = [(1, [11.0, -5.0]), (2, [16.0, 5.0]), (4, []), (5, []), (7, [0.0, 0.0]), (8, [1.0, 0.0]), (10, [3.0, 4.0]), (11, [-3.0, -4.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(duck.execute(e.oracle_sql()["b30_b31_vectors"]).fetchall())
    assert want[0] == (1, 12.08305, 745000)
    assert sorted(tuple(r) for r in e.queries()["b30_b31_vectors"](spark, str(tmp_path)).collect()) == want
