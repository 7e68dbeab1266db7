"""Nearest neighbours by a block matrix join with int8 product tiles.

Vectors are packed into blocks. Query blocks and candidate blocks are dealt out over a grid of cells, each block to one
row or column of cells, so that a cell holds a bounded number of blocks. In a cell, tiles of int8 products give each
inner product with a bound on its quantisation error; pairs whose upper bound is below the query's current k-th best are
dropped, the others are computed anew in double precision, and a tile's best are kept for each query. The cells' sorted
lists are merged by a heap while they stream by query. The bounds are strict, so the result is exact. Vectors travel in
the table's own precision; their int8 form is made in the cell.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors of
the same dimension meet; ties go to the smaller id; rows with a repeated id are candidates of their own, but never of a
query with that id, and such an id asks once, with its least vector; other columns are dropped. Memory follows the block size, not the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick

BLOCK = 2048
#: Blocks of queries and of candidates in a cell, about.
CELL = 8
#: Slack of the float32 tile for vectors scaled to length 1 at most.
SLACK = 1e-5
_PACKED = "block long, dim int, ids binary, vectors binary, wide boolean"
#: Blocks that a packing task makes, about; their number follows the table.
BLOCKS_A_TASK = 4


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[int, np.ndarray]]] = {}

    def block(dim: int) -> pa.RecordBatch:
        rows = held.pop(dim)
        ids = np.array([i for i, _ in rows], "<i8")
        return pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.stack([v for _, v in rows]).tobytes()], pa.binary()), pa.array([rows[0][1].dtype == np.float64])], names=["block", "dim", "ids", "vectors", "wide"])

    for batch in batches:
        vectors = batch.column("v")
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
        for i, end, start in zip(batch.column("id").to_pylist(), ends, np.concatenate([[0], ends[:-1]]), strict=True):
            dim = int(end - start)
            held.setdefault(dim, []).append((i, values[start:end].astype("<f4" if values.dtype == np.float32 else "<f8")))
            if len(held[dim]) == BLOCK:
                yield block(dim)
    for dim in list(held):
        yield block(dim)


class _Block:
    """Vectors with their int8 form: unit = scale * codes + error, where unit is at most of length 1."""

    def __init__(self, ids: bytes, vectors: bytes, wide: bool, dim: int) -> None:
        self.ids = np.frombuffer(ids, "<i8")
        self.vectors = np.frombuffer(vectors, "<f8" if wide else "<f4").reshape(-1, dim).astype(np.float64)
        top = np.abs(self.vectors).max(axis=1)
        self.norms = top * np.sqrt(((self.vectors / top[:, None]) ** 2).sum(axis=1))

    def quantise(self, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        unit = self.vectors / norms[:, None]
        scale = np.maximum(np.abs(unit).max(axis=1) / 127, 1e-30)
        codes = np.rint(unit / scale[:, None]).astype(np.int8)
        near = scale[:, None] * codes
        return codes, scale.astype(np.float32), np.sqrt(((unit - near) ** 2).sum(axis=1)).astype(np.float32), np.sqrt((unit**2).sum(axis=1)).astype(np.float32)


def tile(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Inner products from int8 codes, and bounds of their errors.

    Sums of products of codes are whole numbers below 2^24 up to 1040 dimensions, so float32 holds them exactly.
    """
    kind = np.float32 if q[0].shape[1] <= 1040 else np.float64
    product = (q[0].astype(kind) @ c[0].T.astype(kind)).astype(np.float32, copy=False)
    product *= q[1][:, None]
    product *= c[1]
    # <x, y> - <x', y'> = <x', y - y'> + <x - x', y>, with |x'| <= |x| + |x - x'|
    return product, (q[3] + q[2])[:, None] * c[2] + q[2][:, None] * c[3] + np.float32(SLACK)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the components."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    dim = int(queries["dim"].iloc[0])
    blocks = [_Block(*x, dim) for x in candidates[["ids", "vectors", "wide"]].itertuples(index=False)]
    tiles = [(b, b.norms.max(), b.quantise(np.full(len(b.ids), b.norms.max()))) for b in blocks]
    for ids, vectors, wide in queries[["ids", "vectors", "wide"]].itertuples(index=False):
        q = _Block(ids, vectors, wide, dim)
        coded = q.quantise(q.norms)
        best = _Best(len(q.ids), k)
        least = best.least
        for b, top, c in tiles:
            near, error = tile(coded, c)
            own = q.ids[:, None] == b.ids
            with np.errstate(all="ignore"):
                floor = least / (q.norms * top)
                if len(b.ids) > k and np.isneginf(least).any():
                    # The k-th largest lower bound is a floor too; one more, as the query's own row may be among them.
                    low = np.where(own, -np.inf, near - error)
                    floor = np.fmax(floor, np.partition(low, -k, axis=1)[:, -k] - SLACK)
                rows, columns = np.nonzero(~(near + error < floor[:, None]) & ~own)
            for s in range(0, len(rows), 1 << 18):
                r, j = rows[s : s + (1 << 18)], columns[s : s + (1 << 18)]
                best.add(r, exact(q.vectors[r], b.vectors[j]), b.ids[j])
        yield from best.lists(q.ids)


class _Best:
    """The k best (score, id) of each row, by sorting what comes with what is there: a tile of ties costs no more than its sort."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.rows, self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        rows, scores, ids = np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.rows, self.scores, self.ids = rows[keep], scores[keep], ids[keep]
        last = place[keep] == self.k - 1
        self.least[self.rows[last]] = self.scores[last]

    def lists(self, names: np.ndarray) -> Iterator[tuple[int, list[tuple[float, int]]]]:
        at = np.searchsorted(self.rows, np.arange(len(names) + 1))
        for i, name in enumerate(names.tolist()):
            yield name, list(zip(self.scores[at[i] : at[i + 1]].tolist(), (-self.ids[at[i] : at[i + 1]]).tolist(), strict=True))


def nearest(df: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """The k rows of the largest inner product for each row that meets ``query`` (a condition on the column "id").

    Returns query_id long, rank int from 1, vec_id long, score double.
    """
    rows = pick(df, id=id_col, v=vector_col).where(
        F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    ).select(F.col("id").cast("long").alias("id"), "v")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(query).alias("q")).first()
    across, down = (max(1, -(-x // (cell * block))) for x in (counts["q"], counts["n"]))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    # Few enough tasks that their blocks are full, and as many as the table needs.
    packed = lambda x, n: x.repartition(max(1, -(-n // (BLOCKS_A_TASK * block))), "id").mapInArrow(_pack, _PACKED)
    columns = packed(rows, counts["n"]).withColumn("down", dealt(down)).withColumn("across", grid(across))
    asked = packed(rows.where(query).groupBy("id").agg(F.min("v").alias("v")), counts["q"]).withColumn("across", dealt(across)).withColumn("down", grid(down))

    def cell_of(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = list(_search(queries.to_pandas(), candidates.to_pandas(), k)) if queries.num_rows and candidates.num_rows else []
        columns = [pa.array([i for i, _ in found], pa.int64()), pa.array([[-x for _, x in h] for _, h in found], pa.list_(pa.int64())), pa.array([[s for s, _ in h] for _, h in found], pa.list_(pa.float64()))]
        return pa.table(columns, names=["query_id", "ids", "scores"])

    key = ["dim", "down", "across"]
    lists = columns.groupBy(key).cogroup(asked.groupBy(key)).applyInArrow(cell_of, "query_id long, ids array<long>, scores array<double>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(i: int, parts: list) -> pa.RecordBatch:
            top = [x for x, _ in zip(heapq.merge(*parts), range(k), strict=False)]
            return pa.RecordBatch.from_arrays([pa.array([i] * len(top), pa.int64()), pa.array(range(1, len(top) + 1), pa.int32()), pa.array([x for _, x in top], pa.int64()), pa.array([-s for s, _ in top], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        now, parts = None, []
        for batch in batches:
            for i, ids, scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i != now and parts:
                    yield best(now, parts)
                    parts = []
                elif len(parts) > 64:
                    parts = [[x for x, _ in zip(heapq.merge(*parts), range(k), strict=False)]]
                now = i
                parts.append([(-s, x) for s, x in zip(scores, ids, strict=True)])
        if parts:
            yield best(now, parts)

    return lists.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
