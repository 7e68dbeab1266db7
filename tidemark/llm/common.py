"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import cut, scope, shared_folder  # noqa: F401  (the operators take them from here)

#: Bytes of text handled at a time inside a Python worker; a longer single text is walked in pieces of this size.
CHUNK_BYTES = 2 << 20
#: Rows handled at a time inside a Python worker.
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Batches of Spark's default size hold tens of MB of texts, several times over; a size that was chosen stays.

    It is a setting of the session, as a returned DataFrame is planned by whoever runs it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ROWS))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Just these columns, found by their exact names and renamed to the keywords.

    Other columns are dropped, whatever their names; a name that differs only in case does not clash.
    """
    bounded_batches(df.sparkSession)
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{names.index(c)}").alias(a) for a, c in columns.items()])


def numbered_columns(df: DataFrame, text: str) -> tuple[DataFrame, str, list[str]]:
    """df under the names c0, c1, ..., with the new name of one column and the old names: nothing that is added can clash."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index(text)}", names


def portions(batch: pa.RecordBatch, text: str | int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ROWS rows and, unless a single text is longer, CHUNK_BYTES of text."""
    column = batch.column(text)
    n = batch.num_rows
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    i = 0
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, side="right")) - 1), i + ROWS, n)
        yield batch.slice(i, j - i)
        i = j


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Elements that sums_before adds up at a time.
_RUN = 256


def sums_before(values: Column) -> Column:
    """array<bigint>: for each element of an array the sum of those before it.

    The array is cut into runs, as an array that grows by one element is copied each time: n x _RUN steps instead of n x n.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    add = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out"))
    running = lambda xs: F.aggregate(xs, start, add)
    runs = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int")), lambda b: running(F.slice(v, b * _RUN + 1, F.lit(_RUN))))
    ahead = lambda r: running(F.transform(r, lambda x: x["sum"]))["out"]
    whole = let(values, lambda v: let(runs(v), lambda r: F.flatten(F.zip_with(r, ahead(r), lambda x, h: F.transform(x["out"], lambda y: y + h)))))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The texts of a column as UTF-8; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for x in column.cast(kind):
        yield x.as_py() or b""


def crc_remainder(column: str, n: int):
    """crc32(id as text) mod n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


WHITE = b" \t\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WHITE)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_ODD_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))


class _Powers:
    """_ODD ** i and its inverse, for i as far as needed so far."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(int(_ODD), k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(int(_ODD_INV), k, 1 << 64))])
        return cls.up[:n], cls.down[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie in one buffer: the hashes, and each word's text.

    A word is a run of bytes other than the six ASCII white-space bytes; A-Z count as a-z if ``lower``.
    The texts are given by ascending, non-overlapping byte ranges. A long buffer is walked in pieces that end between words,
    so memory follows the piece and the number of words. The hash is a polynomial modulo 2^64 over mixed bytes: words of
    hundreds of bytes can be made to collide on purpose, and words are not compared beyond their hashes.
    """
    if not len(data) or not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(data) > 2 * CHUNK_BYTES:
        found, a = [], 0
        while a < len(data):
            b = min(a + CHUNK_BYTES, len(data))
            if b < len(data):
                white = np.flatnonzero(_SPACE[data[a:b]])
                while not len(white) and b < len(data):  # a word longer than a piece
                    b = min(b + CHUNK_BYTES, len(data))
                    white = np.flatnonzero(_SPACE[data[a:b]])
                b = a + int(white[-1]) + 1 if len(white) and b < len(data) else b
            found.append(_word_hashes(data[a:b], np.clip(starts, a, b) - a, np.clip(ends, a, b) - a, lower))
            a = b
        return np.concatenate([h for h, _ in found]), np.concatenate([r for _, r in found])
    return _word_hashes(data, starts, ends, lower)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = starts[(starts < len(data)) & (starts < ends)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (starts < ends)] - 1
    last[cuts] = inside[cuts]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * up[:-1], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s]), np.searchsorted(starts, s, side="right") - 1


def texts_in(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts of a column of about CHUNK_BYTES: first row, end row, buffer, starts and ends of the texts in it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    if not n:
        return
    kind, wide = (np.int64, pa.large_binary()) if pa.types.is_large_string(column.type) else (np.int32, pa.binary())
    column = column.cast(wide).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i]
        i = j
