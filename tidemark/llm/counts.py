"""Counts of 64-bit keys over all texts, brought back to where the texts are.

Texts are dealt into chunks of a few MB by a hash of their id. Each chunk sends its distinct keys, sorted and packed, with
their counts to buckets of the key space; a bucket adds the counts up and answers each chunk with totals in the order the
keys came, so that the way back holds about a byte a key and no keys. A chunk and a bucket fit in a task's memory at any
size of the input, since their number grows with it; a frequent key is one entry for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk, and keys in a bucket, about.
CHUNK_TEXT = 4 << 20
BUCKET_KEYS = 1 << 20

SENT = "bucket int, chunk long, keys binary, counts binary"
SENT_NAMES = ["bucket", "chunk", "keys", "counts"]
ANSWER = "chunk long, bucket int, answer binary"


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences by byte planes: the planes of zeros compress away."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte a count; counts of 255 and more follow as long ones."""
    large = counts[counts >= 255].astype("<u8")
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    counts = np.frombuffer(packed, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed, "<u8", offset=8 + n)
    return counts


def borders(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the keys of each bucket begin in ascending keys; buckets are equal parts of the key space."""
    steps = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(steps, np.uint64)), [len(keys)]]).astype(np.int64)


def sent(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    at = borders(keys, buckets)
    full = np.flatnonzero(np.diff(at))
    return pa.table(
        [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([pack_keys(keys[at[b] : at[b + 1]]) for b in full], pa.binary()), pa.array([pack_counts(counts[at[b] : at[b + 1]]) for b in full], pa.binary())],
        names=SENT_NAMES,
    )


def received(table: pa.Table) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's entries: chunks, entries of each, the distinct keys, the place of each entry among them, its count."""
    chunks = table.column("chunk").to_pylist()
    keys = [unpack_keys(x.as_py()) for x in table.column("keys")]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return np.array(chunks), [len(x) for x in keys], distinct, place, np.concatenate([unpack_counts(x.as_py()) for x in table.column("counts")])


def dealt(chunks: int, *columns: str, first: int = 0):
    """The chunk of a row, by what is given: rows of one id meet only if nothing but the id is."""
    return F.pmod(F.xxhash64(*columns), F.lit(chunks)) + first


def text_bytes(df: DataFrame, *conditions) -> list[int]:
    """Bytes of all texts, and of those that meet each condition."""
    size = F.octet_length("text").cast("long")
    row = df.agg(F.coalesce(F.sum(size), F.lit(0)), *[F.coalesce(F.sum(F.when(c, size)), F.lit(0)) for c in conditions]).first()
    return list(row)


def parts(n: int, size: int) -> int:
    return max(1, -(-n // size))


def in_order(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    """The answers of a chunk by bucket."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist(), strict=True))
    yield from rows
