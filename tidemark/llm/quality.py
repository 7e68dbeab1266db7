"""Quality rules: base measures of each document, and lines that many documents of a host share.

Lines are normalised (A-Z as a-z, white space squeezed) and hashed. A line is boilerplate of a host if it stands in more
than ``max_docs`` documents of the host and in more than ``max_share`` of them. Boilerplate lines are taken out of the
documents; a document that loses too many of its words is depleted and rejected, and so is one that fails the base rules.

Defined results: a null or empty text has no words and fails the base rules; a null host is a host of its own; repeated
rows are separate documents; empty tables give empty results; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, cut, pick, portions, texts_in, word_hashes

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Texts of more words are searched for repeated windows by ranks in numpy, in less memory.
LONG = 100_000
SALTS = 16


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n <= LONG and len(set(zip(*[words[i:] for i in range(window)], strict=False))) == n:
        return 0
    codes: dict[bytes, int] = {}
    rank = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    size = 1
    while size < window:
        # Ranks of runs of twice the size (or of two that overlap, for the rest): equal ranks are equal runs.
        step = min(size, window - size)
        rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
        size += step
    counts = np.bincount(rank)
    starts = np.flatnonzero(counts[rank] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def _line_tables(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: row, hash of a normalised line, and its words; each line of a text once, with the words of all its copies."""
    for i, _, data, starts, ends in texts_in(column):
        hashes, text = word_hashes(data, starts, ends)
        if not len(hashes):
            continue
        # The number of line ends before each word tells its line.
        inside = data > 32
        inside |= ~((data == 32) | ((data >= 9) & (data <= 13)))
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = starts[starts < ends]
        first[cuts] = inside[cuts]
        line = np.cumsum(data == 10)[np.flatnonzero(first)]
        new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])]))
        size = np.diff(np.concatenate([new, [len(hashes)]]))
        place = np.arange(len(hashes)) - np.repeat(new, size)
        weight = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h = np.add.reduceat(hashes * weight, new) ^ size.astype(np.uint64)
        row = text[new]
        order = np.lexsort((h, row))
        h, row, size = h[order], row[order], size[order]
        keep = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
        yield row[keep] + i, h[keep].view(np.int64), np.add.reduceat(size, keep)


def measure(df: DataFrame) -> DataFrame:
    """(id, host, text) to (id, host, the base measures, lines array<struct<h, words>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                text = part.column("text")
                found = [measures(x) for x in as_bytes(text)]
                tables = list(_line_tables(text))
                row = np.concatenate([x[0] for x in tables]) if tables else np.zeros(0, np.int64)
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lines = pa.ListArray.from_arrays(
                    pa.array(offsets),
                    pa.StructArray.from_arrays(
                        [pa.array(np.concatenate([x[1] for x in tables]) if tables else [], pa.int64()), pa.array(np.concatenate([x[2] for x in tables]) if tables else [], pa.int64())], ["h", "words"]
                    ),
                )
                columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("host"), *columns, lines], names=["id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(run, f"id {kinds['id']}, host {kinds['host']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h: long, words: long>>")


def line_frequency_filter(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 20,
    max_share: float = 0.10,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_left_share: float = 0.5,
) -> DataFrame:
    """One row per document: the base measures, base_failed, words in boilerplate lines (n_removed_words), depleted, kept.

    A document is depleted if boilerplate was removed and fewer than ``min_words`` words or less than ``min_left_share``
    of its words are left. The texts are read once; the rest works on line hashes. Lines are counted with partial sums
    before the shuffle, and the frequent ones meet the documents' lines under salted keys, so no line is a hot key.
    """
    base = cut(measure(pick(df, id=id_col, host=host_col, text=text_col)).withColumn("row", F.monotonically_increasing_id()))
    host = F.coalesce(F.concat(F.lit("+"), F.col("host").cast("string")), F.lit("-"))
    lines = base.select("row", host.alias("host"), F.explode("lines").alias("x")).select("row", "host", "x.h", "x.words")
    hosts = base.groupBy(host.alias("host")).agg(F.count("*").alias("docs_of_host"))
    frequent = lines.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs)
    frequent = frequent.join(hosts, "host").where(F.col("docs") > max_share * F.col("docs_of_host")).select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    removed = lines.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))).join(frequent, ["host", "h", "salt"]).groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < min_words) | (left < min_left_share * F.col("n_words")))
    return (
        base.drop("lines")
        .join(removed, "row", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
        .select(
            F.col("id").alias(id_col), "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"), "n_removed_words", depleted.alias("depleted"), (~failed & ~depleted).alias("kept"),
        )
    )
