"""Helpers shared by the operators: scratch tables, checked broadcasts, Arrow text buffers."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.session import ensure_checkpoint_dir, scratch_path

# A table of a few fixed-width columns is broadcast up to this many rows (about
# 64 bytes each in a hash relation); beyond it Spark shuffles.
BROADCAST_ROWS = 400_000
# Text handled by one numpy step (its temporaries are some 40 bytes per byte).
PIECE_BYTES = 1 << 17

# Words split at these bytes: space, tab, newline, vertical tab, form feed, return.
SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]


# Texts in one Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Set up the checkpoint folder, and lower the session's Arrow batch limit to BATCH_BYTES.

    Batches of long texts are limited by rows and 64 MB otherwise, several times per worker.
    """
    ensure_checkpoint_dir(spark)
    held = re.match(r"-?\d+", spark.conf.get(_LIMIT) or "")
    if not held or not 0 < int(held[0]) <= BATCH_BYTES:
        spark.conf.set(_LIMIT, BATCH_BYTES)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, and every reader prunes columns.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` (fixed-width columns only) for broadcast if it has at most ``limit`` rows.

    ``df`` should be cheap to count (a written table).  Otherwise the join stays with
    Catalyst: a shuffle with adaptive skew splitting.
    """
    if rows is None:
        rows = df.count()
    return F.broadcast(df) if rows <= limit else df


def with_text(df: DataFrame, text_col: str) -> tuple[DataFrame, int, int]:
    """``df`` with a string column at the returned position, and how many columns were added.

    A column that is a string already is used as it is, so no text travels twice.
    """
    if df.schema[text_col].dataType.simpleString() == "string":
        return df, df.columns.index(text_col), 0
    name = fresh("text", df.columns)
    return df.withColumn(name, df[text_col].cast("string")), len(df.columns), 1


def slices(batches, rows: int = 1000):
    """The batches in slices of at most ``rows`` rows, which bounds what Python holds as objects."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, columns) -> str:
    """A column name that clashes with none of ``columns`` (case-insensitively)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_pieces(column: pa.ChunkedArray | pa.Array, limit: int = PIECE_BYTES):
    """Yield ``(first_row, data, starts, ends)`` for runs of rows of a string column.

    ``data`` is the run's UTF-8 as uint8; ``starts``/``ends`` are byte offsets of each
    row in it.  Null rows are empty.  A run holds at most ``limit`` bytes, or one row.
    """
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for arr in chunks:
        if len(arr) == 0:
            continue
        arr = arr.cast(pa.large_string())
        if arr.null_count:
            arr = arr.fill_null("")
        _, off, data = arr.buffers()
        offsets = np.frombuffer(off, np.int64)[arr.offset:arr.offset + len(arr) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(arr):
            j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
            j = min(max(j, i + 1), len(arr))
            base = offsets[i]
            yield row + i, raw[base:offsets[j]], offsets[i:j] - base, offsets[i + 1:j + 1] - base
            i = j
        row += len(arr)


def word_spans(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray):
    """Byte spans of the words of all rows: ``(word_start, word_end, row_of_word)``."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = is_word[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    cuts = starts[(starts > 0) & (starts < len(data))]
    first[cuts] = w[cuts]
    last[cuts - 1] = w[cuts - 1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(starts, s, "right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words with A-Z as a-z, vectorized over a buffer.

    ``hash(word) = mix(sum_i T[i, byte_i] + length)`` with a table T of random numbers for
    every place up to PLACES and every byte; longer words take a BLAKE2b digest.  Two
    different words share a hash with a chance of about 2**-64, whatever their letters.
    """

    PLACES = 64

    def __init__(self):
        table = np.random.default_rng(20240607).integers(0, 2**64, (self.PLACES, 256), dtype=np.uint64)
        table[:, 65:91] = table[:, 97:123]          # A-Z as a-z
        self.table = table.ravel()
        self.lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

    def hashes(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.empty(len(s), np.uint64)
        size = e - s
        for k in np.flatnonzero(size > self.PLACES):
            word = data[s[k]:e[k]].tobytes().translate(self.lower)
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        short = np.flatnonzero(size <= self.PLACES)
        s, size = s[short], size[short]
        ends = np.cumsum(size)
        i = 0
        while i < len(s):
            # words of PIECE_BYTES together
            j = max(int(np.searchsorted(ends, ends[i] - size[i] + PIECE_BYTES, "right")), i + 1)
            begin = ends[i:j] - size[i:j] - (ends[i] - size[i])
            place = np.arange(ends[j - 1] - ends[i] + size[i]) - np.repeat(begin, size[i:j])
            byte = data[place + np.repeat(s[i:j], size[i:j])]
            sums = np.add.reduceat(self.table[(place << 8) | byte], begin)
            out[short[i:j]] = mix64(sums + size[i:j].astype(np.uint64))
            i = j
        return out
