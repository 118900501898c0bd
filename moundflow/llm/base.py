"""Helpers shared by the text operators: row keys, Arrow batches as byte
arrays, words as vectors of offsets and hashes.

All per-text work runs on NumPy arrays over about ``BATCH_BYTES`` of text at a
time, so a Python worker's memory follows that size (or the longest single
text), never the partition."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundflow.session import ensure_checkpoint_dir

BATCH_BYTES = 1 << 18
U64 = np.uint64


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table (compressed Parquet) in the shared folder
    that the cluster names in ``spark.checkpoint.dir``, so a lost executor costs
    a re-read and not a recomputation.  Like checkpoints the tables stay until
    that folder is cleared."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/moundflow-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared(df: DataFrame, value):
    """Broadcast a small object of this package; returns a function that gives
    it in a task.  Only its attributes travel (the workers load them once), so
    executors need no installed copy of the package."""
    state, kind = df.sparkSession.sparkContext.broadcast(vars(value)), type(value)

    def get():
        out = object.__new__(kind)
        out.__dict__ = state.value
        return out

    return get


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """A never-null 128-bit key of a (doc_id, text) row: r1, r2.  Equal rows
    share it (all results here depend on the row's content only), rows that
    share only the doc_id do not."""
    return [F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(text, doc_id, F.lit(7)).alias("r2")]


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and text columns, under fixed names: other columns, however
    they are called, cannot clash with what an operator adds."""
    return df.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))


def free(df: DataFrame, stem: str) -> str:
    """``stem``, or with more underscores before it, as a column name that the
    frame does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def named(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """The frame with its columns named c0, c1, ...: Python tasks take names
    with dots or twice the same only so; ``toDF(*names)`` undoes it."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


# --- Arrow batches -----------------------------------------------------------

def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into slices of about ``limit`` text bytes (one text at
    least); yields (slice, UTF-8 bytes, offsets); null texts are empty."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
        off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
        data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
            j = min(n, max(j, i + 1))
            yield batch.slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i]
            i = j


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema)


# --- hashing -----------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (vectorised, wraps)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Rolling:
    """Hash of any run of symbols from one prefix sum: sum(v[j] * B**j) over
    the run, times B**-start, modulo 2**64 (B odd, so it has an inverse)."""

    def __init__(self, base: int):
        self.base, self.inv = U64(base | 1), U64(pow(base | 1, -1, 1 << 64))
        self.pow = self.ipow = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, 4 * BATCH_BYTES)
            with np.errstate(over="ignore"):
                self.pow = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, self.base, U64))])
                self.ipow = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, self.inv, U64))])

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.multiply(values, self.pow[:len(values)], out=out[1:])
        np.cumsum(out[1:], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.ipow[start])

    def raw_grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Unmixed hashes of all runs of k symbols, by start (high bits are good)."""
        n = max(0, len(prefix) - k)
        out = prefix[k:] - prefix[:n]
        out *= self.ipow[:n]
        return out

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k symbols, by start."""
        return mix(self.raw_grams(prefix, k))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


# --- words -------------------------------------------------------------------

def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes in any of the (first, last) ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a:b + 1] = True
    return t


#: Bytes of words ``[^\x20\x09-\x0D]+``; the separators are ASCII, so bytes decide.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM_LOWER = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def spans(member: np.ndarray, off: np.ndarray, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set bytes that do not cross texts (nor positions where
    ``split`` is set): starts, ends, and the first run of each text
    (len(texts) + 1)."""
    n = len(member)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    cut[0] = cut[n] = True
    if split is not None:
        cut[:n] |= split
    cut[1:n] |= member[1:] != member[:-1]
    s = np.flatnonzero(member & cut[:n])
    e = np.flatnonzero(member & cut[1:]) + 1
    return s, e, np.searchsorted(s, off)


class Words:
    """Words of a slice of texts: byte starts ``s`` and ends ``e``, first word
    of each text ``off``, and 64-bit hashes ``h``."""

    _roll = Rolling(0x9E3779B97F4A7C15)

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray = NOT_SPACE, hashes: bool = True):
        self.s, self.e, self.off = spans(table[data], off)
        if hashes:
            p = self._roll.prefix(BYTE_VALUE[data])
            self.h = self._roll.runs(p, self.s, self.e)

    def __len__(self):
        return len(self.s)

    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def owner(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix count of code points (bytes that start a character)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values by text, from their prefix sums."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]
