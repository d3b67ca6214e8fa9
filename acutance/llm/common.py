"""Helpers that several corpus operators share: text slices as byte arrays, hashes, size-checked joins."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acutance.session import materialise

#: The six separators, as a Java and Python pattern class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

#: A table of keys is broadcast only after its rows have been counted and are at most this many.
BROADCAST_ROWS = 300_000
#: Bytes of text that one numpy pass holds; a longer document is a pass of its own.
SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def trim() -> None:
    """Give freed memory back: Python workers live on after a task, beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function from batches to batches that gives its memory back at its end."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def keep_matching(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join with keys. keys is counted first: small ones are broadcast, others shuffle."""
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return df.join(keys, on, how)


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    while name.lower() in (c.lower() for c in df.columns):
        name = "_" + name
    return name


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: the file and row number of each row, by which rows of one key stay apart.

    Both are fixed by the files, however they are split into tasks and whichever executor reads them. Rows of a plain read
    of Parquet files, with columns chosen and rows filtered, are named as they stand; any other frame is written first.
    A column of docs may be called _metadata: it is renamed while Spark's own is read.
    """
    clash = [c for c in docs.columns if c.lower() == "_metadata"]
    if clash:
        other = fresh(docs, "_metadata")
        rows, at = located(materialise(docs.withColumnRenamed(clash[0], other), "located"))
        return rows.withColumnRenamed(other, clash[0]), at
    steps = docs._jdf.queryExecution().analyzed().toString().splitlines()
    if not all(re.match(r"[\s:+|-]*(Project|Filter|Relation|SubqueryAlias)\b", x) for x in steps) or "Relation" not in steps[-1] or "parquet" not in steps[-1]:
        docs = materialise(docs, "located")
    at = fresh(docs, "_at")
    return docs.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(at)), at


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about limit bytes: first row, end row, their UTF-8 bytes and the offsets of each row. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that aren't separators; runs never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def _power_table(name: str, step: int, n: int) -> np.ndarray:
    had = _powers.get(name)
    if had is None or len(had) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, step, np.uint64)
        steps[0] = 1
        had = _powers[name] = np.cumprod(steps)
    return had[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Polynomial hashes of any ranges of a byte array, from one prefix sum modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("up", _BASE, n), out=self.sums[1:])
        self.down = _power_table("down", _INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts])


class PrimeHash:
    """Polynomial hashes of any ranges of a byte array modulo 2^31 - 1, from one prefix sum.

    With a base that texts don't know, two different strings of n bytes agree with a probability of n / 2^31 at most, however
    they were made; modulo a power of two there is no such bound.
    """

    P = np.uint64((1 << 31) - 1)

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._table(base, n) % self.P, out=self.sums[1:])  # below 2^64 for 8 GB
        self.down = self._table(pow(base, -1, int(self.P)), n + 1)

    @classmethod
    def _table(cls, base: int, n: int) -> np.ndarray:
        name = f"prime {base}"
        had = _powers.get(name)
        if had is None or len(had) < n:
            had = np.ones(1, np.uint64)
            while len(had) < max(n, SLICE_BYTES + 1):
                had = np.concatenate((had, had * np.uint64(pow(base, len(had), int(cls.P))) % cls.P))
            for k in [k for k in _powers if k.startswith("prime ")][:-3]:
                del _powers[k]  # those of earlier runs
            had = _powers[name] = had.astype(np.uint32)
        return had[:n].astype(np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return ((self.sums[ends] - self.sums[starts]) % self.P * self.down[starts] % self.P).astype(np.uint32)


def sum_by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)
