"""Words of byte classes: runs of word bytes in many texts at once, as arrays of spans and as Arrow values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Kinds of bytes: in a word, between words, between pieces of text.
WORD, GAP, BREAK = 1, 0, 2


def byte_kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """A table from byte to kind: these bytes lie between words, those between pieces, all others in words."""
    kinds = np.full(256, WORD, np.uint8)
    kinds[list(gaps)] = GAP
    kinds[list(breaks)] = BREAK
    return kinds


#: Digits, letters and all beyond ASCII make words, once A-Z are lower-cased.
ALNUM = byte_kinds(bytes(b for b in range(128) if not chr(b).isalnum()))


def runs_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of set bytes; runs never cross rows."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:n]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def values_of(data: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs as an array of byte strings."""
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[mask]))])


def raw_values(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of byte strings without nulls."""
    values = values.cast(pa.large_binary())
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    whole = values.buffers()[2] if len(values) else None
    data = np.frombuffer(whole, np.uint8)[at[0] : at[-1]] if whole is not None and whole.size else np.zeros(0, np.uint8)
    return data, at - at[0]


def from_raw(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def picked(values: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of the chosen values."""
    data, at = raw_values(values.take(pa.array(rows)))
    return data, np.diff(at).astype(np.uint32)
