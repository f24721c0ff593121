"""Texts of an Arrow batch as byte arrays, and word hashes over them.

Work goes in chunks of whole documents of about `CHUNK` bytes, so that memory in a task follows the
chunk (or the longest document) and not the batch. A null text counts as empty everywhere.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

import eventide

CHUNK = 1 << 18
BATCH_BYTES = 8 << 20
_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
_powers = {P: np.ones(1, np.uint64), P_INV: np.ones(1, np.uint64)}


def map_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """`mapInArrow` whose workers find this package where the driver has it, in batches of a few MB
    however long the texts are. That limit is set in the session for good, unless a smaller one holds."""
    session = df.sparkSession
    if size_of(session.conf.get(_BYTES_KEY)) > BATCH_BYTES:
        session.conf.set(_BYTES_KEY, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.abspath(eventide.__file__)))
    paths = session.sparkContext.environment
    if root not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths.get("PYTHONPATH", "")]))

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return what a task has freed to the system, as workers live on and the next stage needs it."""
    pa.default_memory_pool().release_unused()
    for table in _powers:
        _powers[table] = np.ones(1, np.uint64)
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def size_of(setting: str) -> int:
    """Bytes of a size such as 8388608, 64m or 1gb."""
    digits = setting.strip().lower().rstrip("b")
    unit = digits[-1:] if digits[-1:] in "kmgt" else ""
    return int(digits.rstrip("kmgt")) << (10 * (" kmgt".index(unit) if unit else 0))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if len(_powers[base]) < n:
        table = np.full(max(n, CHUNK + 1024), base, np.uint64)
        table[0] = 1
        _powers[base] = np.cumprod(table)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and len + 1 offsets into them."""
    column = pc.fill_null(column.cast(pa.string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets) of runs of whole documents."""
    data, offs = text_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


class Spans:
    """Words of a chunk: byte ranges, 64-bit hashes, and the row each belongs to."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray,
                 lower: np.ndarray | None = None):
        n = len(data)
        self.rows = len(offs) - 1
        full = offs[:-1][offs[:-1] < offs[1:]]
        mask = is_word[data]
        edge = mask.copy()
        edge[1:] &= ~mask[:-1]
        edge[full] = mask[full]
        self.start = np.flatnonzero(edge)
        last = mask
        tail = (offs[1:] - 1)[offs[:-1] < offs[1:]]
        keep = mask[tail].copy()
        last[:-1] &= ~mask[1:]
        last[tail] = keep
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offs)
        self.per_row = np.diff(self.bounds)
        self.row = np.repeat(np.arange(self.rows), self.per_row)
        self.text = data if lower is None else lower[data]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * powers(P, n), out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * powers(P_INV, n + 1)[self.start]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of n words within one row."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.row[:m] == self.row[n - 1:])
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h *= np.uint64(P)
            h += self.hash[k:k + m]
        return first, mix(h[first])

    def words(self, first: int, n: int) -> bytes:
        """n words from `first` on, parted by one space."""
        return b" ".join(self.text[self.start[i]:self.end[i]].tobytes()
                         for i in range(first, first + n))


def byte_class(pieces: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in pieces:
        table[lo:hi + 1] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# After lower-casing: digits, a-z and every byte of a non-ASCII character. Upper case is listed too,
# as the class is looked up on the bytes as they stand.
ALNUM = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
