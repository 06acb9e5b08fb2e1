"""Words and their hashes of many texts at a time, as numpy arrays over UTF-8 bytes.

A batch is cut into chunks of about CHUNK bytes of whole texts (one longer text is a
chunk of its own), so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def is_space() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def process_memo() -> dict:
    """What a Python worker keeps from task to task."""
    import sys
    import types

    return sys.modules.setdefault("_faultlens_memo", types.ModuleType("_faultlens_memo")).__dict__


def scramble(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bijective scrambling of 128-bit values, each given as two halves."""
    a = a + mix(b ^ ODD[0])
    b = b ^ mix(a + ODD[1])
    a = a + mix(b + ODD[0])
    b = b ^ mix(a ^ ODD[1])
    return a, b


def combine(x: np.ndarray, y: np.ndarray, lane: int = 0) -> np.ndarray:
    """Names of ordered pairs of names."""
    return mix(x * ODD[lane] + mix(y ^ ODD[1 - lane]))


#: Spans up to so many bytes are named by a bijection of their bytes and length.
SHORT = 15


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of byte spans, as two halves: equal spans have equal names.

    A span of up to SHORT bytes is its own name, scrambled, so two of them never collide.
    A longer one is named by 120 bits of BLAKE2b.
    """
    size = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.ndarray(len(data) + 9, "<u8", padded.tobytes(), 0, (1,))
    ones = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    a = word[starts] & ones[np.minimum(size, 8)]
    b = word[np.minimum(starts + 8, len(data))] & ones[np.clip(size - 8, 0, 7)]
    b |= np.minimum(size, SHORT).astype(np.uint64) << U(56)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw = memoryview(padded)
        digests = b"".join(blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        both = np.frombuffer(digests, "<u8").reshape(-1, 2)
        a[long], b[long] = both[:, 0], both[:, 1] | U(0xFF << 56)
    return scramble(a, b)


class Chunk:
    """Some rows of a batch: their texts' bytes and where words stand in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1
        self._words, self._names = None, {}

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each text the index of its first word (n + 1 values)."""
        if self._words is None:
            data, off = self.data, self.offsets
            if not len(data):
                z = np.zeros(0, np.int64)
                self._words = (z, z, np.zeros(self.n + 1, np.int64))
            else:
                inside = ~is_space()[data]
                before = np.empty_like(inside)
                before[0] = False
                before[1:] = inside[:-1]
                cut = off[(off > 0) & (off < len(data))]
                before[cut] = False
                after = np.empty_like(inside)
                after[-1] = False
                after[:-1] = inside[1:]
                after[cut - 1] = False
                starts = np.flatnonzero(inside & ~before)
                ends = np.flatnonzero(inside & ~after) + 1
                self._words = (starts, ends, np.searchsorted(starts, off))
        return self._words

    def span_names(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return span_names(self.data, starts, ends)

    def word_names(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the words, as two halves; lower: of the words with A-Z lower-cased."""
        if lower not in self._names:
            starts, ends, _ = self.words()
            self._names[lower] = span_names(lowered(self.data) if lower else self.data, starts, ends)
        return self._names[lower]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Returns freed memory to the system, at most once a second: a worker lives on between stages."""
    import ctypes
    import time

    memo = process_memo()
    if time.monotonic() < memo.get("given", 0.0) + 1:
        return
    memo["given"] = time.monotonic()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(column: pa.Array, limit: int = CHUNK):
    """Chunks of a string column, in order."""
    data, off = text_buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield Chunk(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j
    give_back()


def rows_of(counts_from: np.ndarray) -> np.ndarray:
    """Row number of each item, given each row's first item (n + 1 values)."""
    return np.repeat(np.arange(len(counts_from) - 1), np.diff(counts_from))


def windows(names: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Names of every k consecutive values; window i covers values i to i + k - 1.

    Names of 1, 2, 4, ... values are pairs of names; a window is made of those that k's bits say.
    """
    n = len(names) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, level, width = None, 0, names, 1
    while at < k:
        if k & width:
            part = level[at : at + n]
            out = part if out is None else combine(out, part, lane)
            at += width
        if at < k:
            level = combine(level[:-width], level[width:], lane)
            width *= 2
    return combine(out, np.full(n, k, np.uint64), lane)


def window_ok(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which windows of k items lie in one row; first: each row's first item (n + 1 values)."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    row = rows_of(first)
    return row[:n] == row[k - 1 :]


def join_words(chunk: Chunk, keep: np.ndarray, row: np.ndarray | None = None, n: int | None = None, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each text joined by one space, as bytes and offsets; one more space follows each text.

    row and n: of another division of the words into n rows; data: other bytes at the same places.
    """
    starts, ends, first = chunk.words()
    row = (rows_of(first) if row is None else row)[keep]
    data = chunk.data if data is None else data
    s, e = starts[keep], ends[keep]
    size = e - s + 1
    put = np.zeros(len(s) + 1, np.int64)
    np.cumsum(size, out=put[1:])
    out = np.full(put[-1], 32, np.uint8)
    if len(s):
        at = np.arange(put[-1]) - np.repeat(put[:-1] - s, size)
        last = np.zeros(put[-1], bool)
        last[put[1:] - 1] = True
        out[~last] = data[at[~last]]
    firsts = np.searchsorted(row, np.arange((chunk.n if n is None else n) + 1))
    return out, put[firsts]
