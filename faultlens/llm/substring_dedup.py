"""Substring dedup by recompression.

A text is rewritten in rounds.  A round names every maximal run of one symbol, then every
pair of a left symbol followed by a right symbol (sides are a fixed bit of the name).
Names are hashes of what they stand for, so equal strings get equal names in every
document of the corpus without a naming shuffle.  With each symbol goes the stretch of
words that decides it; wherever that stretch occurs, so does the symbol.

There are as many rounds as a window of `window` words can be halved and still decide a
symbol alone as a rule (log2 of it, less one).  A window is anchored at the least symbol of
the highest round that it decides alone (if it decides none, it is its own anchor).  Equal windows have equal anchors, so a window can only be shared if its
anchor, with the words that decide it, is.  Shared anchors reveal the candidate windows;
these alone are then verified by names of 96 bits, which are built like the symbols, pair by
pair, over words whose own names are exact up to 15 bytes and BLAKE2b beyond; the smallest
document of each name wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, store
from . import chunktable as ct
from . import textarrays as ta

U = np.uint64
OUT = "doc_id long, n_words long, n_removed long, kept_text string"


class Symbols:
    """A parse: names, the words they span, and the words that decide them (end exclusive)."""

    def __init__(self, name, start, end, low, high, row, first):
        self.name, self.start, self.end, self.low, self.high, self.row, self.first = name, start, end, low, high, row, first

    def neighbours(self):
        """Whether the symbol before and after is of the same text."""
        same = self.row[1:] == self.row[:-1]
        no = np.zeros(1, bool)
        return np.concatenate([no, same]), np.concatenate([same, no])

    def runs(self) -> Symbols:
        """Each maximal run of one symbol becomes one; its neighbours decide it too."""
        before, _ = self.neighbours()
        again = before.copy()
        again[1:] &= self.name[1:] == self.name[:-1]
        at = np.flatnonzero(~again)
        last = np.append(at[1:], len(again)) - 1
        size = (last - at + 1).astype(np.uint64)
        name = self.name[at]
        name = np.where(size > 1, ta.mix(name * ta.ODD[0] + size), name)
        row = self.row[at]
        low = np.where(before[at], self.low[at - 1], self.first[row] - 1)
        nxt = np.minimum(last + 1, len(again) - 1)
        inner = (last + 1 < len(again)) & (self.row[nxt] == row)
        high = np.where(inner, self.high[nxt], self.first[row + 1] + 1)
        return Symbols(name, self.start[at], self.end[last], low, high, row, self.first)

    def pairs(self, salt: int) -> Symbols:
        """A left symbol and a right one after it become one."""
        before, after = self.neighbours()
        left = (ta.mix(self.name + U(salt)) & U(1)).astype(bool)
        opens = left & after
        opens[:-1] &= ~left[1:]
        closes = np.zeros_like(opens)
        closes[1:] = opens[:-1]
        at = np.flatnonzero(~closes)
        pair, is_left = opens[at], left[at]
        nxt, prev = np.minimum(at + 1, len(left) - 1), np.maximum(at - 1, 0)
        row = self.row[at]
        name = np.where(pair, ta.mix(self.name[at] * ta.ODD[0] + ta.mix(self.name[nxt]) * ta.ODD[1]), self.name[at])
        low = np.where(is_left, self.low[at], np.where(before[at], self.low[prev], self.first[row] - 1))
        high = np.where(is_left, np.where(after[at], self.high[nxt], self.first[row + 1] + 1), self.high[at])
        return Symbols(name, self.start[at], np.where(pair, self.end[nxt], self.end[at]), low, high, row, self.first)


def rounds(hashes: np.ndarray, first: np.ndarray, n: int):
    """The parses of all texts after each of n rounds; first: each text's first word (one value more)."""
    at = np.arange(len(hashes))
    s = Symbols(hashes, at, at + 1, at, at + 1, ta.rows_of(first), first)
    for k in range(n):
        s = s.runs().pairs(2 * k + 1)
        yield s


def stretches(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Names of stretches of words: of the two largest powers of two that cover one, and its length."""
    size = high - low
    out, level, k = np.zeros(len(low), np.uint64), hashes, 0
    while len(low):
        here = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
        out[here] = ta.combine(level[low[here]], level[high[here] - (1 << k)]) + size[here].astype(np.uint64)
        if not (size >= 2 << k).any():
            break
        level, k = ta.combine(level[: -(1 << k)], level[1 << k :]), k + 1
    return ta.mix(out)


def anchors(hashes: np.ndarray, first: np.ndarray, window: int):
    """For every window inside a text: (its first word, the key of its anchor)."""
    at = np.flatnonzero(ta.window_ok(first, window, len(hashes)))
    low, high = at.copy(), at + window
    parses = list(rounds(hashes, first, max(1, window.bit_length() - 2))) if len(at) else []
    todo = np.arange(len(at))
    for s in reversed(parses):
        a = np.searchsorted(s.low, at[todo], "left")
        size = np.searchsorted(s.high, at[todo] + window, "right") - a
        level, k = (ta.mix(s.name ^ ta.ODD[1]) & U(0xFFFFFFFF00000000)) | np.arange(len(s.name)).astype(np.uint64), 0
        while (size >= 1 << k).any():
            here = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            best = (np.minimum(level[a[here]], level[a[here] + size[here] - (1 << k)]) & U(0xFFFFFFFF)).astype(np.int64)
            low[todo[here]], high[todo[here]] = s.low[best], s.high[best]
            if not (size >= 2 << k).any():
                break
            level, k = np.minimum(level[: len(level) - (1 << k)], level[1 << k :]), k + 1
        todo = todo[size <= 0]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return at, stretches(hashes, low[new], high[new])[np.cumsum(new) - 1] if len(at) else np.zeros(0, np.uint64)


class Parsed:
    """One chunk's windows, their anchors' distinct keys and which windows have which."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, chunk: ta.Chunk, window: int):
        self.chunk, self.window = chunk, window
        self.first = chunk.words()[2]
        self.hashes, self.other = chunk.word_names()
        at, key = anchors(self.hashes, self.first, window)
        row = ta.rows_of(self.first)[at]
        fit = known[row]
        self.at, key, self.row = at[fit], key[fit], row[fit]
        self.ids = ids[self.row]
        self.keys, self.which = np.unique(key, return_inverse=True)

    def here(self) -> np.ndarray:
        """Which keys occur in two documents of this chunk."""
        if not len(self.keys):
            return np.zeros(0, bool)
        low = np.full(len(self.keys), np.iinfo(np.int64).max)
        high = np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, self.ids)
        np.maximum.at(high, self.which, self.ids)
        return low != high

    def candidates(self, replies, n_buckets: int):
        """Distinct fingerprints of the windows with a shared anchor: lanes, smallest id, and each window's."""
        shared = self.here() | blobs.Split(self.keys, n_buckets).unpack(replies)
        mine = np.flatnonzero(shared[self.which]) if len(self.keys) else np.zeros(0, np.int64)
        a = ta.windows(self.hashes, self.window, 0)[self.at[mine]]
        b = ta.windows(self.other, self.window, 1)[self.at[mine]] >> U(32)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        which = np.zeros(len(a), np.int64)
        which[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.ids[mine][order], at) if len(at) else np.zeros(0, np.int64)
        return mine, a[at], b[at].astype(np.uint32), least, which


def send_anchors(window: int, n_buckets: int):
    def run(batches):
        out = blobs.Rows(blobs.KEYS)
        for r in ct.each(batches):
            p = Parsed(*ct.unpack(r), window)
            for b, cut in blobs.Split(p.keys, n_buckets):
                out.add(r["cid"], b, p.keys[cut].tobytes(), b"")
            yield from out.ready()
        yield out.flush()

    return run


def answer_shared(table: pa.Table) -> pa.Table:
    """A bucket's keys that two chunks have."""
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
    keys = np.concatenate(parts)
    order = np.argsort(keys)
    twin = keys[order][1:] == keys[order][:-1]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][twin]] = True
    hit[order[:-1][twin]] = True
    return reply(table, parts, hit)


def reply(table: pa.Table, parts: list[np.ndarray], hit: np.ndarray) -> pa.Table:
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(hit[e - len(p) : e]).tobytes() for p, e in zip(parts, ends, strict=True)]
    return pa.table({"cid": table.column("cid"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())}, schema=blobs.BITS)


def send_windows(window: int, n_anchor: int, n_buckets: int):
    def run(batches):
        out = blobs.Rows(blobs.KEYS)
        for r in ct.each(batches):
            p = Parsed(*ct.unpack(r), window)
            _, a, b, least, _ = p.candidates(r["shared"], n_anchor)
            for k, cut in blobs.Split(a, n_buckets):
                ids, place = np.unique(least[cut], return_inverse=True)
                extra = np.int32(len(ids)).tobytes() + ids.tobytes() + b[cut].tobytes() + place.astype(np.uint16 if len(ids) < 65536 else np.uint32).tobytes()
                out.add(r["cid"], k, a[cut].tobytes(), extra)
            yield from out.ready()
        yield out.flush()

    return run


def answer_earlier(table: pa.Table) -> pa.Table:
    """A bucket's fingerprints that a document with a smaller id has, for each chunk."""
    parts, second, ids = [], [], []
    for k, e in zip(table.column("keys"), table.column("extra"), strict=True):
        a, e = np.frombuffer(k.as_py(), np.uint64), e.as_py()
        n = int(np.frombuffer(e, np.int32, 1)[0])
        some = np.frombuffer(e, np.int64, n, 4)
        second.append(np.frombuffer(e, np.uint32, len(a), 4 + 8 * n))
        ids.append(some[np.frombuffer(e, np.uint16 if n < 65536 else np.uint32, len(a), 4 + 8 * n + 4 * len(a))])
        parts.append(a)
    a, b, i = np.concatenate(parts), np.concatenate(second), np.concatenate(ids)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.minimum.reduceat(i[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = np.zeros(len(a), bool)
    hit[order] = least < i[order]
    return reply(table, parts, hit)


TEXTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def cut_words(window: int, n_anchor: int, n_windows: int):
    def run(batches):
        for r in ct.each(batches):
            ids, known, chunk = ct.unpack(r)
            p = Parsed(ids, known, chunk, window)
            mine, a, _, least, which = p.candidates(r["shared"], n_anchor)
            earlier = blobs.Split(a, n_windows).unpack(r["earlier"])
            gone = earlier[which] | (least[which] < p.ids[mine]) if len(mine) else np.zeros(0, bool)
            edge = np.zeros(len(p.hashes) + 1, np.int64)
            starts = p.at[mine[gone]]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            keep = np.cumsum(edge[:-1]) == 0
            data, off = ta.join_words(chunk, keep)
            total = np.zeros(len(keep) + 1, np.int64)
            np.cumsum(~keep, out=total[1:])
            removed = total[p.first[1:]] - total[p.first[:-1]]
            raw = data.tobytes()
            texts = [raw[off[k] : max(off[k], off[k + 1] - 1)].decode("utf-8", "replace") for k in range(chunk.n)]
            cols = [pa.array(ids, mask=~known), pa.array(np.diff(p.first)), pa.array(removed), pa.array(texts, pa.string())]
            yield pa.record_batch(cols, schema=TEXTS)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Removes each word covered by a window that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed and kept_text (kept words joined by one space) for
    every row.  Null text: no words.  A row without an id neither removes nor loses words.
    Rows of one id do not remove each other's words.  Texts shorter than a window stay.
    A very long text is a chunk of its own, which one task holds.
    Other columns are not read.
    """
    table = ct.chunk_table(docs, id_col, text_col)
    n = blobs.number_for(store.total_bytes(table), 8 << 20)
    shared = store.materialize(ct.gathered(table.mapInArrow(send_anchors(window, n), blobs.ROW), answer_shared), "shared")
    seen = ct.with_replies(table, shared=shared)
    earlier = store.materialize(ct.gathered(seen.mapInArrow(send_windows(window, n, n), blobs.ROW), answer_earlier), "earlier")
    return ct.with_replies(table, shared=shared, earlier=earlier).mapInArrow(cut_words(window, n, n), OUT)


def query(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(store.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM s),
m AS (SELECT g, min(doc_id) AS least FROM k GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k JOIN m USING (g) WHERE least < doc_id),
x AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
y AS (SELECT p.doc_id, string_agg(w[j], ' ' ORDER BY j) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.j = c.j GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""
