"""Spelling variants: words one edit apart, found by bands of their letter-parity masks.

A mask has one bit per letter, set if the word holds that letter an odd number of times.
A replaced code point flips exactly two bits, an inserted or deleted one exactly one.  The
bits are dealt to three bands, so two near words have at least one equal band.  Words meet
by (band, its value, length); a longer partner also comes to the words one shorter.  An edit
leaves one half of a word as it is, so inside a group only words with an equal half are
compared: by their masks, then letter by letter.  A group that is larger than a limit, as
of words of few letters, is cut by halves before it comes to a task, and a half by its
halves again, until groups are small.  A pair counts where its first equal band and halves
are, so it is found once.

Words are Latin letters up to U+00FF, so that a code point is a byte of Latin-1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, store
from . import textarrays as ta

U = np.uint64
#: Letters whose parities are about evenly spread over bands when they are dealt in turn: common ones first.
COMMON = "etaoinsrhldcumfpgwybvkxjqz"
#: Words per task of the comparison, and from which size a group is cut again.
BUCKET, LIMIT = 40_000, 20_000
#: Texts read at a time; runs up to so many bytes are hashed side by side; words up to so many letters are verified side by side.
CHUNK, SIDE, WIDE = 4 << 20, 64, 48
ONE_IN = 97
ROW = "key long, path binary, band int, longer boolean, word binary, n long"
ROW_ARROW = pa.schema([("key", pa.int64()), ("path", pa.binary()), ("band", pa.int32()), ("longer", pa.bool_()), ("word", pa.binary()), ("n", pa.int64())])


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1)
    return t


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of spans, each going on from a crc32."""
    table, size = crc_table(), ends - starts
    out = state.astype(np.uint32)
    long = np.flatnonzero(size > SIDE)
    short = np.flatnonzero(size <= SIDE)
    order = short[np.argsort(-size[short], kind="stable")]
    c, s, sorted_size = ~out[order], starts[order], size[order]
    for j in range(int(sorted_size[0]) if len(order) else 0):
        k = int(np.searchsorted(-sorted_size, -j, "left"))  # spans longer than j
        x = c[:k]
        c[:k] = table[(x ^ data[s[:k] + j]) & np.uint32(255)] ^ (x >> np.uint32(8))
    out[order] = ~c
    raw = memoryview(data)
    for k in long:
        out[k] = zlib.crc32(raw[starts[k] : ends[k]], int(out[k]))
    return out


def runs(c: ta.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of letters, and each one's text."""
    d = c.data
    if not len(d):
        z = np.zeros(0, np.int64)
        return z, z, z
    lead = d == 0xC3  # of U+00C0 to U+00FF, and of nothing else
    lower = d | 32
    inside = ((lower >= 97) & (lower <= 122) & (d < 128)) | lead
    inside[1:] |= lead[:-1]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cut = c.offsets[(c.offsets > 0) & (c.offsets < len(d))]
    before[cut] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(c.offsets, starts, "right") - 1


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Spans of bytes as an Arrow array."""
    size = ends - starts
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(starts - off[:-1], size)
    wide = pa.large_string() if kind == pa.string() else pa.large_binary()
    return pa.Array.from_buffers(wide, len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data[at].tobytes())]).cast(kind)


def word_rows(least: int):
    """(word, n): the words of each chunk and how often they occur there."""

    def run(batches):
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for c in ta.chunks(batch.column(1), CHUNK):
                low = ta.lowered(c.data)
                starts, ends, row = runs(c)
                lead = np.concatenate([[0], np.cumsum(low == 0xC3)])
                size = (ends - starts) - (lead[ends] - lead[starts])  # in code points
                some = size >= least
                starts, ends, row, size = starts[some], ends[some], row[some], size[some]
                mine = ids[c.first : c.first + c.n]
                state = np.array([zlib.crc32(b"%d:" % i) if i is not None else 0 for i in mine], np.uint32)
                named = np.array([i is not None for i in mine], bool)
                h = crcs(low, starts, ends, state[row])
                hit = (h % np.uint32(ONE_IN) == 0) & named[row]
                changed: Counter = Counter()
                for k in np.flatnonzero(hit & (size > least)):
                    w = low[starts[k] : ends[k]].tobytes().decode()
                    at = int(h[k]) % int(size[k])
                    changed[w[:at] + w[at + 1 :]] += 1
                starts, ends = starts[~hit], ends[~hit]
                a, b = ta.span_names(low, starts, ends)
                order = np.lexsort((b, a))
                new = np.ones(len(order), bool)
                new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(order)))
                words = slices(low, starts[order[first]], ends[order[first]], pa.string())
                yield pa.record_batch([words, pa.array(count, pa.int64())], schema=schema)
                if changed:
                    yield pa.record_batch([pa.array(list(changed), pa.string()), pa.array(list(changed.values()), pa.int64())], schema=schema)

    return run


def latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as bytes of one code point each, and their offsets."""
    data, off = ta.text_buffers(column)
    lead = data == 0xC3
    shift = np.concatenate([[0], np.cumsum(lead)])
    out = data.copy()
    out[1:][lead[:-1]] += 0x40
    return out[~lead], off - shift[off]


def alphabet() -> np.ndarray:
    """Each letter's bit from 0 to 89: bit k is in band k % 3."""
    order = np.zeros(256, np.int64)
    order[[ord(c) for c in COMMON]] = np.arange(26)
    order[0xC0:] = 26 + np.arange(64)
    return order


def masks(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Parity masks of words: three bands of 30 bits (n x 3)."""
    order = alphabet()
    out = np.zeros((len(off) - 1, 3), np.uint32)
    for band in range(3):
        table = np.where(order % 3 == band, np.uint32(1) << (order // 3).astype(np.uint32), np.uint32(0))
        if len(data):
            out[:, band] = np.bitwise_xor.reduceat(table[data], off[:-1])
    return out


def group_keys(band: int, value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Groups' numbers; two groups of one number only meet in vain, as their bands are compared again."""
    return ta.mix(ta.mix(value.astype(np.uint64) << U(2) | U(band)) + size.astype(np.uint64) * ta.ODD[0])


def rows_of(key: np.ndarray, path: bytes, band: int, longer, word: pa.Array, n: pa.Array) -> pa.RecordBatch:
    size = len(key)
    longer = pa.array(np.full(size, longer)) if isinstance(longer, bool) else longer
    return pa.record_batch([pa.array(key.view(np.int64)), pa.array([path] * size, pa.binary()), pa.array(np.full(size, band, np.int32)), longer, word, n], schema=ROW_ARROW)


def band_rows(batches):
    """A row per word and band, and one more in two bands for the words one shorter: one flipped bit leaves band 0 or 1 as it is."""
    for batch in batches:
        data, off = latin(batch.column(0))
        m, size = masks(data, off), np.diff(off)
        word = slices(data, off[:-1], off[1:], pa.binary())
        for band in range(3):
            for longer in (False, True)[: 2 if band < 2 else 1]:
                yield rows_of(group_keys(band, m[:, band], size - longer), b"", band, longer, word, batch.column(1))


def joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def halves(path: bytes, size: int):
    """(choice, from, middle, to) of each cut that a path made in words of `size` letters, and of the next one (choice -1).

    Choice 0: the front half is equal, and the edit is behind it; 1: the back half is, which
    in a longer partner lies one letter further on.
    """
    lo, hi = 0, size
    for choice in (*path, -1):
        mid = (lo + hi) // 2
        yield choice, lo, mid, hi
        lo, hi = (mid, hi) if choice == 0 else (lo, mid)


def cut_again(batches):
    """Rows of large groups, once for each half of the stretch that has the edit; a stretch of one letter can't be cut."""
    out = blobs.Rows(ROW_ARROW)
    for batch in batches:
        for r in batch.to_pylist():
            _, lo, mid, hi = list(halves(r["path"], len(r["word"]) - r["longer"]))[-1]
            for j, half in enumerate((r["word"][lo:mid], r["word"][mid + r["longer"] : hi + r["longer"]])):
                key = int.from_bytes(blake2b(b"%d:%d:" % (r["key"], j) + half, digest_size=8).digest(), "little", signed=True)
                out.add(key, r["path"] + bytes([j]), r["band"], r["longer"], r["word"], r["n"])
            yield from out.ready()
    yield out.flush()


def runs_of_equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows of equal keys stand together, and for each place the end of its run."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order))
    return order, np.repeat(last, last - first)


def aligned(words: list[bytes], right: bool = False) -> np.ndarray:
    """Words up to WIDE letters as rows of a matrix, from the left or the right."""
    w = max((len(x) for x in words if len(x) <= WIDE), default=1)
    cells = (x if len(x) <= WIDE else b"" for x in words)
    return np.frombuffer(b"".join((x[::-1] if right else x).ljust(w, b"\0") for x in cells), np.uint8).reshape(len(words), w)


def one_edit(x: bytes, y: bytes) -> bool:
    """Whether y is x with exactly one byte replaced or inserted; y is not shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) == len(b):
        return int((a != b).sum()) == 1
    if len(a) + 1 != len(b):
        return False
    front, back = a != b[:-1], a != b[1:]
    p = int(front.argmax()) if front.any() else len(a)
    return not back[p:].any()


class Compared:
    """Near pairs among the rows of one task."""

    def __init__(self, paths, bands, longer, words):
        self.paths, self.bands, self.longer, self.words = paths, bands, longer, words
        self.data, self.off = joined(words)
        self.size, self.m = np.diff(self.off), masks(self.data, self.off)
        self.left, self.right = aligned(words), aligned(words, True)

    def pairs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows x, y that are near, the shorter one first; each pair as often as it stands in groups that count it."""
        group = self.size - self.longer
        lo, mid, hi = np.zeros(len(group), np.int64), group // 2, group.copy()
        for k in np.flatnonzero([len(p) > 0 for p in self.paths]):
            _, lo[k], mid[k], hi[k] = list(halves(self.paths[k], int(group[k])))[-1]
        front = ta.span_names(self.data, self.off[:-1] + lo, self.off[:-1] + mid)
        back = ta.span_names(self.data, self.off[:-1] + mid + self.longer, self.off[:-1] + hi + self.longer)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for half in (front, back):
            rows, end = runs_of_equal(*half, key.view(np.uint64))
            for x, y in self.met(rows, end):
                equal = self.m[x] == self.m[y]
                ok = equal.any(1) & (equal.argmax(1) == self.bands[x])
                if half is back:
                    ok &= (front[0][x] != front[0][y]) | (front[1][x] != front[1][y])
                found.append(self.halved(*self.near(x[ok], y[ok])))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def halved(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose first equal halves are those of their group."""
        ok = np.ones(len(x), bool)
        for k in range(len(x)):
            if path := self.paths[x[k]]:
                a, b = self.words[x[k]], self.words[y[k]]
                on = len(b) - len(a)
                for choice, lo, mid, hi in halves(path, len(a)):
                    if choice >= 0:
                        ok[k] &= (a[lo:mid] == b[lo:mid]) == (choice == 0) and (choice == 0 or a[mid:hi] == b[mid + on : hi + on])
        return x[ok], y[ok]

    def met(self, rows: np.ndarray, end: np.ndarray):
        """Rows of one run whose masks differ by as many bits as one edit flips."""
        at, step = np.arange(len(rows)), 1
        while True:
            at = at[at + step < end[at]]
            if not len(at):
                return
            x, y = rows[at], rows[at + step]
            flips = np.bitwise_count(self.m[x] ^ self.m[y]).sum(1)
            fit = np.flatnonzero(np.where(self.longer[x] == self.longer[y], (flips == 2) & ~self.longer[x], flips == 1))
            if len(fit):
                x, y = x[fit], y[fit]
                swap = self.size[x] > self.size[y]
                yield np.where(swap, y, x), np.where(swap, x, y)
            step += 1

    def near(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        wide = self.size[y] > WIDE
        same = self.size[x] == self.size[y]
        ok = np.zeros(len(x), bool)
        a, b = self.left[x], self.left[y]
        differ = a != b
        ok[same] = differ[same].sum(1) == 1
        front = np.where(differ.any(1), differ.argmax(1), differ.shape[1])
        other = self.right[x] != self.right[y]
        back = np.where(other.any(1), other.argmax(1), other.shape[1])
        ok[~same] = (front + back >= self.size[x])[~same] & (self.size[x] + 1 == self.size[y])[~same]
        for k in np.flatnonzero(wide):
            ok[k] = one_edit(self.words[x[k]], self.words[y[k]])
        return x[ok], y[ok]


def compare(table: pa.Table) -> pa.Table:
    """For each word of a task: how many near words it met there, and the one of largest n (then the smallest)."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    c = Compared(table.column("path").to_pylist(), table.column("band").to_numpy(), table.column("longer").to_numpy(zero_copy_only=False), words)
    x, y = c.pairs(table.column("key").to_numpy())
    one, other = np.concatenate([x, y]), np.concatenate([y, x])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    who, first, count = np.unique(one, return_index=True, return_counts=True)
    text = lambda rows: pa.array([words[k].decode("latin-1") for k in rows], pa.string())
    return pa.table({"word": text(who), "n_near": pa.array(count, pa.int64()), "near": text(other[first]), "m": pa.array(n[other[first]], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, m): of each word that has near words, their number and the best one with its n."""
    todo, done = store.materialize(words.select("word", "n").mapInArrow(band_rows, ROW), "bands"), []
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    for _ in range(longest.bit_length()):  # then no word has a half left to cut
        sizes = store.materialize(todo.groupBy("key").agg(F.count("*").alias("__n")).where(F.col("__n") > LIMIT).select("key"), "large")
        if sizes.isEmpty():
            break
        done.append(todo.join(sizes, "key", "left_anti"))
        todo = store.materialize(todo.join(sizes, "key", "left_semi").mapInArrow(cut_again, ROW), "bands")
    rows = reduce(DataFrame.unionByName, done, todo)
    bucket = F.pmod("key", F.lit(blobs.number_for(rows.count(), BUCKET)))
    met = rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(compare, "word string, n_near long, near string, m long")
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near")))
    out = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("m"))
    return store.materialize(out, "near")


def followed(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> (word, root): forms followed to the last, which has none.

    Each round doubles the steps.  A form's n is at least twice its word's, so there are at
    most as many steps as n has bits, and no circles.
    """
    links = store.materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        there = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = links.hint("merge").join(there, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        new = store.materialize(new, "roots")
        going = not new.where("moved").isEmpty()
        store.drop(forms.sparkSession, links)
        links = new.select("word", "root")
        if not going:
            return links


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, often: int = 3, times: int = 2) -> DataFrame:
    """Words of at least `least` letters and `often` occurrences, with the near word that each is a variant of.

    Runs of A-Z, a-z and U+00C0 to U+00FF are lower-cased (A-Z only); where 97 divides the
    crc32 of `<id>:<run>`, the letter at crc32 modulo length is deleted, so that misspelt
    words are known to be there.  Two words are near if one code point is inserted, deleted
    or replaced between them.  form is the near word of largest n (of equal ones the
    smallest), if that is at least `times` the word's own n; root follows forms to the last.

    Null text: no words.  Rows without an id count, with nothing deleted; repeated rows count
    again.  A very long text, also of one run, is read whole by one task.  A text without
    words, and an empty table, give no row.  Other columns are not read.

    Returns word, form, root, n, n_near and form_n.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    counts = rows.mapInArrow(word_rows(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = store.materialize(counts.where(F.col("n") >= often), "words")
    near = near_words(words)
    joined = words.join(near, "word", "left")
    good = F.col("m") >= times * F.col("n")
    formed = store.materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near")).alias("form"), F.when(good, F.col("m")).alias("form_n")), "forms")
    roots = followed(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(store.table(spark, sf_dir, "documents"))


# crc32 bit by bit from its polynomial; near words share the word with one place blanked, or one is the other without a letter.
SQL = r"""
WITH RECURSIVE t0 AS (SELECT i, CAST(i AS UBIGINT) AS v, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384::UBIGINT, v >> 1) ELSE v >> 1 END, k + 1 FROM t0 WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM t0 WHERE k = 8),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS c FROM r WHERE length(run) >= 5 GROUP BY ALL),
b AS (SELECT doc_id, run, c, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS x FROM g),
h AS (SELECT run, c, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT))),
        lambda a, y: xor(t[CAST(xor(a, y) & 255 AS BIGINT) + 1], a >> 8)), 4294967295::UBIGINT) AS h FROM b, tab),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
s AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM p),
e AS (SELECT x.word, y.word AS near, y.n AS m FROM s x JOIN s y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
      UNION SELECT s.word, w.word, w.n FROM s JOIN w ON w.word = s.a || s.z UNION SELECT w.word, s.word, s.n FROM s JOIN w ON w.word = s.a || s.z),
q AS (SELECT word, count(*) AS n_near, arg_min(near, {'m': -m, 'near': near}) AS near, max(m) AS m FROM e GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN q USING (word)),
o(word, at_) AS (SELECT word, word FROM f UNION ALL SELECT o.word, f.form FROM o JOIN f ON f.word = o.at_ WHERE f.form IS NOT NULL)
SELECT f.word, f.form, o.at_ AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN o USING (word) JOIN f z ON z.word = o.at_ WHERE z.form IS NULL
"""
