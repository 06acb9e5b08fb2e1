"""N-gram Jaccard join with PartEnum signatures.

Texts of one shingle set form a class; only classes are compared.  Sizes are cut into
bands [l, l / threshold]; a class takes part in its own band and in the one below, where
it is the larger partner.  In a band any two similar sets differ in at most k elements.
Elements fall into n1 parts by hash, so some part holds at most k2 differences; that
part is cut into n2 cells, and the n2 - k2 cells without a difference give equal
signatures.  Every similar pair therefore shares a signature.  Signatures of cells without an
element are the same for unrelated sets.  So there are some parts to spare: at least
`spare` parts of a similar pair hold at most k2 differences, and a set in which fewer parts than
that have such cells keeps a shared signature of elements when it drops the empty ones.  A
small histogram of each set rules most candidate pairs out; the sets of the others are read
from their texts and counted exactly.

A chunk of documents meets each signature once: its own classes with equal signatures
are linked to one of them there, and only that one travels.  Groups over ALL classes are
linked as stars (those of up to ALL classes pair by pair); they, and groups where a class
speaks for others of its chunk, also tie their classes together.  A family is what ties
connect.  When the links are known, classes of a family and size band outside its largest
component are compared with the rest of the band, a pair of blocks a task, by their whole
sets: histograms rule pairs out, the others are counted exactly, as products of matrices where
they are many.  A block gives only links that join components, so its rows follow its
classes and not their pairs, and no pair is lost.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations
from math import comb, exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blobs, keybits, store
from . import textarrays as ta
from .components import components

U = np.uint64
ALL = 8
#: Items of a block, and columns of the matrices that it multiplies.
BLOCK, COLUMNS = 1_200_000, 512
#: Cells of a table of pairs that are worked on at once: a few MB of each intermediate result, whatever a block holds.
CELLS = 1 << 18
#: Guests that a block compares at once, and the shares of them after which it starts afresh: links found so far spare pairs.
FEW, SHARES = 2_000, (1 / 512, 1 / 64, 1 / 8, 1.0)
FOUND = "pair boolean, local boolean, a binary, na int, b binary, nb int"
FOUND_ARROW = pa.schema([("pair", pa.bool_()), ("local", pa.bool_()), ("a", pa.binary()), ("na", pa.int32()), ("b", pa.binary()), ("nb", pa.int32())])


def shingle_sets(chunk: ta.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of every text, sorted, and each text's first (n + 1 values)."""
    h, _ = chunk.word_names(lower=True)
    first = chunk.words()[2]
    count = np.diff(first)
    keep = ta.window_ok(first, n, len(h))
    sets = ta.windows(h, n)[keep]
    row = ta.rows_of(first)[: len(keep)][keep]
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        whole = [ta.windows(h[first[k] : first[k + 1]], int(count[k]), 1)[0] for k in few]
        row = np.concatenate([row, few])
        sets = np.concatenate([sets, np.array(whole, np.uint64)])
        order = np.argsort(row, kind="stable")
        row, sets = row[order], sets[order]
    bounds = np.searchsorted(row, np.arange(chunk.n + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        sets[a:b].sort()
    new = np.ones(len(sets), bool)
    new[1:] = (sets[1:] != sets[:-1]) | (row[1:] != row[:-1])
    total = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(new, out=total[1:])
    return sets[new], total[bounds]


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def classes(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 128-bit name of each row's set, as two columns."""
    lanes = [ta.mix(per_row(ta.mix(sets ^ ta.ODD[k]), first) + np.diff(first).astype(np.uint64)) for k in (0, 1)]
    return np.stack(lanes, axis=1)


def sketch(items: np.ndarray) -> bytes:
    """A set's histogram over its items' high bits, about a bin for eight items, counts up to 255."""
    bits = max(3, (len(items) >> 3).bit_length())
    return np.minimum(np.bincount((items >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def sketches_apart(x: bytes, y: bytes) -> int:
    """A lower bound of how many items are in one of two sets only."""
    a, b = sorted((np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)), key=len)
    full = a < 255  # a clipped count only bounds from below
    b = b.reshape(len(a), -1)
    full &= (b < 255).all(1)
    return int(np.abs(a - b.sum(1))[full].sum())


def profile(n: int):
    """All columns but the first, the text, with n_shingles, class and sketch."""

    def run(batches):
        for batch in batches:
            for c in ta.chunks(batch.column(0)):
                sets, first = shingle_sets(c, n)
                size = np.diff(first)
                name = classes(sets, first)
                names = pa.array([name[k].tobytes() if size[k] else None for k in range(c.n)], pa.binary())
                rest = [x.slice(c.first, c.n) for x in batch.columns[1:]]
                sketches = pa.array([sketch(sets[i:j]) if i < j else None for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest, pa.array(size), names, sketches], [*batch.schema.names[1:], "n_shingles", "class", "sketch"])

    return run


class Bands:
    """Size bands and the shape of their signatures for a threshold num / den."""

    def __init__(self, num: int, den: int):
        self.ratio = Fraction(num, den)
        self.low, self.shapes = [1], []

    def upto(self, size: int) -> np.ndarray:
        """Lower ends of bands, beyond size and one more."""
        while self.low[-1] <= size:
            self.low.append(int(self.low[-1] / self.ratio) + 1)
        return np.array(self.low)

    def shape(self, band: int) -> tuple[int, int, int, int]:
        """n1, n2, k2 and spare of a band: larger partners lie in the next band at most."""
        while len(self.shapes) <= band:
            low = self.low[len(self.shapes)]
            most = int(low / self.ratio)
            self.shapes.append(best_shape(low, int((most + int(most / self.ratio)) * (1 - self.ratio) / (1 + self.ratio))))
        return self.shapes[band]


def chance_of(least: int, mean: float) -> float:
    """The chance that a Poisson variable is `least` or more."""
    return 1 - sum(exp(k * log(mean) - mean - lgamma(k + 1)) for k in range(least)) if mean > 0 else 0.0


def best_shape(size: int, k: int) -> tuple[int, int, int, int]:
    """The shape of fewest signatures for sets of `size` elements with at most k differences.

    Any shape finds all pairs.  A set that can't drop its empty signatures counts as 20 more
    sets, and so does a signature of under 3.5 elements, which unrelated sets share too often.
    """
    if k == 0:
        return 1, 1, 0, 1
    found = []
    for k2 in range(1, min(k, 3) + 1):
        for n2 in range(k2 + 1, k2 + 4):
            for extra in range(max(8, k // 4)):
                n1 = k // (k2 + 1) + 1 + extra
                cell = size / n1 / n2
                empty = sum(comb(n2, i) * (1 - exp(-cell)) ** i * exp(-cell * (n2 - i)) for i in range(k2 + 1))
                stuck = chance_of(extra + 1, n1 * empty) + (cell * (n2 - k2) < 3.5)
                found.append((n1 * comb(n2, k2) * (1 + 20 * stuck), n1, n2, k2, extra + 1))
                if stuck < 0.005:
                    break
    return min(found)[1:]


def signatures(sets: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """All signatures and the row each belongs to."""
    size = np.diff(first)
    if not len(size) or not size.max():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = bands.upto(int(size.max()))
    own = np.searchsorted(low, size, "right") - 1
    row = ta.rows_of(first)
    part, cell = ta.mix(sets ^ U(11)), ta.mix(sets ^ U(13))
    hi, lo = (cell >> U(32)).astype(np.float64), (cell & U(0xFFFFFFFF)).astype(np.float64)
    shapes = np.array([bands.shape(b) for b in range(len(low) - 1)])
    sigs, rows = [], []
    for step in (0, 1):
        band = own - step
        usable = (size > 0) & (band >= 0)
        n1, n2, k2, spare = shapes[np.where(usable, band, 0)].T
        n1 = np.where(usable, n1, 0)
        base = np.concatenate([[0], np.cumsum(n1 * n2)])
        use = usable[row]
        r = row[use]
        p = ((part[use] >> U(32)) * n1[r].astype(np.uint64) >> U(32)).astype(np.int64)
        q = ((part[use] & U(0xFFFFFFFF)) * n2[r].astype(np.uint64) >> U(32)).astype(np.int64)
        at = base[r] + p * n2[r] + q
        sums = (np.bincount(at, hi[use], base[-1]).astype(np.uint64) << U(32)) + np.bincount(at, lo[use], base[-1]).astype(np.uint64)
        sums, filled = ta.mix(sums), np.bincount(at, minlength=base[-1]) > 0
        owner = np.repeat(np.arange(len(size)), n1)
        where = np.arange(len(owner)) - np.repeat(np.cumsum(n1) - n1, n1)
        tag = ta.mix(band[owner].astype(np.uint64) * ta.ODD[0] + where.astype(np.uint64))
        start = base[owner] + where * n2[owner]
        for cells, differ in {(int(a), int(b)) for a, b in zip(n2[usable], k2[usable], strict=True)}:
            of = np.flatnonzero((n2[owner] == cells) & (k2[owner] == differ))
            who = owner[of]
            full = filled[start[of][:, None] + np.arange(cells)]
            drops = np.bincount(who, full.sum(1) <= differ, len(size)) < spare
            for j, keep in enumerate(combinations(range(cells), cells - differ)):
                some = full[:, keep].any(1) | ~drops[who]
                s = tag[of[some]] + U(j)
                for c in keep:
                    s = ta.mix(s + sums[start[of[some]] + c] * ta.ODD[1])
                sigs.append(s)
                rows.append(who[some])
    return np.concatenate(sigs), np.concatenate(rows)


def similar_sizes(a: np.ndarray, b: np.ndarray, ratio: Fraction) -> np.ndarray:
    return np.minimum(a, b) * ratio.denominator >= np.maximum(a, b) * ratio.numerator


def link_groups(sig: np.ndarray, who: np.ndarray, names: np.ndarray, size: np.ndarray, ratio: Fraction, local: bool, speaks: np.ndarray | None = None):
    """Candidate pairs and ties of the groups of equal signatures.

    sig sorted, who: index into names (n x 2) and size; a group has no class twice.
    speaks: which entries stand for more classes of their chunk.  Returns pairs to compare
    and ties of a group's members to its first one, where it is large or one speaks for
    others (both rows of two indices), which entries lead a group, and which of those
    have one of several.
    """
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(sig)))
    group = np.repeat(np.arange(len(at)), count)
    many = count[group] > 1
    big = count[group] > (1 if local else ALL)
    lead = at[group]
    star = many & big & ~new
    a, b = [who[lead[star]]], [who[star]]
    if not local:
        for c in range(2, ALL + 1):
            base = at[count == c]
            for i, j in combinations(range(c), 2):
                a.append(who[base + i])
                b.append(who[base + j])
    a, b = np.concatenate(a), np.concatenate(b)
    tie = star if speaks is None else many & ~new & (big | np.logical_or.reduceat(speaks, at)[group]) if len(at) else star
    swap = (names[a, 0] > names[b, 0]) | ((names[a, 0] == names[b, 0]) & (names[a, 1] > names[b, 1]))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    fit = similar_sizes(size[a], size[b], ratio)
    pairs = np.unique(np.stack([a[fit], b[fit]], axis=1), axis=0)
    ties = np.unique(np.stack([who[lead[tie]], who[tie]], axis=1), axis=0)
    return pairs, ties, new, many[new]


def found_rows(out: blobs.Rows, pairs, ties, names, size, local: bool):
    raw = [n.tobytes() for n in names]
    for kind, some in ((True, pairs), (False, ties)):
        for i, j in some:
            out.add(kind, local, raw[i], int(size[i]), raw[j], int(size[j]))


def send_signatures(n: int, n_buckets: int, num: int, den: int):
    """Chunks' signatures for the buckets, and what chunks find themselves (buckets from n_buckets on)."""

    def run(batches):
        bands = Bands(num, den)
        out = blobs.Rows(blobs.KEYS)
        for batch in batches:
            for c in ta.chunks(batch.column(0)):
                sets, first = shingle_sets(c, n)
                names, size = classes(sets, first), np.diff(first)
                _, one = np.unique(names, axis=0, return_index=True)
                one = np.sort(one[size[one] > 0])
                pick = np.zeros(c.n, bool)
                pick[one] = True
                kept = sets[pick[ta.rows_of(first)]]
                names, size = names[one], size[one]
                sig, who = signatures(kept, np.concatenate([[0], np.cumsum(size)]), bands)
                order = np.lexsort((who, sig))
                sig, who = sig[order], who[order]
                twice = np.zeros(len(sig), bool)
                twice[1:] = (sig[1:] == sig[:-1]) & (who[1:] == who[:-1])
                sig, who = sig[~twice], who[~twice]
                pairs, ties, lead, several = link_groups(sig, who, names, size, bands.ratio, True)
                if len(pairs) or len(ties):
                    head = np.array([len(names), len(pairs), len(ties)], np.int64)
                    rest = b"".join(x.astype(np.int64 if x is not names else np.uint64).tobytes() for x in (names, size, pairs, ties))
                    out.add(0, n_buckets + int(names[0, 0] % U(n_buckets)), b"", head.tobytes() + rest)
                sig, who = sig[lead], who[lead]
                for k, cut in blobs.Split(sig, n_buckets):
                    w, place = np.unique(who[cut], return_inverse=True)
                    head = np.int64(len(w)).tobytes() + names[w].tobytes() + size[w].astype(np.int64).tobytes()
                    out.add(0, k, sig[cut].tobytes(), head + place.astype(np.uint16 if len(w) < 65536 else np.uint32).tobytes() + several[cut].tobytes())
                yield from out.ready()
        yield out.flush()

    return run


def local_found(packed) -> pa.Table:
    """Rows of what chunks found by themselves."""
    out = blobs.Rows(FOUND_ARROW)
    for e in packed:
        e = e.as_py()
        n, p, t = (int(x) for x in np.frombuffer(e, np.int64, 3))
        names = np.frombuffer(e, np.uint64, 2 * n, 24).reshape(n, 2)
        size = np.frombuffer(e, np.int64, n, 24 + 16 * n)
        both = np.frombuffer(e, np.int64, 2 * (p + t), 24 + 24 * n).reshape(p + t, 2)
        found_rows(out, both[:p], both[p:], names, size, True)
    return pa.Table.from_batches([out.flush()])


def match(num: int, den: int, n_buckets: int):
    """Candidate pairs and ties of large groups in one bucket of signatures."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= n_buckets:
            return local_found(table.column("extra"))
        sigs, names, sizes, who, speaks, base = [], [], [], [], [], 0
        for k, e in zip(table.column("keys"), table.column("extra"), strict=True):
            s, e = np.frombuffer(k.as_py(), np.uint64), e.as_py()
            n = int(np.frombuffer(e, np.int64, 1)[0])
            names.append(np.frombuffer(e, np.uint64, 2 * n, 8).reshape(n, 2))
            sizes.append(np.frombuffer(e, np.int64, n, 8 + 16 * n))
            who.append(np.frombuffer(e, np.uint16 if n < 65536 else np.uint32, len(s), 8 + 24 * n).astype(np.int64) + base)
            speaks.append(np.frombuffer(e, bool, len(s), len(e) - len(s)))
            sigs.append(s)
            base += n
        sig, who, speaks, names, size = (np.concatenate(x) for x in (sigs, who, speaks, names, sizes))
        order = np.argsort(sig)
        sig, who, speaks = sig[order], who[order], speaks[order]
        same = sig[1:] == sig[:-1]
        shared = np.zeros(len(sig), bool)
        shared[1:] |= same
        shared[:-1] |= same
        sig, who, speaks = sig[shared], who[shared], speaks[shared]
        used = np.unique(who)
        kinds, number = np.unique(names[used], axis=0, return_inverse=True)
        sized = np.zeros(len(kinds), np.int64)
        sized[number.ravel()] = size[used]
        who = number.ravel()[np.searchsorted(used, who)]
        order = np.lexsort((~speaks, who, sig))
        sig, who, speaks = sig[order], who[order], speaks[order]
        twice = np.zeros(len(sig), bool)
        twice[1:] = (sig[1:] == sig[:-1]) & (who[1:] == who[:-1])
        out = blobs.Rows(FOUND_ARROW)
        pairs, ties, _, _ = link_groups(sig[~twice], who[~twice], kinds, sized, Fraction(num, den), False, speaks[~twice])
        found_rows(out, pairs, ties, kinds, sized, False)
        return pa.Table.from_batches([out.flush()])

    return run


def set_rows(n: int):
    def run(batches):
        out = blobs.Rows(pa.schema([("class", pa.binary()), ("items", pa.binary())]))
        for batch in batches:
            for c in ta.chunks(batch.column(0)):
                sets, first = shingle_sets(c, n)
                names = classes(sets, first)
                for k in range(c.n):
                    out.add(names[k].tobytes(), sets[first[k] : first[k + 1]].tobytes())
                yield from out.ready()
        yield out.flush()

    return run


def may_link(num: int, den: int):
    """The pairs whose sketches don't rule them out."""

    def run(batches):
        for b in batches:
            most = (b.column("na").to_numpy() + b.column("nb").to_numpy()) * (den - num)
            apart = np.array([sketches_apart(x.as_py(), y.as_py()) for x, y in zip(b.column("sa"), b.column("sb"), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(apart * (num + den) <= most, pa.bool_()))

    return run


def linked_sets(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(both) - shared)


def verify(num: int, den: int):
    def run(batches):
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("linked", pa.bool_())])
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                linked.append(linked_sets(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], schema=schema)

    return run


def fold(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Histograms over as many bins as the shortest has, and which bins are clipped in part."""
    lengths = np.array([len(x) for x in sketches])
    bins = int(lengths.min())
    folded, clipped = np.zeros((len(sketches), bins), np.int64), np.zeros((len(sketches), bins), bool)
    for length in np.unique(lengths):
        of = np.flatnonzero(lengths == length)
        raw = np.frombuffer(b"".join(sketches[k] for k in of), np.uint8).reshape(len(of), bins, -1)
        folded[of], clipped[of] = raw.sum(2, dtype=np.int64), (raw == 255).any(2)
    return folded, clipped


def bounds_apart(folded: np.ndarray, clipped: np.ndarray, x: np.ndarray, y: np.ndarray, largest: int) -> np.ndarray:
    """For each of x against each of y, a lower bound of how many items are in one set only.

    Bin by bin over all pairs, so a step touches one small matrix; a bin that is clipped in
    either set counts nothing.
    """
    kind = np.int16 if 2 * largest < 1 << 15 else np.int64  # a sum is at most both sizes
    a, b = folded[x].T.astype(kind), folded[y].T.astype(kind)
    total, step = np.zeros((len(x), len(y)), kind), np.empty((len(x), len(y)), kind)
    for k in range(len(a)):
        np.subtract(a[k][:, None], b[k][None, :], out=step)
        np.abs(step, out=step)
        if clipped[:, k].any():
            step *= ~(clipped[x, k][:, None] | clipped[y, k][None, :])
        total += step
    return total


def shared_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many items each of the sets x shares with each of y: rare items pair by pair, frequent ones by products of 0/1 matrices."""
    items = [np.concatenate([sets[k] for k in of]) for of in (x, y)]
    rows = [np.repeat(np.arange(len(of)), [len(sets[k]) for k in of]) for of in (x, y)]
    both = np.intersect1d(*items)
    total = np.zeros(len(x) * len(y), np.float32)
    if not len(both):
        return total.reshape(len(x), len(y))
    col = [np.minimum(np.searchsorted(both, i), len(both) - 1) for i in items]
    for k in (0, 1):
        held = both[col[k]] == items[k]
        order = np.argsort(col[k][held], kind="stable")
        col[k], rows[k] = col[k][held][order], rows[k][held][order]
    n = [np.bincount(c, minlength=len(both)) for c in col]
    first = [np.concatenate([[0], np.cumsum(m)]) for m in n]
    rare = n[0] * n[1] * 120 < len(total)
    entry = np.flatnonzero(rare[col[0]])  # an entry of x meets all entries of y of its item
    ends = np.cumsum(n[1][col[0][entry]])
    at = 0
    while at < len(entry):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + CELLS, "right")))
        some = entry[at:to]
        many = n[1][col[0][some]]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[1][col[0][some]], many)
        cell, count = np.unique(np.repeat(rows[0][some], many) * len(y) + rows[1][place], return_counts=True)
        total[cell] += count
        at = to
    total = total.reshape(len(x), len(y))
    number = np.where(rare, -1, np.cumsum(~rare) - 1)
    c = [number[k] for k in col]
    for low in range(0, int((~rare).sum()), COLUMNS):
        dense = []
        for k, of in enumerate((x, y)):
            mine = (c[k] >= low) & (c[k] < low + COLUMNS)
            d = np.zeros((len(of), COLUMNS), np.float32)
            d[rows[k][mine], c[k][mine] - low] = 1
            dense.append(d)
        total += dense[0] @ dense[1].T
    return total


def by_rows(n: int, m: int, of) -> np.ndarray:
    """A table of n x m truth values, made of those that `of` gives for some of its rows at a time."""
    out = np.empty((n, m), bool)
    step = max(1, CELLS // max(1, m))
    for at in range(0, n, step):
        out[at : at + step] = of(slice(at, at + step))
    return out


def compare_blocks(num: int, den: int):
    """Links between a block's guests and its other classes, as many as join components."""

    def run(table: pa.Table) -> pa.Table:
        size = table.column("size").to_numpy()
        guest, upper, main = (table.column(c).to_numpy(zero_copy_only=False) for c in ("guest", "upper", "main"))
        names = table.column("class").to_pylist()
        sets = [np.frombuffer(e.as_py(), np.uint64) for e in table.column("items")]
        label = {}
        group = np.array([label.setdefault(r, len(label)) for r in table.column("root").to_pylist()], np.int64)
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        guests, others, found = np.flatnonzero(guest), np.flatnonzero(~guest), []
        if len(guests) and len(others):
            folded, clipped = fold([sketch(x) for x in sets])
        step = max(1, min(FEW, (1 << 22) // max(1, len(others))))
        cuts = sorted({*range(0, len(guests), step), *(int(len(guests) * share) for share in SHARES)})
        for low, high in zip(cuts, [*cuts[1:], len(guests)], strict=True):
            x, y = guests[low:high], others
            if not len(x) or not len(y):
                continue
            # two classes that can both be guests meet as such once
            may_meet = lambda g: (group[g][:, None] != group[y]) & (main[y] | (rank[y] < rank[g][:, None])) & ~(upper[y] & upper[g][:, None])
            fit = by_rows(len(x), len(y), lambda s: may_meet(x[s]) & similar_sizes(size[x[s]][:, None], size[y], Fraction(num, den)))  # noqa: B023
            some, other = fit.any(1), fit.any(0)
            x, y, fit = x[some], y[other], fit[some][:, other]
            if not len(x):
                continue
            both = lambda s: (size[x[s]][:, None] + size[y]).astype(np.int64)  # noqa: B023, E731
            fit &= by_rows(len(x), len(y), lambda s: bounds_apart(folded, clipped, x[s], y, int(size.max())).astype(np.int64) * (num + den) <= both(s) * (den - num))  # noqa: B023
            some, other = fit.any(1), fit.any(0)
            x, y, fit = x[some], y[other], fit[some][:, other]
            exact = fit.sum() * 30 > fit.size  # else few pairs are left, and are counted one by one
            if exact:
                shared = shared_counts(sets, x, y)
                fit &= by_rows(len(x), len(y), lambda s: (den + num) * shared[s].astype(np.int64) >= num * both(s))  # noqa: B023
            for i, k in enumerate(x.tolist()):
                hits = y[fit[i]]
                while len(hits := hits[group[hits] != group[k]]):
                    j, hits = int(hits[0]), hits[1:]
                    if exact or linked_sets(sets[k], sets[j], num, den):
                        found.append((k, j))
                        group[group == group[j]] = group[k]
        return pa.table({c: pa.array([names[f[k]] for f in found], pa.binary()) for k, c in enumerate("ab")})

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, carry: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Profiles (doc_id, carried columns, n_shingles, class) of all rows, and links (a, b) that connect classes.

    The links give the components; they are not all pairs of the join, as pairs inside a
    component are skipped, so links of a document can't be counted from them.
    """
    ids, text = F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    digest = F.unhex(F.sha2(F.col(text_col).cast("string"), 256)).alias("digest")
    rows = docs.select(text, ids, digest, *carry)
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    profiles = store.materialize(rows.mapInArrow(profile(n), f"{plain}, n_shingles long, class binary, sketch binary"), "profiles")
    kinds = profiles.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.min("digest").alias("digest"))
    kinds = store.materialize(kinds, "kinds")
    total = profiles.agg(F.sum("n_shingles")).first()[0] or 0
    n_buckets = blobs.number_for(total, 2_000_000)
    sent = docs.select(text).mapInArrow(send_signatures(n, n_buckets, num, den), blobs.ROW)
    found = store.materialize(sent.groupBy("bucket").applyInArrow(match(num, den, n_buckets), FOUND), "found")
    pairs = found.where("pair").select("a", "b").distinct()
    ties = store.materialize(found.where("NOT pair").select("local", "a", "b").distinct(), "ties")
    ka = kinds.select(F.col("class").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa"))
    sketched = pairs.hint("merge").join(ka, "a").hint("merge").join(ka.toDF("b", "nb", "sb"), "b")
    near = store.materialize(sketched.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(may_link(num, den), "a binary, b binary"), "pairs")

    def fetch(wanted: DataFrame) -> DataFrame:
        """The sets of classes, read again from one text each; other texts are told by a bitmap, and copies meet in their task."""
        where = store.materialize(wanted.join(kinds, "class").select("digest").distinct(), "where")
        seen, hit = keybits.maybe(docs.select(text, digest), F.col("digest"), keybits.bitmap(where, "digest"))
        texts = seen.where(hit).groupBy("digest").agg(F.first("text").alias("text")).hint("merge").join(where, "digest", "left_semi")
        sets = texts.select("text").mapInArrow(set_rows(n), "class binary, items binary").dropDuplicates(["class"])
        return store.materialize(sets, "sets", "none")

    def linked(near: DataFrame) -> DataFrame:
        """The pairs that are similar, by their sets."""
        sets = fetch(near.select(F.col("a").alias("class")).unionAll(near.select("b")).distinct())
        x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
        tested = near.hint("merge").join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(verify(num, den), "a binary, b binary, linked boolean")
        links = store.materialize(tested.where("linked").select("a", "b"), "linked")
        store.drop(docs.sparkSession, sets)
        return links

    links = linked(near)
    further = block_links(ties, links, kinds, fetch, num, den)
    links = store.materialize(links.unionAll(further), "links")
    store.drop(docs.sparkSession, found, near)
    return profiles.drop("sketch", "digest"), links


def block_links(ties: DataFrame, links: DataFrame, kinds: DataFrame, fetch, num: int, den: int) -> DataFrame:
    """Links between components of one family, found block by block.

    Any two classes of a large group are tied to its leader, by themselves or by the class
    that speaks for them in their chunk, so they are in one family.  It is cut into the
    size bands that its similar pairs share.  In a band, the classes outside its largest
    component are guests, in blocks of their own; every block of the band meets every block
    of guests.  So work follows the guests times the band, and classes of the largest
    component never meet one another.
    """
    spark = ties.sparkSession
    family, label = components(ties), components(links)
    placed = family.select(F.col("node").alias("class"), F.col("root").alias("cluster")).join(label.toDF("class", "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    placed = store.materialize(placed.join(kinds.select("class", "size"), "class"), "placed")
    largest = placed.agg(F.max("size")).first()[0] or 1
    own = F.size(F.filter(F.array(*(F.lit(int(x)) for x in Bands(num, den).upto(largest))), lambda x: x <= F.col("size")))
    bands = F.inline(F.array(F.struct(own.alias("band"), F.lit(False).alias("upper")), F.struct((own - 1).alias("band"), F.lit(True).alias("upper"))))
    banded = placed.select("class", "cluster", "root", "size", bands)
    per = banded.groupBy("cluster", "band", "root").agg(F.sum("size").alias("s"))
    per = per.groupBy("cluster", "band").agg(F.max_by("root", F.struct("s", "root")).alias("first"), F.sum("s").alias("all"), F.max("s").alias("most"), F.count("*").alias("n")).where("n > 1")
    blocks = lambda size: F.ceil(size / BLOCK).cast("int")
    per = per.select("cluster", "band", "first", blocks(F.col("all")).alias("blocks"), blocks(F.col("all") - F.col("most")).alias("guests"))
    rows = store.materialize(banded.join(per, ["cluster", "band"]).withColumn("main", F.col("root") == F.col("first")), "banded")
    sets = fetch(rows.select("class").distinct())
    rows = rows.hint("merge").join(sets, "class")
    of = lambda n, seed: F.pmod(F.xxhash64("class", F.lit(seed)), F.col(n)).cast("int")
    all_ = lambda n: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: k.cast("int"))
    home = F.transform(all_("guests"), lambda j: F.struct(F.lit(False).alias("guest"), of("blocks", 0).alias("i"), j.alias("j")))
    away = F.transform(all_("blocks"), lambda i: F.struct(F.lit(True).alias("guest"), i.alias("i"), of("guests", 1).alias("j")))
    dealt = rows.select("cluster", "band", "upper", "main", "class", "root", "size", "items", F.inline(F.when(F.col("main"), home).otherwise(F.concat(home, away))))
    met = dealt.groupBy("cluster", "band", "i", "j").applyInArrow(compare_blocks(num, den), "a binary, b binary")
    met = store.materialize(met, "joined")
    store.drop(spark, placed, rows, sets)
    return met


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, carry: tuple[Column, ...] = ()) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of n-word shingles, num / den or more.

    Returns doc_id, n_shingles and component_id, the smallest doc_id reachable by links,
    for every row.  A text without words (or null) has no shingles and no links; a text of
    fewer than n words is one shingle.  Rows without an id link like others, and lend no
    id to their component.  A very long text is one task's chunk: its shingles are hashed
    and sorted there whole.  Other columns are not read; columns in carry come along.
    """
    profiles, links = jaccard_classes(docs, id_col, text_col, n, num, den, carry)
    label = components(links)
    kinds = profiles.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    roots = kinds.join(label, kinds["class"] == label["node"], "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    roots = store.materialize(roots, "roots")
    best = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(best, "root").select("class", "component_id")
    out = profiles.join(named, "class", "left")
    return out.select(*profiles.drop("class").columns, F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that lead their group: those with its smallest id, each once.

    A row without an id stays if no row with an id is in its group.  Cases are those of
    jaccard_join; very long texts stay whole.  Only rows whose key may be that of a row that
    goes, or of one that stands more than once, are shuffled.
    """
    name = store.unused(docs, "key")
    groups = jaccard_join(docs, id_col, text_col, carry=(store.key_of(id_col, text_col).alias(name),), **how)
    leads = F.col("doc_id").eqNullSafe(F.col("component_id"))
    per = groups.groupBy(name).agg(F.bool_or(leads).alias("leads"), F.count("*").alias("n")).where("NOT leads OR n > 1")
    doubtful = store.materialize(per, "doubtful")
    rows, hit = keybits.maybe(docs.withColumn(name, store.key_of(id_col, text_col)), F.col(name), keybits.bitmap(doubtful, name))
    columns = [*docs.columns, name]
    sure = rows.where(~hit).select(*columns)
    judged = rows.where(hit).select(*columns)
    once = judged.hint("merge").join(doubtful.select(name), name, "left_anti").select(*columns)
    again = judged.hint("merge").join(doubtful.where("leads").select(name), name, "left_semi").dropDuplicates([name]).select(*columns)
    return sure.unionAll(once).unionAll(again).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(store.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
      UNION ALL SELECT doc_id, w FROM d WHERE len(w) IN (1, 2)),
u AS (SELECT DISTINCT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
r AS (SELECT g FROM u GROUP BY g HAVING count(*) > 1),
v AS (SELECT u.doc_id, u.g FROM u JOIN r USING (g)),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM v a JOIN v b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(m.r AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id) m USING (doc_id)
"""
