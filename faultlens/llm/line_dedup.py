"""Line dedup over a suffix array of line sequences.

Documents are sequences of lines with a word.  Lines that occur once are found first, by
a packed exchange of line names; only repeated lines are suffixes.  A round ranks suffixes
by four blocks of as many lines as the last round has told apart, which doubles the known
prefix twice.  The state is one row of arrays per chunk, so the ranks of later blocks are
looked up in place; only suffixes that are still tied send keys, each distinct key of a
chunk once.  Keys are counted, sorted by range and numbered inside their class, so a line
that fills a third of the corpus is one key.  Where a class is cut, the number of equal
blocks bounds the longest common prefix of the two suffixes at the cut.

In the finished array every suffix has a longest common prefix with the one before it.  It
is exact where suffixes are equal or were told apart by blocks of one line, one less than
that of the line above where both go on together, and else counted by comparing the lines
between its bounds.  The sum of what is compared stays within n log n lines, as that of
irreducible common prefixes does.  Stretches of the array where prefixes have min_lines
lines or more are the intervals: the first position of one in (id, line) order keeps its
lines, and those lines of the others are deleted.  Windows that overlap make up the
maximal run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blobs, store
from . import chunktable as ct
from . import textarrays as ta
from .quality_rules import Lines
from .substring_dedup import answer_shared

U = np.uint64
LINES = "rows binary, a binary, b binary, rest binary"
KEY = ["k0", "k1", "k2", "k3"]
PLACES = (("at", np.int32), ("left", np.int32), ("doc", np.int64), ("rank", np.int64), ("low", np.int32), ("high", np.int32), ("tied", bool))
STATE = "cid long, " + ", ".join(f"{n} binary" for n, _ in PLACES) + ", keys binary, which binary, longest long"
STATE_ARROW = pa.schema([("cid", pa.int64()), *((n, pa.binary()) for n, _ in PLACES), ("keys", pa.binary()), ("which", pa.binary()), ("longest", pa.int64())])


def beside(c: ta.Chunk, rows: pa.RecordBatch) -> list[bytes]:
    """The row and a 128-bit name of each line of a chunk, and the carried columns."""
    lines = Lines(c)
    rest = pa.record_batch(rows.columns[2:], names=rows.schema.names[2:]) if rows.num_columns > 2 else None
    sink = pa.BufferOutputStream()
    if rest is not None:
        with pa.ipc.new_stream(sink, rest.schema) as w:
            w.write_batch(rest)
    a, b = c.span_names(lines.begin, lines.end)
    return [lines.row.astype(np.int32).tobytes(), a.tobytes(), b.tobytes(), sink.getvalue().to_pybytes()]


def line_arrays(r: dict):
    """Ids of lines' documents, rows, names, and lines of known documents."""
    row = np.frombuffer(r["rows"], np.int32)
    ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)
    return ids[row], row, np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint64), known[row]


def send_lines(n_buckets: int):
    def run(batches):
        out = blobs.Rows(blobs.KEYS)
        for r in ct.each(batches):
            _, _, a, _, known = line_arrays(r)
            keys = np.unique(a[known])
            for k, cut in blobs.Split(keys, n_buckets):
                out.add(r["cid"], k, keys[cut].tobytes(), b"")
            yield from out.ready()
        yield out.flush()

    return run


class Suffixes:
    """A chunk's suffixes: line, lines left, document, rank, bounds of the prefix shared with the one before, whether tied."""

    def __init__(self, cid: int, **arrays):
        self.cid = cid
        self.__dict__.update(arrays)

    @classmethod
    def of(cls, r: dict) -> Suffixes:
        return cls(r["cid"], **{n: np.frombuffer(r[n], t).copy() for n, t in PLACES})

    def save(self, out: blobs.Rows, keys: np.ndarray) -> None:
        """Adds the state with the keys of the tied suffixes, distinct ones and which each has."""
        some, which = np.unique(keys, axis=0, return_inverse=True)
        longest = int(self.left[self.tied].max()) if self.tied.any() else 0
        out.add(self.cid, *(getattr(self, n).astype(t).tobytes() for n, t in PLACES), some.astype(np.int64).tobytes(), which.ravel().astype(np.int32).tobytes(), longest)

    def keys(self, width: int) -> np.ndarray:
        """Ranks of four blocks of `width` lines from each tied suffix on; after a line that occurs once or the end, zeros."""
        i = np.flatnonzero(self.tied)
        out = np.zeros((len(i), 4), np.int64)
        out[:, 0] = self.rank[i]
        on = np.ones(len(i), bool)
        for k in (1, 2, 3):
            line = self.at[i].astype(np.int64) + k * width
            inside = on & (self.left[i] > k * width)
            place = np.minimum(np.searchsorted(self.at, line), max(0, len(self.at) - 1))
            repeated = inside & (self.at[place] == line) if len(i) else inside
            once = -2 - (ta.mix(line.astype(np.uint64) * ta.ODD[0] + ta.mix(np.full(len(i), self.cid, np.uint64))) >> U(2)).astype(np.int64)
            out[:, k] = np.where(repeated, self.rank[place] if len(i) else 0, np.where(inside, once, np.where(on, -1, 0)))
            on = repeated
        return out


def repeated(n_buckets: int):
    """The first state: suffixes at lines that occur twice, all of one class, keyed by their lines' names."""

    def run(batches):
        out = blobs.Rows(STATE_ARROW)
        for r in ct.each(batches):
            ids, row, a, b, known = line_arrays(r)
            keys, which, count = np.unique(a[known], return_inverse=True, return_counts=True)
            hit = np.zeros(len(a), bool)
            hit[known] = ((count > 1) | blobs.Split(keys, n_buckets).unpack(r["shared"]))[which] if len(keys) else False
            at = np.flatnonzero(hit)
            left = np.searchsorted(row, row, "right") - np.arange(len(row))
            zero = np.zeros(len(at), np.int64)
            names = np.stack([zero, a[at].view(np.int64), b[at].view(np.int64), zero], axis=1)
            Suffixes(r["cid"], at=at, left=left[at], doc=ids[at], rank=zero, low=zero, high=zero, tied=np.ones(len(at), bool)).save(out, names)
            yield from out.ready()
        yield out.flush()

    return run


def key_rows(batches):
    """(cid, j, key, n): a chunk's distinct keys."""
    for r in ct.each(batches):
        keys = np.frombuffer(r["keys"], np.int64).reshape(-1, 4)
        n = np.bincount(np.frombuffer(r["which"], np.int32), minlength=len(keys))
        cols = [np.full(len(keys), r["cid"]), np.arange(len(keys), dtype=np.int32), *keys.T, n]
        yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in cols], names=["cid", "j", *KEY, "n"])


def number(batches):
    """For sorted keys: the partition, how many of their class stand before them in it, and how many blocks they share with the key before (0: first of the class, -1: first of the partition)."""
    from pyspark import TaskContext

    part, last, total = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in KEY], axis=1)
        n = b.column("n").to_numpy()
        before = np.concatenate([k[:1] if last is None else last[None], k[:-1]])
        same = np.cumprod(k == before, axis=1)
        shared = same.sum(1)
        if last is None:
            shared[0] = -1
        opens = np.flatnonzero(same[:, 0] == 0)
        until = np.cumsum(n) - n + total
        base = np.zeros(len(n), np.int64)
        base[opens] = until[opens]
        off = until - np.maximum.accumulate(base)
        total, last = int(off[-1] + n[-1]), k[-1]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(off), pa.array(shared.astype(np.int32))], [*b.schema.names, "part", "off", "shared"])


def ranked(keys: DataFrame, width: int) -> DataFrame:
    """Distinct keys with their rank, how many suffixes have them, and bounds of the prefix shared with the class before (null: that of the old class)."""
    counted = keys.groupBy(*KEY).agg(F.sum("n").alias("n")).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    rows = store.materialize(counted.mapInArrow(number, ", ".join(f"{c} long" for c in KEY) + ", n long, part int, off long, shared int"), "ranks")
    ends = rows.groupBy("part").agg(F.min("k0"), F.max(F.struct("k0", (F.col("off") + F.col("n")).alias("n")))).orderBy("part").collect()  # one row a partition
    open_, size, more = None, 0, []
    for part, lo, (hi, n) in ends:
        more.append((part, lo, size if lo == open_ else 0))
        open_, size = hi, n + (size if lo == hi == open_ else 0)
    parts = keys.sparkSession.createDataFrame(more, "part int, lo long, more long")
    off = F.col("off") + F.when(F.col("k0") == F.col("lo"), F.col("more")).otherwise(0)
    low = F.when(off > 0, F.when(F.col("shared") > 0, F.col("shared") * width).otherwise(width))
    high = F.when(off > 0, F.when(F.col("shared") > 0, (F.col("shared") + 1) * width - 1).otherwise(4 * width - 1))
    return rows.join(F.broadcast(parts), "part").select(*KEY, "n", (F.col("k0") + off).alias("rank"), low.cast("int").alias("low"), F.greatest(high, F.lit(0)).cast("int").alias("high"))


def refine(width: int):
    """The state after a round, with the keys of the next one, whose blocks have `width` lines."""

    def run(batches):
        out = blobs.Rows(STATE_ARROW)
        for r in ct.each(batches):
            s, which = Suffixes.of(r), np.frombuffer(r["which"], np.int32)
            got = sorted((x["j"], x["rank"], x["n"], -1 if x["low"] is None else x["low"], -1 if x["high"] is None else x["high"]) for x in r["replies"] or ())
            rank, n, low, high = np.array([x[1:] for x in got], np.int64).reshape(-1, 4).T[:, which]
            i = np.flatnonzero(s.tied)
            s.rank[i], s.tied[i] = rank, n > 1
            s.low[i], s.high[i] = np.where(low < 0, s.low[i], low), np.where(low < 0, s.high[i], high)
            s.save(out, s.keys(width))
            yield from out.ready()
        yield out.flush()

    return run


def suffix_ranks(state: DataFrame) -> DataFrame:
    """Rounds until no tied suffix has a line beyond the prefix that is known."""
    width = 0
    while True:
        keys = store.materialize(state.mapInArrow(key_rows, "cid long, j int, " + ", ".join(f"{c} long" for c in KEY) + ", n long"), "keys")
        ranks = ranked(keys, width)
        replies = keys.drop("n").join(ranks.hint("merge"), KEY).groupBy("cid").agg(F.collect_list(F.struct("j", "rank", "n", "low", "high")).alias("replies"))
        width = max(1, 4 * width)
        old, state = state, store.materialize(state.join(replies.hint("merge"), "cid", "left").mapInArrow(refine(width), STATE), "suffixes")
        store.drop(state.sparkSession, old, keys, ranks)
        if (state.agg(F.max("longest")).first()[0] or 0) <= width:
            return state


def suffix_rows(batches):
    for r in ct.each(batches):
        s = Suffixes.of(r)
        cols = [s.rank, s.doc, np.full(len(s.at), r["cid"]), s.at, s.left, s.low, s.high]
        yield pa.record_batch([pa.array(c) for c in cols], names=["rank", "doc", "cid", "l", "left", "low", "high"])


ARRAY = "rank long, doc long, cid long, l int, left int, low int, high int, part int, g long, cid0 long, l0 int, left0 int"


def neighbours(batches):
    """For sorted suffixes: partition, place in it, and the suffix before (null for the first); equal suffixes share all that is left."""
    from pyspark import TaskContext

    part, g, last = TaskContext.get().partitionId(), 0, None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        rank, cid, l, left, low, high = (b.column(c).to_numpy() for c in ("rank", "cid", "l", "left", "low", "high"))
        first = last or (-1, -1, -1, -1)
        rank0, cid0, l0, left0 = (np.concatenate([np.array([x], v.dtype), v[:-1]]) for x, v in zip(first, (rank, cid, l, left), strict=True))
        same, none = rank == rank0, np.arange(n) + g == 0
        cols = [*b.columns[:5], pa.array(np.where(same, left, low)), pa.array(np.where(same, left, high)), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n) + g), pa.array(cid0, mask=none), pa.array(l0, mask=none), pa.array(left0, mask=none)]
        yield pa.RecordBatch.from_arrays(cols, ["rank", "doc", "cid", "l", "left", "low", "high", "part", "g", "cid0", "l0", "left0"])
        g, last = g + n, (rank[-1], cid[-1], l[-1], left[-1])


def suffix_array(state: DataFrame) -> DataFrame:
    """All suffixes in order: part and g say where, cid0 and l0 which one stands before."""
    order = ["rank", "doc", "cid", "l"]
    rows = state.mapInArrow(suffix_rows, "rank long, doc long, cid long, l int, left int, low int, high int")
    rows = store.materialize(rows, "rows")  # sampled for ranges before it is sorted
    array = store.materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(neighbours, ARRAY), "array")
    store.drop(state.sparkSession, rows)
    ends = array.groupBy("part").agg(F.max(F.struct("g", "rank", "cid", "l", "left"))).orderBy("part").collect()  # one row a partition
    before = [(ends[k + 1][0], *ends[k][1][1:]) for k in range(len(ends) - 1)]
    before = state.sparkSession.createDataFrame(before, "part int, r long, c long, i int, f int")
    same = (F.col("g") == 0) & (F.col("r") == F.col("rank"))
    either = lambda name, value: F.when(same, F.col("left")).otherwise(F.when((F.col("g") == 0) & F.col("c").isNull(), 0).otherwise(F.col(name))).alias(name)
    joined = array.join(F.broadcast(before), "part", "left")
    return joined.select("part", "g", "doc", "cid", "l", F.coalesce("cid0", "c").alias("cid0"), F.coalesce("l0", "i").alias("l0"), F.coalesce("left0", "f").alias("left0"), either("low", "low"), either("high", "high"))


class Pairs:
    """A chunk's suffixes with the ones before them, by line; told: the line above goes on together with the same one."""

    def __init__(self, r: dict):
        rows = sorted(r["pairs"], key=lambda x: x["l"])
        col = lambda n: np.array([-1 if x[n] is None else x[n] for x in rows], np.int64)
        self.part, self.g, self.doc, self.l, self.cid0, self.l0, left0, self.low, self.high = (col(n) for n in ("part", "g", "doc", "l", "cid0", "l0", "left0", "low", "high"))
        row = np.frombuffer(r["rows"], np.int32)[self.l]
        self.told = np.zeros(len(rows), bool)
        self.told[1:] = (self.l[1:] == self.l[:-1] + 1) & (row[1:] == row[:-1]) & (self.cid0[1:] == self.cid0[:-1]) & (self.l0[1:] == self.l0[:-1] + 1) & (left0[:-1] > 1) & (self.low[:-1] > 0)


ASKED = pa.schema([("cid0", pa.int64()), ("l0", pa.int32()), ("cid", pa.int64()), ("l", pa.int32()), ("low", pa.int32()), ("names", pa.binary())])


def ask(batches):
    """For each prefix that must be counted, the names of the lines between its bounds."""
    out = blobs.Rows(ASKED)
    for r in ct.each(batches):
        p, row, names = Pairs(r), np.frombuffer(r["rows"], np.int32), line_names(r)
        for i in np.flatnonzero(~p.told & (p.low < p.high)):
            line = int(p.l[i])
            end = min(int(np.searchsorted(row, row[line], "right")), line + int(p.high[i]))
            out.add(int(p.cid0[i]), int(p.l0[i]), r["cid"], line, int(p.low[i]), names[line + p.low[i] : end].tobytes())
            yield from out.ready()
    yield out.flush()


def line_names(r: dict) -> np.ndarray:
    return np.stack([np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint64)], axis=1)


def answer(batches):
    """How many of the lines asked about are those of the suffix before."""
    schema = pa.schema([("cid", pa.int64()), ("l", pa.int32()), ("lcp", pa.int32())])
    for r in ct.each(batches):
        row, names, out = np.frombuffer(r["rows"], np.int32), line_names(r), []
        for q in r["asked"]:
            theirs = np.frombuffer(q["names"], np.uint64).reshape(-1, 2)
            begin, end = q["l0"] + q["low"], int(np.searchsorted(row, row[q["l0"]], "right"))
            mine = names[begin : min(end, begin + len(theirs))]
            apart = np.flatnonzero((mine != theirs[: len(mine)]).any(1))
            out.append((q["cid"], q["l"], q["low"] + (int(apart[0]) if len(apart) else len(mine))))
        yield pa.record_batch([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)


def resolve(batches):
    """All longest common prefixes of a chunk's suffixes; starts: not told by the line above."""
    for r in ct.each(batches):
        p = Pairs(r)
        lcp = p.low.copy()
        counted = {x["l"]: x["lcp"] for x in r["answers"] or ()}
        for i in np.flatnonzero(~p.told & (p.low < p.high)):
            lcp[i] = counted[int(p.l[i])]
        start = np.maximum.accumulate(np.where(p.told, 0, np.arange(len(lcp))))
        lcp = lcp[start] - (p.l - p.l[start])
        cols = [p.part.astype(np.int32), p.g, p.doc, np.full(len(lcp), r["cid"]), p.l.astype(np.int32), p.cid0, p.l0.astype(np.int32), lcp.astype(np.int32), ~p.told]
        yield pa.record_batch([pa.array(c) for c in cols], names=["part", "g", "doc", "cid", "l", "cid0", "l0", "lcp", "start"])


def common_prefixes(array: DataFrame, table: DataFrame) -> DataFrame:
    """The suffix array with lcp, the lines each suffix shares with the one before it."""
    names = table.select("cid", "rows", "a", "b")
    pairs = array.groupBy("cid").agg(F.collect_list(F.struct("part", "g", "doc", "l", "cid0", "l0", "left0", "low", "high")).alias("pairs"))
    pairs = store.materialize(names.join(pairs.hint("merge"), "cid"), "pairs")
    asked = pairs.mapInArrow(ask, "cid0 long, l0 int, cid long, l int, low int, names binary").groupBy("cid0").agg(F.collect_list(F.struct("l0", "cid", "l", "low", "names")).alias("asked"))
    counted = asked.withColumnRenamed("cid0", "cid").hint("merge").join(names, "cid").mapInArrow(answer, "cid long, l int, lcp int")
    answers = store.materialize(counted.groupBy("cid").agg(F.collect_list(F.struct("l", "lcp")).alias("answers")), "answers")
    rows = pairs.drop("a", "b").join(answers.hint("merge"), "cid", "left").mapInArrow(resolve, "part int, g long, doc long, cid long, l int, cid0 long, l0 int, lcp int, start boolean")
    out = store.materialize(rows, "lcp")
    store.drop(array.sparkSession, pairs, answers)
    return out


def intervals(lcp: DataFrame, min_lines: int) -> DataFrame:
    """doc, cid, l and interval (two columns) of suffixes: stretches of the array whose prefixes have min_lines lines or more."""
    cut = F.when(F.col("lcp") < min_lines, F.col("g"))
    ends = lcp.groupBy("part").agg(F.max(cut)).orderBy("part").collect()  # one row a partition
    last, open_ = None, []
    for part, g in ends:
        open_.append((part, *(last or (-1, -1))))
        last = (part, g) if g is not None else last
    open_ = lcp.sparkSession.createDataFrame(open_, "part int, p int, q long")
    mine = F.max(cut).over(Window.partitionBy("part").orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    rows = lcp.select("part", "doc", "cid", "l", mine.alias("mine")).join(F.broadcast(open_), "part")
    return rows.select("doc", "cid", "l", F.when(F.col("mine").isNull(), F.col("p")).otherwise(F.col("part")).alias("ipart"), F.coalesce("mine", "q").alias("ig"))


TEXTS = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64()), ("longest_run", pa.int64()), ("kept_text", pa.string())])
OUT = "doc_id long, n_lines long, n_removed long, n_runs long, longest_run long, kept_text string"


def cut_lines(min_lines: int):
    def run(batches):
        for r in ct.each(batches):
            ids, known, chunk = ct.unpack(r)
            lines = Lines(chunk)
            starts = np.array(sorted(r["later"] or ()), np.int64)
            edge = np.zeros(len(lines.row) + 1, np.int64)
            edge[starts] += 1
            edge[starts + min_lines] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1] | (lines.row[1:] != lines.row[:-1])
            longest = np.zeros(chunk.n, np.int64)
            for m in r["lcps"] or ():
                k = lines.row[m["l"]]
                longest[k] = max(longest[k], m["lcp"])
            raw, texts = chunk.data.tobytes(), []
            for k in range(chunk.n):
                lo, hi = lines.bounds[k], lines.bounds[k + 1]
                at, end, parts = int(chunk.offsets[k]), int(chunk.offsets[k + 1]), []
                for j in lo + np.flatnonzero(gone[lo:hi]):
                    parts.append(raw[at : lines.begin[j]])
                    at = min(int(lines.end[j]) + 1, end)
                parts.append(raw[at:end])
                left = b"".join(parts)
                texts.append((left[:-1] if at == end and len(parts) > 1 and left.endswith(b"\n") and not raw[:end].endswith(b"\n") else left).decode("utf-8", "replace"))
            per = [np.diff(lines.bounds), *(np.add.reduceat(np.append(x, 0).astype(np.int64), lines.bounds[:-1]) * (np.diff(lines.bounds) > 0) for x in (gone, opens)), longest]
            out = pa.record_batch([pa.array(ids, mask=~known), *(pa.array(x) for x in per), pa.array(texts, pa.string())], schema=TEXTS)
            if r["rest"]:
                rest = pa.ipc.open_stream(r["rest"]).read_next_batch()
                out = pa.RecordBatch.from_arrays([*out.columns, *rest.columns], [*out.schema.names, *rest.schema.names])
            yield out

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deletes later copies of runs of min_lines or more equal lines.

    The first copy is the one with the smallest (id, line).  Lines without a word are no
    part of runs and stay.  Null text: empty.  A row without an id neither deletes nor
    loses lines.  Rows of one id are in the order in which they are read.  A very long text
    is a chunk of its own, whose arrays one task holds at a time.

    Returns doc_id, n_lines (with a word), n_removed, n_runs (stretches removed),
    longest_run (the longest run of min_lines or more, also found elsewhere, that starts in
    the document), kept_text, and the columns named in carry as __name.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be positive")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"__{c}") for c in carry))
    packed = ct.pack(beside, ("rows", "a", "b", "rest"))
    table = store.materialize(rows.mapInArrow(packed, f"{ct.SCHEMA}, {LINES}"), "chunks", "none")
    narrow = table.select("cid", "ids", "known", "rows", "a", "b")
    n = blobs.number_for(store.total_bytes(table), 64 << 20)
    shared = ct.gathered(narrow.mapInArrow(send_lines(n), blobs.ROW), answer_shared)
    state = store.materialize(ct.with_replies(narrow, shared=shared).mapInArrow(repeated(n), STATE), "suffixes")
    lcp = common_prefixes(suffix_array(suffix_ranks(state)), table)
    inside = store.materialize(intervals(lcp, min_lines), "intervals")
    heads = inside.groupBy("ipart", "ig").agg(F.min(F.struct("doc", "cid", "l")).alias("head"), F.count("*").alias("size")).where("size > 1")
    heads = store.materialize(heads, "heads")  # then both sides of the join are plain exchanges, which can be split
    later = inside.join(heads.hint("merge"), ["ipart", "ig"]).where((F.col("cid") != F.col("head.cid")) | (F.col("l") != F.col("head.l")))
    marks = later.groupBy("cid").agg(F.collect_list("l").alias("later"))
    long = lcp.where(F.col("start") & (F.col("lcp") >= min_lines))
    runs = long.select("cid", "l", "lcp").unionAll(long.select("cid0", "l0", "lcp")).groupBy("cid").agg(F.collect_list(F.struct("l", "lcp")).alias("lcps"))
    marked = store.materialize(marks.hint("merge").join(runs, "cid", "full"), "marks")
    store.drop(docs.sparkSession, lcp, inside, heads)
    return table.drop("rows", "a", "b").join(marked.hint("merge"), "cid", "left").mapInArrow(cut_lines(min_lines), ", ".join([OUT, *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:])]))


def query(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(store.table(spark, sf_dir, "documents"), min_lines=1)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2("kept_text", 256).alias("kept_sha256"))


#: A run is a diagonal of equal lines of two places; the longest that a document has part in.
SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
n AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS l FROM p WHERE len(regexp_extract_all(line, '[^ 	-
]+')) > 0),
r AS (SELECT doc_id, l, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, l) AS k FROM n),
g AS (SELECT doc_id, l, i, l - row_number() OVER (PARTITION BY doc_id ORDER BY l) AS stretch FROM r WHERE k > 1),
e AS (SELECT x.doc_id, y.doc_id AS other, x.l - y.l AS diagonal, x.l AS l FROM n x JOIN n y ON x.line = y.line AND (x.doc_id <> y.doc_id OR x.l <> y.l)),
m AS (SELECT doc_id, other, diagonal, l - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY l) AS stretch FROM e),
o AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, count(*) AS c FROM m GROUP BY doc_id, other, diagonal, stretch) GROUP BY doc_id),
k AS (SELECT p.doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM p ANTI JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(coalesce(a.c, 0) AS BIGINT) AS n_lines, CAST(coalesce(b.c, 0) AS BIGINT) AS n_removed, CAST(coalesce(b.s, 0) AS BIGINT) AS n_runs, CAST(coalesce(longest, 0) AS BIGINT) AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS c FROM n GROUP BY doc_id) a USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS c, count(DISTINCT stretch) AS s FROM g GROUP BY doc_id) b USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)
"""
