"""Best-fit packing by exact-complement hashing.

Only piece lengths decide a packing, and there are at most `limit` of them, so the whole
corpus is planned from one histogram.  An index holds, for every sum of one, two or three
available lengths, one way to make it.  For the longest length left, the lengths that fill
its gap exactly are looked up there and used as often as all of them last; what has no
exact complement is placed best-fit.  A plan is a short list of patterns with
counts.  Every piece gets its number among pieces of its length from two levels of
counts (inside its task, then over tasks), and that number says which sequence it is in.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blobs, store
from . import textarrays as ta

END = 2
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
#: White space in a row that the rank encoder is not given; it fails at about a million.
BLANKS = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def encoder(path: str):
    """text -> its ids as little-endian 32-bit numbers.

    The tokenizer's file gives the byte strings of its ids, in the order of its merges;
    a rank encoder merges by the same order over the same splits and is several times
    faster.  A text with the special string goes to the tokenizer itself, and so does one
    with so long a run of white space that the splits of the rank encoder can't step back
    over it.  The search for such a run starts only where one begins, so it reads each
    character a bounded number of times.
    """
    import json
    import re

    import tiktoken
    from tokenizers import Tokenizer

    memo = ta.process_memo()
    if ("bpe", path) not in memo:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        memo["bpe", path] = fast
    fast = memo["bpe", path]
    blank = re.compile(r"(?<!\s)\s{%d}" % BLANKS)

    def encode(text: str) -> bytes:
        if SPECIAL in text or (len(text) > BLANKS and blank.search(text)):
            tokenizer = memo.get(("tokenizer", path)) or memo.setdefault(("tokenizer", path), Tokenizer.from_file(path))
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    return encode


def cut(path: str, limit: int):
    """Pieces of every row, numbered inside the task by length."""

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(path)
        part = TaskContext.get().partitionId()
        seen = [0] * (limit + 1)
        end = np.array([END], "<u4").tobytes()
        kinds = (pa.int64(), pa.int32(), *(pa.int64() for _ in range(5)))
        out = blobs.Rows(pa.schema(list(zip(("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"), kinds, strict=True))), 8 << 20)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n, at, piece, doc = len(ids) // 4, 0, 0, doc_id.as_py()
                size = n % limit or limit
                while at < n:
                    out.add(doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), part, seen[size])
                    seen[size] += 1
                    at, piece, size = at + size, piece + 1, limit
                yield from out.ready()
            ta.give_back()
        yield out.flush()

    return run


class Sums:
    """Single, pair and triple sums of available lengths; availability may only fall.

    pair[s] and triple[s] are the longest parts of a way to make s, 0 if there is none.  An
    entry whose lengths have run out is looked for again when it is asked for.
    """

    def __init__(self, have: np.ndarray):
        self.have, n = have, len(have)
        self.pair = [self.find_pair(s, s) for s in range(n)]
        self.triple = [-1] * n  # -1: not looked for yet

    def find_pair(self, total: int, longest: int) -> int:
        """The longest length of up to `longest` that another one of at most its size completes."""
        a = np.arange(min(longest, total - 1), (total + 1) // 2 - 1, -1)
        ok = (self.have[a] > 0) & (self.have[total - a] > 0) & ((a != total - a) | (self.have[a] > 1))
        return int(a[ok.argmax()]) if ok.any() else 0

    def pair_of(self, total: int) -> tuple[int, int] | None:
        a = self.pair[total]
        if a and not self.good(a, total - a):
            a = self.pair[total] = self.find_pair(total, a)
        return (a, total - a) if a else None

    def good(self, *lengths: int) -> bool:
        return all(self.have[x] >= lengths.count(x) for x in lengths)

    def triple_of(self, total: int) -> tuple[int, int, int] | None:
        c = self.triple[total]
        c = total - 2 if c < 0 else c
        while c >= (total + 2) // 3 and c > 0:
            if self.have[c] > 0:
                rest = total - c
                a = self.pair[rest]
                if a and not (a <= c and self.good(c, a, rest - a)):
                    a = self.below(rest, c)
                if a:
                    self.triple[total] = c
                    return (c, a, rest - a)
            c -= 1
        self.triple[total] = 0
        return None

    def below(self, total: int, c: int) -> int:
        """As find_pair, with no length over c, one of which is taken."""
        self.have[c] -= 1
        a = self.find_pair(total, min(c, total - 1))
        self.have[c] += 1
        return a

    def exact(self, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """Up to `most` available lengths that fill a gap exactly, longest first."""
        if self.have[gap] > 0:
            return (gap,)
        return (self.pair_of(gap) if most > 1 else None) or (self.triple_of(gap) if most > 2 else None)


def exact(have: np.ndarray, gap: int, most: int) -> tuple[int, ...] | None:
    """Up to `most` (3) available lengths that fill a gap exactly, longest first."""
    return Sums(have).exact(gap, most)


def plan(count: np.ndarray, limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how often, [(length, how many)]) that use every piece once.

    A sequence starts with the longest length left.  If up to three lengths fill its gap
    exactly, they do; else the longest piece that fits goes in, and the smaller gap is
    looked up again.  The content found is used as often as its lengths last, so the list
    is short whatever the counts are.
    """
    left = count.copy()
    sums, out = Sums(left), []
    for length in range(limit, 0, -1):
        while left[length] > 0:
            content, gap = [length], limit - length
            left[length] -= 1
            while gap and left[1 : gap + 1].any():
                fill = sums.exact(gap) or (int(np.flatnonzero(left[: gap + 1])[-1]),)
                content += fill
                np.subtract.at(left, list(fill), 1)
                gap -= sum(fill)
            need = np.bincount(content, minlength=limit + 1)
            used = np.flatnonzero(need)
            more = int((left[used] // need[used]).min())
            left -= more * need
            out.append((1 + more, [(x, content.count(x)) for x in dict.fromkeys(content)]))
    return out


class Places:
    """For each length: which numbers of pieces go where."""

    def __init__(self, patterns, limit: int):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        used, base = [0] * (limit + 1), 0
        for times, content in patterns:
            offset = 0
            for length, each in content:
                for _ in range(each):
                    slots.setdefault(length, []).append((used[length], base, offset))
                    used[length] += times
                    offset += length
            base += times
        self.slots = {n: np.array(s, np.int64) for n, s in slots.items()}
        self.sequences = base

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            here = length == n
            s = self.slots[int(n)]
            k = np.searchsorted(s[:, 0], number[here], "right") - 1
            sequence[here] = s[k, 1] + number[here] - s[k, 0]
            offset[here] = s[k, 2]
        return sequence, offset


def place(places: Places):
    def run(batches):
        for b in batches:
            sequence, offset = places.find(b.column("length").to_numpy(), b.column("number").to_numpy())
            names = [n for n in b.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """Packs the token ids of all rows into sequences of at most `limit` tokens.

    A row is its text's ids and an end token (null text: that token alone).  Longer rows
    are cut so that all pieces but the first are full.  One row per piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset.  Rows without an id and repeated rows
    are packed like others.  A very long text is encoded whole by one task, in time that
    grows with its length alone; long runs of one kind of character are no special case.

    Pieces are dealt to the counts of their task by a shuffle join; nothing that grows with
    the number of tasks is broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = store.materialize(rows.mapInArrow(cut(tokenizer or default_tokenizer(), limit), PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = store.materialize(counts.select("length", "part", "n", before.alias("before")), "starts")
    count = np.zeros(limit + 1, np.int64)
    for r in starts.groupBy("length").agg(F.sum("n")).collect():
        count[r[0]] = r[1]
    places = Places(plan(count, limit), limit)
    numbered = pieces.hint("shuffle_hash").join(starts.drop("n").hint("shuffle_hash"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("number"))
    return numbered.mapInArrow(place(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(store.table(spark, sf_dir, "documents"))
