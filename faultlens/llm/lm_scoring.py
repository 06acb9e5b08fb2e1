"""Language-model scores of whole texts: a unigram base, and a causal self-attention model.

A text is its words, A-Z lower-cased, and one end.  It is read once: a chunk of texts keeps
the names of its distinct words, their subword ids, and which word stands where.  The names
meet in buckets, where the counts of the whole training part are summed, and each chunk
gets those of its words back.  Counts of subword ids over the whole training part give the
model its vocabulary and what its distributions are smoothed to.  Its weights are learned from
all training windows: from a start that the driver learns from some, drawn by hash, every shard
of the windows (dealt by hash, in an order of their own) makes one pass, and the shards' weights
are averaged; the distributions are what all windows give them, summed.  Then every
chunk is scored: the base by its counts, the model by windows that overlap and score each
id once.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, chunktable, store
from . import textarrays as ta
from .attention import WINDOW, Model
from .packing import PATTERN

U = np.uint64
#: Ids of the vocabulary; behind them the end of a text and its beginning.
IDS = 50_256
END, BEGIN = IDS, IDS + 1
#: Characters of a word that are encoded at once, bytes of a chunk, and ids that the model's start is learned from, about.
PART, CHUNK, TRAINED = 64, 8 << 20, 1_200_000
#: Ids of a shard of windows, about, and rows of the model that are merged at once.
SHARD, MERGED = 8 << 20, 256
#: Words whose ids a worker keeps, at most; most words of a chunk were in one before.
KNOWN = 1 << 19
#: White space of other kinds, at which the encoder's splits needn't be those of words.
ODD = re.compile("[\x85\xa0  -     　]")
FIELDS = (("ids", pa.binary()), ("held", pa.binary()), ("first", pa.binary()), ("number", pa.binary()), ("names", pa.binary()), ("counts", pa.binary()), ("pieces", pa.binary()), ("sizes", pa.binary()))
ROW = "cid long, ids binary, held binary, first binary, number binary, names binary, counts binary, pieces binary, sizes binary"


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def squeeze(x: np.ndarray) -> bytes:
    return x.nbytes.to_bytes(8, "little") + (pa.compress(x.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def spread(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b"", kind)


class Encoder:
    """Words to subword ids, each word by itself behind a blank."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(IDS, np.int64)
        self.size[list(ranks.values())] = [len(b) for b in ranks]
        self.names, self.begin, self.length, self.flat = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint16)

    def ids(self, text: str) -> np.ndarray:
        return self.plain.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)

    def one(self, word: str) -> np.ndarray:
        """A long word is encoded part by part."""
        return np.concatenate([self.ids((" " if k == 0 else "") + word[k : k + PART]) for k in range(0, len(word), PART)])

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        alone = np.fromiter(map(len, words), np.int64, len(words)) > PART
        if ODD.search("".join(words)):
            alone |= np.array([ODD.search(w) is not None for w in words], bool)
        usual = [w for w, a in zip(words, alone.tolist(), strict=True) if not a] if alone.any() else words
        joined = " ".join(["", *usual])
        flat = self.ids(joined)
        ends = np.cumsum(np.fromiter(map(len, usual if joined.isascii() else map(str.encode, usual)), np.int64, len(usual)) + 1)
        at = np.cumsum(self.size[flat])
        last = np.searchsorted(at, ends)
        if not np.array_equal(at[last], ends):  # an id over two words
            raise AssertionError("splits are not those of words")
        counts = np.zeros(len(words), np.int64)
        counts[~alone] = np.diff(np.concatenate([[0], last + 1]))
        if not alone.any():
            return flat, counts
        others = [self.one(w) for w, a in zip(words, alone, strict=True) if a]
        counts[alone] = [len(o) for o in others]
        out = np.zeros(counts.sum(), np.uint16)
        theirs = np.repeat(alone, counts)
        out[~theirs], out[theirs] = flat, np.concatenate(others)
        return out, counts


    def named(self, names: np.ndarray, text) -> tuple[np.ndarray, np.ndarray]:
        """Like words(), of distinct words by their names (n x 2, in order); text: the words at some of these places."""
        at = np.searchsorted(self.names[:, 0], names[:, 0])
        hit = np.zeros(len(names), bool)
        inside = np.flatnonzero(at < len(self.names))
        hit[inside] = (self.names[at[inside]] == names[inside]).all(1)
        new = np.flatnonzero(~hit)
        fresh, size = self.words(text(new))
        sizes = np.empty(len(names), np.int64)
        sizes[new], sizes[hit] = size, self.length[at[hit]]
        old = sizes[hit]
        out, theirs = np.empty(sizes.sum(), np.uint16), np.repeat(hit, sizes)
        out[~theirs], out[theirs] = fresh, self.flat[np.arange(old.sum()) + np.repeat(self.begin[at[hit]] - (np.cumsum(old) - old), old)]
        keep = new[: max(0, KNOWN - len(self.names))]
        size = size[: len(keep)]
        self.names, self.length = np.insert(self.names, at[keep], names[keep], 0), np.insert(self.length, at[keep], size)
        self.begin = np.insert(self.begin, at[keep], len(self.flat) + np.cumsum(size) - size)
        self.flat = np.concatenate([self.flat, fresh[: size.sum()]])
        return out, sizes


def encoder(path: str) -> Encoder:
    memo = ta.process_memo()
    if ("lm", path) not in memo:
        memo["lm", path] = Encoder(path)
    return memo["lm", path]


def by_name(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names in order, and which of them are not the one before."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    new, other = np.ones(len(order), bool), y[1:] != y[:-1]
    new[1:] = x[1:] != x[:-1]
    if (other & ~new[1:]).any():  # equal first halves
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, new


def held_out(doc_id: int | None) -> bool:
    """Kept from learning; a row without an id is."""
    return doc_id is None or zlib.crc32(b"%d" % doc_id) % 7 == 2


def chunk_rows(path: str):
    """Chunks of (doc_id, text)."""

    def run(batches):
        from pyspark import TaskContext

        cid = TaskContext.get().partitionId() << 32
        out = blobs.Rows(pa.schema([("cid", pa.int64()), *FIELDS]))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for c in ta.chunks(batch.column(1), CHUNK):
                mine = ids[c.first : c.first + c.n]
                held = np.array([held_out(i) for i in mine], bool)
                starts, ends, first = c.words()
                a, b = c.word_names(lower=True)
                order, new = by_name(a, b)
                one = order[new]
                number = np.empty(len(order), np.uint32)
                number[order] = np.cumsum(new) - 1
                counts = np.bincount(number[~held[ta.rows_of(first)]], minlength=len(one)).astype(np.int64)
                raw = memoryview(ta.lowered(c.data))
                names = np.stack([a[one], b[one]], axis=1)
                pieces, sizes = encoder(path).named(names, lambda k: [str(raw[s:e], "utf-8", "replace") for s, e in zip(starts[one[k]].tolist(), ends[one[k]].tolist(), strict=True)])  # noqa: B023
                known = np.array([0 if i is None else i for i in mine], np.int64)
                flags = held.astype(np.uint8) | (np.array([i is None for i in mine], np.uint8) << 1)
                out.add(cid, known.tobytes(), flags.tobytes(), first.astype(np.int64).tobytes(), squeeze(number), names.tobytes(), squeeze(counts), squeeze(pieces), squeeze(sizes.astype(np.uint32)))
                cid += 1
                yield from out.ready()
        yield out.flush()

    return run


class Chunk:
    """A row of the table of chunks."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        flags = get("held", np.uint8)
        self.ids, self.held, self.nameless, self.first = get("ids", np.int64), (flags & 1).astype(bool), (flags & 2).astype(bool), get("first", np.int64)
        self.number = spread(row["number"], np.uint32).astype(np.int64)
        self.pieces, self.sizes = spread(row["pieces"], np.uint16), spread(row["sizes"], np.uint32).astype(np.int64)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each behind BEGIN, and where texts begin (n + 1 values)."""
        size = self.sizes[self.number]
        begin = np.cumsum(self.sizes) - self.sizes
        total = np.concatenate([[0], np.cumsum(size)])
        first = total[self.first] + np.arange(len(self.first))
        at = np.arange(total[-1]) + np.repeat(begin[self.number] - total[:-1], size)
        out = np.full(first[-1] if len(first) else 0, BEGIN, np.uint16)
        inside = np.ones(len(out), bool)
        inside[first[:-1]] = False
        out[inside] = self.pieces[at]
        return out, first


def send(n_buckets: int):
    def run(batches):
        out = blobs.Rows(blobs.KEYS)
        for row in chunktable.each(batches):
            names = np.frombuffer(row["names"], np.uint64).reshape(-1, 2)
            counts = spread(row["counts"], np.int64)
            for k, cut in blobs.Split(names[:, 0], n_buckets):
                out.add(row["cid"], k, names[cut].tobytes(), counts[cut].tobytes())
            yield from out.ready()
        yield out.flush()

    return run


TOTALS = "cid long, bucket int, bits binary, types long, tokens long"


def totals(table: pa.Table) -> pa.Table:
    """For each chunk the counts of its words in the whole training part; in one row without a chunk how many words that has."""
    names = [np.frombuffer(k.as_py(), np.uint64).reshape(-1, 2) for k in table.column("keys")]
    counts = np.concatenate([np.frombuffer(e.as_py(), np.int64) for e in table.column("extra")])
    size = [len(x) for x in names]
    a, b = np.concatenate(names).T
    order, new = by_name(a, b)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    total = np.bincount(group, counts).astype(np.int64)
    replies = np.split(total[group], np.cumsum(size)[:-1])
    n, bucket = len(size), table.column("bucket")[0].as_py()
    return pa.table({
        "cid": pa.array([*table.column("cid").to_pylist(), None], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int32()), "bits": pa.array([*map(squeeze, replies), None], pa.binary()),
        "types": pa.array([0] * n + [int((total > 0).sum())], pa.int64()), "tokens": pa.array([0] * n + [int(total.sum())], pa.int64()),
    })


def id_counts(batches):
    """How often each id stands in the training part of each chunk, and texts there end."""
    for row in chunktable.each(batches):
        counts, sizes = spread(row["counts"], np.int64), spread(row["sizes"], np.uint32)
        n = np.bincount(spread(row["pieces"], np.uint16), np.repeat(counts, sizes), IDS + 1)
        n[END] = (np.frombuffer(row["held"], np.uint8) == 0).sum()
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], ["id", "n"])


class Windows:
    """The windows of a chunk's training texts; marks: a hash of each one's text's id and its number there."""

    def __init__(self, c: Chunk):
        self.x, self.first = c.tokens()
        size = np.diff(self.first)
        count = np.where(c.held, 0, -(-size // WINDOW))
        self.text = np.repeat(np.arange(len(size)), count)
        self.number = np.arange(len(self.text)) - np.repeat(np.cumsum(count) - count, count)
        self.marks = ta.mix(c.ids[self.text].view(np.uint64) * ta.ODD[0] + ta.mix(self.number.astype(np.uint64) + ta.ODD[1]))

    def some(self, pick: np.ndarray) -> np.ndarray:
        """Ids (n x WINDOW + 1); behind a text's end are more ends."""
        if not len(pick):
            return np.zeros((0, WINDOW + 1), np.uint16)
        at = self.first[:-1][self.text[pick]] + self.number[pick] * WINDOW
        to = at[:, None] + np.arange(WINDOW + 1)
        return np.where(to < self.first[1:][self.text[pick]][:, None], self.x[np.minimum(to, len(self.x) - 1)], END).astype(np.uint16)


def drawn(share: float):
    """Windows of training texts, each with the chance `share` by its mark."""

    def run(batches):
        for row in chunktable.each(batches):
            w = Windows(Chunk(row))
            some = w.some(np.flatnonzero(w.marks.astype(np.float64) < share * 2.0**64))
            yield pa.record_batch([pa.array([some.tobytes()], pa.binary())], ["windows"])

    return run


DEALT = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("windows", pa.binary())])


def deal(n_shards: int):
    """All windows of training texts for their shards.

    A key is made of a window's mark and its ids: in the order of keys windows of equal keys
    are equal, so a shard's order is that of the data, whichever chunks they came in.
    """

    def run(batches):
        out = blobs.Rows(DEALT)
        power = ta.mix(np.arange(WINDOW + 1, dtype=np.uint64)) | U(1)
        for row in chunktable.each(batches):
            w = Windows(Chunk(row))
            some = w.some(np.arange(len(w.text)))
            key = ta.mix(w.marks + ta.mix(some.astype(np.uint64) @ power))
            order = np.argsort(key)
            shard = ((key[order] >> U(32)) * U(n_shards) >> U(32)).astype(np.int64)
            ends = np.searchsorted(shard, np.arange(n_shards + 1))
            for k in np.flatnonzero(np.diff(ends)).tolist():
                cut = order[ends[k] : ends[k + 1]]
                out.add(k, key[cut].tobytes(), squeeze(some[cut]))
            yield from out.ready()
        yield out.flush()

    return run


LEARNED = "block int, shard int, weight binary, weights binary, given binary"


def learn(start: Model):
    """What a pass over one shard makes of the weights: in block -1 those of all ids, in others E and the distributions of some rows."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k.as_py(), np.uint64) for k in table.column("keys")])
        windows = np.concatenate([spread(w.as_py(), np.uint16) for w in table.column("windows")]).reshape(-1, WINDOW + 1)
        p, read, given, _ = start.passed(windows[np.argsort(keys)])
        shard, rest = table.column("shard")[0].as_py(), np.concatenate([p[name].ravel() for name in start.others()])
        rows = [(-1, shard, np.array([len(windows)], np.int64).tobytes(), rest.tobytes(), b"")]
        for low in range(0, len(read), MERGED):
            of = slice(low, low + MERGED)
            if read[of].any() or given[of].any():
                rows.append((low // MERGED, shard, read[of].tobytes(), p["E"][of].tobytes(), given[of].astype(np.float32).tobytes()))
        return pa.table({f.split()[0]: [r[k] for r in rows] for k, f in enumerate(LEARNED.split(", "))}, pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("weight", pa.binary()), ("weights", pa.binary()), ("given", pa.binary())]))

    return run


def merge(table: pa.Table) -> pa.Table:
    """One block of all shards: weights by how many windows, or reads of a row, they come from; what is given is summed."""
    rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
    weight, total, given = 0, 0, 0
    for r in rows:
        n = np.frombuffer(r["weight"], np.int64)
        weight = weight + n
        total = total + np.frombuffer(r["weights"], np.float32).reshape(len(n), -1) * n[:, None].astype(np.float64)
        given = given + np.frombuffer(r["given"], np.float32).astype(np.float64)
    mean = (total / np.maximum(weight, 1)[:, None]).astype(np.float32)
    return pa.table({"block": pa.array([rows[0]["block"]], pa.int32()), "shard": pa.array([None], pa.int32()), "weight": [weight.tobytes()], "weights": [mean.tobytes()], "given": [given.tobytes()]})


def learned(table: DataFrame, start: Model, ids: float) -> Model:
    """The model after a pass over all training windows of the table of chunks."""
    n_shards = max(1, -(-int(ids) // SHARD))
    dealt = table.select("ids", "held", "first", "number", "pieces", "sizes").mapInArrow(deal(n_shards), "shard int, keys binary, windows binary")
    merged = dealt.groupBy("shard").applyInArrow(learn(start), LEARNED).groupBy("block").applyInArrow(merge, LEARNED)
    rows = {r["block"]: r for r in merged.collect()}  # a row of numbers per id of the vocabulary at most
    if not rows:
        return start
    got = {k: np.frombuffer(r["weight"], np.int64) for k, r in rows.items()}
    read, e, given = np.zeros(len(start.T), np.int64), start.p["E"].copy(), np.zeros(start.T.shape)
    for k, r in rows.items():
        if k >= 0:
            of = slice(k * MERGED, k * MERGED + len(got[k]))
            read[of] = got[k]
            some = np.frombuffer(r["weights"], np.float32).reshape(len(got[k]), -1)
            e[of] = np.where(got[k][:, None] > 0, some, e[of])
            given[of] = np.frombuffer(r["given"]).reshape(len(got[k]), -1)
    return start.after(e, np.frombuffer(rows[-1]["weights"], np.float32), given)


def scored(model: Model, tokens: int, types: int, ends: int):
    """doc_id, held_out, n_tokens, n_known, base_score and score of the texts of each chunk.

    Names are sorted and buckets are ranges of them, so totals by bucket are in the order of a chunk's words.
    """
    tables = model.tables()
    unit = tokens + types + 1

    def run(batches):
        for row in chunktable.each(batches):
            c = Chunk(row)
            parts = [spread(r["bits"], np.int64) for r in sorted(row["totals"] or (), key=lambda r: r["bucket"])]
            count = np.concatenate([*parts, np.zeros(0, np.int64)])
            per = lambda v: (lambda t: t[c.first[1:]] - t[c.first[:-1]])(np.concatenate([[0], np.cumsum(v[c.number])]))
            n = np.diff(c.first) + 1
            base = per(np.log10((count + 1) / unit)) + np.log10((ends + 1) / unit)
            known = per((count > 0).astype(np.int64)) + (ends > 0)
            x, first = c.tokens()
            y = np.append(x[1:], np.uint16(END))
            y[first[1:] - 1] = END
            score = tables.score(tables.rows[x], tables.rows[y], first)
            yield pa.record_batch([
                pa.array(c.ids, pa.int64(), mask=c.nameless), pa.array(c.held), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens, np.int64)), pa.array(base), pa.array(score),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, trained: int = TRAINED) -> DataFrame:
    """Scores of all rows by what rows of other folds teach.

    Rows whose crc32 of the id is 2 modulo 7 are held out, and so are rows without an id.
    base_score adds log10((c + 1) / (N + V + 1)) over words and end, with counts of the whole
    training part.  score is the log10 probability of the text's subword ids and its end
    under the model, which learns from all windows of training texts; its start comes from
    about `trained` ids, in windows drawn by hash.  Null and empty text: the end alone.  Repeated rows count again
    in learning and are scored alike.  A very long text, or one long word, is a chunk of its
    own: one task holds its ids, and scores it whole.  Without training rows all words are
    unknown and all ids equally likely.  Other columns are not read.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    table = store.materialize(rows.mapInArrow(chunk_rows(ranks or ranks_path()), ROW), "words")
    n_buckets = blobs.number_for(store.total_bytes(table), 16 << 20)
    sent = table.select("cid", "names", "counts").mapInArrow(send(n_buckets), blobs.ROW)
    replies = store.materialize(sent.groupBy("bucket").applyInArrow(totals, TOTALS), "totals")
    types, tokens = replies.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    per_id = table.select("pieces", "sizes", "counts", "held").mapInArrow(id_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    seen = np.zeros(IDS + 2)
    for r in per_id.collect():  # a row per id of the vocabulary at most
        seen[r["id"]] = r["n"]
    ends = int(seen[END])
    seen[BEGIN] = ends
    share = min(1.0, trained / max(1.0, seen.sum()))
    windows = table.select("ids", "held", "first", "number", "pieces", "sizes").mapInArrow(drawn(share), "windows binary").collect()
    some = np.frombuffer(b"".join(r["windows"] for r in windows), np.uint16).reshape(-1, WINDOW + 1)
    some = some[np.lexsort(some.T)]  # the same windows in the same order, whichever tasks found them
    model = learned(table, Model(seen).train(some), seen.sum())
    del sent
    store.release(docs.sparkSession)  # shuffled windows go before chunks are shuffled
    per = replies.where("cid IS NOT NULL").groupBy("cid").agg(F.collect_list(F.struct("bucket", "bits")).alias("totals"))
    joined = table.drop("counts", "names").join(per.hint("merge"), "cid", "left")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.mapInArrow(scored(model, tokens + ends, types + (ends > 0), ends), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(store.table(spark, sf_dir, "documents"))
