"""Quality rules: base counts of each text, and cross-document line frequency by host.

One pass over the texts gives every document its counts and the hashes of its normalised
lines (A-Z lower-cased, white space runs as one space); only these travel afterwards.  A
line is boilerplate of its host when more distinct documents of that host hold it than
the limits allow.  Boilerplate lines are removed, and documents that keep too small a share
of their words are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textarrays as ta

U = np.uint64
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "uid long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<a: long, b: long, words: int>>"


def flag_table(values: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(values)] = 1
    return t


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(h: tuple[np.ndarray, np.ndarray], first: np.ndarray, k: int) -> np.ndarray:
    """Words in k-word windows that their text holds twice or more."""
    ok = np.flatnonzero(ta.window_ok(first, k, len(h[0])))
    row = ta.rows_of(first)
    keys = (row[ok], *(ta.windows(x, k, lane)[ok] for lane, x in enumerate(h)))
    order = np.lexsort(keys)
    twin = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in keys])
    again = np.zeros(len(ok), bool)
    again[order[1:][twin]] = True
    again[order[:-1][twin]] = True
    edge = np.zeros(len(h[0]) + 1, np.int64)
    edge[ok[again]] += 1
    edge[ok[again] + k] -= 1
    return per_text(np.cumsum(edge[:-1]) > 0, first)


def first_of_each(*keys: np.ndarray) -> np.ndarray:
    """Where each distinct tuple of keys stands first."""
    order = np.lexsort((np.arange(len(keys[0])), *keys))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in keys])
    return order[new]


class Lines:
    """Lines with a word: their rows, raw hashes, and hashes of their lower-cased words."""

    def __init__(self, c: ta.Chunk):
        starts, _, first = c.words()
        stop = np.unique(np.concatenate([np.flatnonzero(c.data == 10), c.offsets[1:] - 1]))
        stop = stop[stop >= 0]
        begin = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64) if len(stop) else stop
        end = np.where(c.data[stop] == 10, stop, stop + 1) if len(stop) else stop
        word = np.searchsorted(starts, np.append(begin, len(c.data)))
        some = np.flatnonzero(np.diff(word) > 0)
        self.begin, self.end, self.lo, self.hi = begin[some], end[some], word[:-1][some], word[1:][some]
        self.row = ta.rows_of(first)[self.lo]
        self.bounds = np.searchsorted(self.row, np.arange(c.n + 1))
        self.words = self.hi - self.lo

    def normal(self, c: ta.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the lines' lower-cased words, joined by one space."""
        word = np.repeat(np.arange(len(self.lo)), self.words)
        keep = np.ones(len(word), bool)  # every word stands in one line
        data, off = ta.join_words(c, keep, word, len(self.lo), ta.lowered(c.data))
        return ta.span_names(data, off[:-1], off[1:] - 1)


def profile(batches):
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 33
    line = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("words", pa.int32())])
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string()), *((n, pa.int64()) for n in BASE), ("lines", pa.list_(line))])
    symbol = flag_table(SYMBOLS)
    lead = np.array([(b & 0xC0) != 0x80 for b in range(256)])
    for batch in batches:
        for c in ta.chunks(batch.column(2)):
            first = c.words()[2]
            h = c.word_names()
            n_words = np.diff(first)
            chars = np.concatenate([[0], np.cumsum(lead[c.data] & ~ta.is_space()[c.data])])
            lines = Lines(c)
            dup = np.ones(len(lines.row), bool)
            dup[first_of_each(lines.row.astype(np.uint64), *c.span_names(lines.begin, lines.end))] = False
            a, b = (x.view(np.int64) for x in lines.normal(c))
            items = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(lines.words.astype(np.int32))], fields=list(line))
            yield pa.record_batch(
                [
                    pa.array(uid + np.arange(c.n)), batch.column(0).slice(c.first, c.n), batch.column(1).slice(c.first, c.n), 
                    pa.array(n_words), pa.array(chars[c.offsets[1:]] - chars[c.offsets[:-1]]), pa.array(per_text(symbol[c.data], c.offsets)), pa.array(per_text(dup, lines.bounds)),
                    pa.array(repeated_words(h, first, 5)), pa.ListArray.from_arrays(pa.array(lines.bounds.astype(np.int32)), items),
                ],
                schema=schema,
            )
            uid += c.n


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, max_share: float = 0.02, min_kept: float = 0.25) -> DataFrame:
    """Base counts and verdict of every row.

    A line is removed when more than min_docs documents of its host and more than
    max_share of them hold it; a document is rejected when less than min_kept of its
    words is left.  Null text: no words, fails the base rules.  A null host is a host of
    its own.  Rows without an id and repeated rows are judged like others.  A very long text
    is one task's chunk, and its lines are one row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and n_line_words, the words of removed lines.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(host_col).cast("string"), F.col(text_col).cast("string"))
    seen = store.materialize(rows.mapInArrow(profile, SCHEMA), "quality")
    doc = ("doc_id", F.when(F.col("doc_id").isNull(), F.col("uid")).alias("row"))  # a row without an id is a document of its own
    hosts = seen.select("host", *doc).distinct().groupBy("host").agg(F.count("*").alias("n_docs")).select(F.col("host").alias("h"), "n_docs")
    lines = seen.select("uid", "host", "doc_id", F.explode("lines").alias("l")).select("uid", "host", "doc_id", "l.a", "l.b", "l.words")
    counts = lines.select("host", "a", "b", *doc).distinct().groupBy("host", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    common = counts.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > max_share * F.col("n_docs")).select("h", F.col("a").alias("x"), F.col("b").alias("y"))
    hit = lines.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")))
    removed = hit.groupBy("uid").agg(F.sum("words").alias("gone"))
    out = seen.drop("lines").join(removed, "uid", "left").withColumn("n_line_words", F.coalesce("gone", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_line_words") < min_kept * F.col("n_words")
    return out.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_line_words")


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(store.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT doc_id, source, text, line, list_aggregate(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), 'string_agg', ' ') AS norm,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM l WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM n GROUP BY doc_id),
h AS (SELECT source, count(DISTINCT doc_id) AS n_docs FROM d GROUP BY source),
f AS (SELECT source, norm, count(DISTINCT doc_id) AS n FROM n GROUP BY source, norm),
b AS (SELECT f.source, norm FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE n > 20 AND n > 0.02 * n_docs),
r AS (SELECT doc_id, sum(nw) AS gone FROM n JOIN b ON n.source IS NOT DISTINCT FROM b.source AND n.norm = b.norm GROUP BY doc_id),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
k AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM s),
m AS (SELECT doc_id, g FROM k GROUP BY doc_id, g HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT k.doc_id, unnest(range(i, i + 5)) AS j FROM k JOIN m ON k.doc_id = m.doc_id AND k.g = m.g) GROUP BY doc_id),
o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_line_words
      FROM d LEFT JOIN u USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND NOT (n_words - n_line_words < 0.25 * n_words) AS kept FROM v
"""
