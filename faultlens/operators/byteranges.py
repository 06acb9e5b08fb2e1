"""Byte profiles of files of any size, from ranges of their bytes.

A task reads one range of a file and a few bytes around it, so it sees every match that
begins in the range and every character.  Partial profiles are sums, ors and ands, which
merge in any order.  The most frequent chunks of a file in several ranges are found without
sending all chunks: each range sends its most frequent ones and the largest count that it
keeps back; what may be among the best is then counted exactly, and a file where the
counts kept back could hide one is counted in full.
"""

from __future__ import annotations

from codecs import getincrementaldecoder

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.operators.byteprofile import counted
from faultlens.sources import corpus, shared

#: Patterns that a profile looks for.
NEEDLES = {"repeated_a": b"A" * 8, "format": b"%n" * 3, "sled": b"\x90" * 4}
STEP = 1 << 20
#: Chunks that a range sends, and candidates of a file that are counted exactly.
KEPT, CANDIDATES = 1024, 65_536


def expected(data: bytes, at: int) -> int:
    """How many bytes from place at on belong to a character that began up to three bytes before."""
    for k in range(1, min(3, at) + 1):
        b = data[at - k]
        if b < 0x80:
            return 0
        if b >= 0xC0:
            return max(0, (1 if b < 0xE0 else 2 if b < 0xF0 else 3) - (k - 1))
    return 0


def characters(data: bytes, begin: int, end: int) -> bool:
    """Whether every character that begins in data[begin:end] is valid UTF-8; it may end behind."""
    decoder = getincrementaldecoder("utf-8")("strict")
    try:
        for k in range(begin, end, STEP):
            decoder.decode(data[k : min(end, k + STEP)])
        if rest := decoder.getstate()[0]:
            size = 2 if rest[0] < 0xE0 else 3 if rest[0] < 0xF0 else 4
            (rest + data[end : end + size - len(rest)]).decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def half_match(data: bytes, needle: bytes, begin: int, end: int) -> bool:
    """Whether needle's hex text begins in that of data[begin:end], inside a byte or not."""
    text = needle.hex()
    for k in range(begin, end, STEP):
        last = min(end, k + STEP)
        if data[k : last + len(needle)].hex().find(text, 0, 2 * (last - k) + len(text) - 1) >= 0:
            return True
    return False


def partial(needles: dict[str, bytes], width: int, shown: int):
    longest = max(map(len, needles.values()), default=0)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                before = min(3, r["at"])
                data = corpus.range_of(r["path"], r["at"] - before, r["at"] + width + longest + 3)
                end = min(len(data), before + width)
                own = np.frombuffer(data, np.uint8)[before:end]
                row = {
                    "path": r["path"], "size": r["size"], "nonprintable": int(((own < 32) | (own > 126)).sum()), "newlines": int((own == 10).sum()),
                    "textual": not (own == 0).any() and characters(data, min(end, before + expected(data, before)), end), "dump": data[:shown].hex() if r["at"] == 0 else None,
                }
                for name, needle in needles.items():
                    row[f"has_{name}"] = data.find(needle, before, end + len(needle) - 1) >= 0
                    row[f"hex_{name}"] = half_match(data, needle, before, end)
                out.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return run


def profile(files: DataFrame, needles: dict[str, bytes] | None = None, width: int = corpus.SHARE, shown: int = 160) -> DataFrame:
    """One row per file: path, size, nonprintable, pct, newlines, textual, dump, and has_ and hex_ flags per needle.

    files: path and size, as corpus.listing gives them.  has_ is a true byte match, hex_ a
    match in hex text, which can begin inside a byte.  dump: the first `shown` (up to the
    width) bytes.  An empty file is textual and has no percent.  Results don't depend on width.
    """
    needles = NEEDLES if needles is None else needles
    flags = [f"{kind}_{name}" for name in needles for kind in ("has", "hex")]
    schema = "path string, size long, nonprintable long, newlines long, textual boolean, dump string" + "".join(f", {f} boolean" for f in flags)
    parts = corpus.ranges(files, width).mapInArrow(partial(needles, width, shown), schema)
    merged = parts.groupBy("path").agg(F.max("size").alias("size"), F.sum("nonprintable").alias("nonprintable"), F.sum("newlines").alias("newlines"), F.bool_and("textual").alias("textual"), F.max("dump").alias("dump"), *(F.bool_or(f).alias(f) for f in flags))
    pct = F.floor(F.col("nonprintable") * 1000 / F.nullif("size", F.lit(0))).cast("double") / 10.0
    return merged.select("path", "size", "nonprintable", pct.alias("pct"), "newlines", "textual", "dump", *flags)


SUMMARY = "path string, at long, whole boolean, rest long, chunk binary, n long"


def summaries(width: int, k: int, share: int, kept: int):
    """The most frequent chunks of each range; all that count for a file in one range."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                values, n = counted(corpus.range_of(r["path"], r["at"], r["at"] + share), width)
                whole = r["size"] <= share
                most = min(len(n), k if whole else kept)
                rest = int(n[most]) if most < len(n) else 0
                if whole:
                    most = int((n[:most] > 1).sum())
                yield pa.record_batch([
                    pa.array([r["path"]] * most, pa.string()), pa.array([r["at"]] * most, pa.int64()), pa.array([whole] * most, pa.bool_()), pa.array([rest] * most, pa.int64()),
                    pa.array([v.tobytes() for v in values[:most]], pa.binary()), pa.array(n[:most], pa.int64()),
                ], ["path", "at", "whole", "rest", "chunk", "n"])

    return run


def exact_counts(width: int, share: int, wanted: bool):
    """Counts of the wanted chunks, or of all, of each range."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                values, n = counted(corpus.range_of(r["path"], r["at"], r["at"] + share), width)
                raw = [v.tobytes() for v in values]
                pick = range(len(raw))
                if wanted:
                    those = set(r["wanted"])
                    pick = [i for i in pick if raw[i] in those]
                yield pa.record_batch([pa.array([r["path"]] * len(pick), pa.string()), pa.array([raw[i] for i in pick], pa.binary()), pa.array([int(n[i]) for i in pick], pa.int64())], ["path", "chunk", "n"])

    return run


def top_chunks(files: DataFrame, k: int = 3, width: int = 4, share: int = corpus.SHARE, kept: int = KEPT, most: int = CANDIDATES) -> DataFrame:
    """path, rnk, chunk and n: the k most frequent chunks of a file that occur more than once; ties: the larger chunk first.

    files: path and size.  share is a multiple of width.  A chunk that no range sent has at
    most the sum of the counts kept back; if that is under the k-th count that is sure, all
    that matter were sent.  Those whose count isn't known in full are counted again in their
    file's ranges; a file where the bound doesn't decide, or with over `most` such chunks,
    is counted in full.  Results don't depend on share, kept and most.
    """
    if share % width:
        raise ValueError("a range should hold whole chunks")
    cut = corpus.ranges(files, share)
    found = shared.written(cut.mapInArrow(summaries(width, k, share, kept), SUMMARY), "chunks")
    parts = found.where("NOT whole")
    back = parts.groupBy("path", "at").agg(F.max("rest").alias("rest")).groupBy("path").agg(F.sum("rest").alias("back"))
    sure = parts.groupBy("path", "chunk").agg(F.sum("n").alias("n"), F.sum("rest").alias("told"))
    best = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), F.desc("chunk")))
    kth = sure.select("path", "chunk", "n", best.alias("r")).where(F.col("r") <= k).groupBy("path").agg(F.count("*").alias("have"), F.min("n").alias("least"))
    bounds = back.join(kth, "path").select("path", "back", F.when(F.col("have") < k, 0).otherwise(F.col("least")).alias("least"))
    may = sure.join(bounds, "path").withColumn("more", F.col("back") - F.col("told")).where(F.col("n") + F.col("more") >= F.col("least"))
    may = shared.written(may, "candidates")
    per = may.groupBy("path").agg(F.count("*").alias("chunks"), F.max("more").alias("more"), F.max("back").alias("back"), F.max("least").alias("least"))
    unsure = (F.col("back") > 0) & (F.col("back") >= F.col("least"))
    per = shared.written(per.select("path", F.when(unsure, "full").when(F.col("more") == 0, "known").when(F.col("chunks") > most, "full").otherwise("again").alias("how")), "how")
    how = lambda name: per.where(F.col("how") == name).select("path")
    known = may.join(how("known"), "path", "left_semi").select("path", "chunk", "n")
    wanted = may.join(how("again"), "path", "left_semi").groupBy("path").agg(F.collect_list("chunk").alias("wanted"))
    counts = "path string, chunk binary, n long"
    again = cut.join(wanted, "path").mapInArrow(exact_counts(width, share, True), counts)
    full = cut.join(how("full"), "path", "left_semi").mapInArrow(exact_counts(width, share, False), counts)
    several = known.unionByName(again.unionByName(full).groupBy("path", "chunk").agg(F.sum("n").alias("n")))
    several = several.unionByName(found.where("whole").select("path", "chunk", "n"))
    out = several.withColumn("rnk", best.cast("long")).where((F.col("rnk") <= k) & (F.col("n") > 1))
    return out.select("path", "rnk", F.lower(F.hex("chunk")).alias("chunk"), "n")
