"""Crash triage: signatures, groups, ranks and representatives.

Input has one row per crash: file, path, size and the debugger's text in stdout.  Groups
are one row per frame; their members stay rows and are never gathered into one value.
Places, of members in a frame and of groups among all groups, are numbered by range
partitions, so a frame that most crashes share, or very many frames, are no single task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.signature import frames, signature, stable_signature
from faultlens.operators.ranking import placed


def with_frame(crashes: DataFrame, stable: bool = False) -> DataFrame:
    return crashes.withColumn("frame", (stable_signature if stable else signature)(F.col("stdout")))


def groups(crashes: DataFrame, stable: bool = False) -> DataFrame:
    """frame, cnt, file and size of its smallest member (then by name)."""
    least = F.min_by(F.struct("file", "size"), F.struct("size", "file"))
    out = with_frame(crashes, stable).groupBy("frame").agg(F.count("*").alias("cnt"), least.alias("least"))
    return out.select("frame", "cnt", F.col("least.file").alias("file"), F.col("least.size").alias("size"))


def ranked(grouped: DataFrame) -> DataFrame:
    """Adds rnk: by cnt from the largest, then by frame."""
    return placed(grouped, [], [F.desc("cnt"), F.col("frame")], "rnk")


def summary(crashes: DataFrame) -> DataFrame:
    """One row: total_crashes and unique_crash_frames."""
    per = with_frame(crashes).groupBy("frame").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_crashes"), F.count("*").alias("unique_crash_frames"))


def top(crashes: DataFrame, n: int = 5) -> DataFrame:
    """The n largest groups, found without ranking the others."""
    first = groups(crashes).orderBy(F.desc("cnt"), "frame").limit(n)
    return first.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("cnt"), "frame")).cast("long"))


def members(crashes: DataFrame) -> DataFrame:
    """Every crash with its frame and its place in the group by size, then name."""
    return placed(with_frame(crashes).select("frame", "file", "size"), ["frame"], [F.col("size"), F.col("file")])


def status(crashes: DataFrame) -> DataFrame:
    """Rank and analysis status: the first group is primary, the others secondary."""
    text = F.when(F.col("rnk") == 1, "Primary crash analyzed").otherwise("Secondary crash (not fully analyzed)")
    return ranked(groups(crashes)).select("rnk", "frame", "cnt", "file", "size", text.alias("status"))


def backtraces(crashes: DataFrame, depth: int = 10) -> DataFrame:
    """One row per frame of every backtrace: file, depth, frame."""
    exploded = crashes.select("file", F.posexplode(frames(F.col("stdout"), depth)))
    return exploded.select("file", F.col("pos").cast("long").alias("depth"), F.rtrim("col").alias("frame"))


def document_rows(crashes: DataFrame, target: str = "target_id") -> DataFrame:
    """The triage document of every target as rows of documents.write_documents, to be sorted by rnk, part, size and file.

    total_crashes, unique_crash_frames, and per frame from the most frequent one its count and its
    crashes by size.  crashes: target, file, path, size, stdout.
    """
    c = F.col
    found = with_frame(crashes).select(c(target).cast("string").alias("target"), "frame", "file", "path", "size")
    per = placed(found.groupBy("target", "frame").agg(F.count("*").alias("cnt")), ["target"], [F.desc("cnt"), c("frame")], "rnk")
    totals = per.groupBy("target").agg(F.sum("cnt").alias("total"), F.count("*").alias("frames"))

    def rows(df: DataFrame, rnk, part: int, keys: list, value, size=None, file=None) -> DataFrame:
        empty = F.lit(None)
        return df.select("target", F.array(*keys).alias("keys"), value.cast("string").alias("value"), rnk.cast("long").alias("rnk"), F.lit(part).alias("part"), (empty if size is None else size).cast("long").alias("size"), (empty if file is None else file).cast("string").alias("file"))

    first, text = F.lit(0), F.lit
    member = F.to_json(F.struct("file", "path", "size"), {"ignoreNullFields": "false"})
    ranked_members = found.join(per.select(c("target").alias("t"), c("frame").alias("f"), "rnk"), c("target").eqNullSafe(c("t")) & (c("frame") == c("f")))
    return (
        rows(totals, first, 0, [text("total_crashes")], c("total"))
        .unionByName(rows(totals, first, 1, [text("unique_crash_frames")], c("frames")))
        .unionByName(rows(per, c("rnk"), 0, [text("groups"), c("frame"), text("count")], c("cnt")))
        .unionByName(rows(ranked_members, c("rnk"), 1, [text("groups"), c("frame"), text("crashes"), text("[]")], member, c("size"), c("file")))
    )
