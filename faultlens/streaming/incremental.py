"""Triage of crashes as they arrive: counts per frame that grow with each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultlens.functions.signature import signature


def crash_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """Debugger output as a file stream."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def running_counts(crashes: DataFrame) -> DataFrame:
    """frame and cnt over all that has arrived; the state is one row per frame."""
    return crashes.groupBy(signature(F.col("stdout")).alias("frame")).agg(F.count("*").alias("cnt"))


def running_groups(crashes: DataFrame) -> DataFrame:
    """frame, cnt, file and size of the smallest member (then by name) over all that has arrived.

    The state of a frame is its count and that member, in Spark's own state store; crashes
    of a batch are combined in their tasks before they meet it, so a hot frame costs a row a
    task.
    """
    least = F.min(F.struct("size", "file")).alias("least")
    out = crashes.groupBy(signature(F.col("stdout")).alias("frame")).agg(F.count("*").alias("cnt"), least)
    return out.select("frame", "cnt", F.col("least.file").alias("file"), F.col("least.size").alias("size"))


def windowed_counts(crashes: DataFrame, time: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """cnt per frame and window of event time; windows close when the watermark has passed them."""
    seen = crashes.withWatermark(time, late)
    out = seen.groupBy(F.window(time, width).alias("w"), signature(F.col("stdout")).alias("frame")).agg(F.count("*").alias("cnt"))
    return out.select(F.col("w.start").alias("start"), "frame", "cnt")


def start(counts: DataFrame, checkpoint: str, sink: str, mode: str = "complete") -> StreamingQuery:
    """Runs to the end of what is there; a restart goes on from the checkpoint.

    Every micro-batch has a folder of its own in the sink, so a batch that is run again
    replaces itself, and one that fails leaves the earlier ones.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return counts.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def current(spark: SparkSession, sink: str, mode: str = "complete", key: str = "frame") -> DataFrame:
    """What the sink holds: the latest batch of complete counts, all batches of appended ones, or each key's latest row of updates."""
    rows = spark.read.parquet(sink)
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    if mode == "update":
        names = [c for c in rows.columns if c != "batch"]
        return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*names), "batch").alias("r")).select("r.*")
    return rows.drop("batch")
