"""Documents and texts as DataFrames, and their writers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.semistructured import is_json
from faultlens.sources import corpus, shared


def latest(files: DataFrame) -> DataFrame:
    """The last file by name, in byte order."""
    return files.orderBy(F.desc("path")).limit(1)


def first_directory(spark: SparkSession, paths: list[str], glob: str = "id*") -> DataFrame:
    """The last file by name of the first directory that has one; a directory that isn't there has none."""
    found = corpus.listing(spark, paths, glob=glob, missing_ok=True).withColumnRenamed("root", "priority")
    return found.orderBy("priority", F.desc("path")).limit(1)


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document; what is missing or invalid is a row of nulls."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = spark.createDataFrame([(None,)], "value string")
    record = F.from_json(F.when(is_json(F.col("value")), F.col("value")).otherwise("{}"), schema)
    return text.select(record.alias("r")).select("r.*")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "source_code")


def write_json(df: DataFrame, path: str) -> None:
    """One object a line."""
    df.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """An ordered text file of (section, line_no, line); a report is one file.

    With a target_id, a folder of each target has its report.
    """
    order = ["section", "line_no"]
    if "target_id" in lines.columns:
        lines.repartition("target_id").sortWithinPartitions("target_id", *order).select("target_id", "line").write.mode("overwrite").partitionBy("target_id").text(path)
    else:
        lines.repartitionByRange(1, *order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


REPORT_INDEX = "target_id {}, part int, file string, at long, size long, lines long"


def write_part(root: str):
    """Writes a sorted partition's lines as one file, and says where each target's lines are in it."""

    def run(batches):
        from pyspark import TaskContext

        part, out, rows, at = TaskContext.get().partitionId(), None, [], 0
        store, folder = corpus.store_of(root)
        name = f"part-{part:06}.md"
        unfinished = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            kind = batch.schema.field(0).type
            for target, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(unfinished)
                data = (line or "").encode() + b"\n"
                out.write(data)
                if not rows or rows[-1][0] != target:
                    rows.append([target, part, f"{root}/{name}", at, 0, 0])
                rows[-1][4] += len(data)
                rows[-1][5] += data.count(b"\n")
                at += len(data)
        if out is not None:
            out.close()
            store.move(unfinished, f"{folder}/{name}")
            kinds = (kind, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["target_id", "part", "file", "at", "size", "lines"])

    return run


def write_report(lines: DataFrame, path: str) -> DataFrame:
    """Writes the lines of all targets in order, by many tasks, and returns where each target's are.

    Lines are dealt by ranges of (target, section, line number), so a target with most lines
    is several tasks'.  The files by name, one behind the other, are the whole report.  The index has a
    row per target and file: target_id, part, file, at, size, lines, before: the target's lines in earlier files.
    """
    order = ["target_id", "section", "line_no"]
    kind = lines.schema["target_id"].dataType.simpleString()
    ranged = lines.select(*order, "line").repartitionByRange(*order).sortWithinPartitions(*order)
    index = shared.written(ranged.mapInArrow(write_part(path.rstrip("/")), REPORT_INDEX.format(kind)), "index")
    earlier = Window.partitionBy("target_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))


def read_report(index: DataFrame) -> DataFrame:
    """target_id, n and line: each target's lines from 1 on, read by the index from the bytes of its files."""
    kind = index.schema["target_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lines = corpus.range_of(r["file"], r["at"], r["at"] + r["size"]).decode().split("\n")[:-1]
                yield pa.RecordBatch.from_pydict({"target_id": pa.array([r["target_id"]] * len(lines), batch.schema.field("target_id").type), "n": pa.array(range(r["before"] + 1, r["before"] + 1 + len(lines)), pa.int64()), "line": pa.array(lines, pa.string())})

    return index.mapInArrow(run, f"target_id {kind}, n long, line string")


def setting(spark: SparkSession, name: str, default: str) -> str:
    return spark.conf.get(name, default)
