"""Shared tables of intermediate results, and the input tables."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What `[^\x20\x09-\x0D]+` splits at, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, the folder given to setCheckpointDir; in local mode alone
    a temporary one is made, as on a cluster its machines would each have their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.faultlens.shared.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="faultlens-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.faultlens.shared.dir", base)
    return base.rstrip("/")


#: Tables and folders made in this process that nothing has deleted yet, and the threads that made them.
_made: dict[str, int] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/faultlens/{name}-{uuid.uuid4().hex}"
    _made[path] = threading.get_ident()
    return path


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    _made.pop(path, None)


@contextlib.contextmanager
def recording(into: set[str]):
    """Adds to a set what this thread makes meanwhile and doesn't delete again."""
    before = set(_made)
    try:
        yield
    finally:
        into |= {path for path, thread in _made.items() if path not in before and thread == threading.get_ident()}


def clear(spark: SparkSession, paths: set[str], docs: DataFrame) -> None:
    """Deletes recorded tables and folders that docs doesn't read."""
    used = folders(docs)
    for path in [p for p in paths if p.rsplit("/", 1)[1] not in used]:
        delete(spark, path)


def cleanup(spark: SparkSession) -> None:
    """Deletes all that operators made in this process; only when no result of theirs is read any more."""
    for path in list(_made):
        delete(spark, path)


def folders(df: DataFrame) -> set[str]:
    """Last names of the folders whose files df reads."""
    return {f.rsplit("/", 2)[1] for f in df.inputFiles()}


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here.

    A lost executor costs a re-read, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of the batches that go to Python workers, where the session doesn't say: whole texts are in memory in the JVM and in Python, for each task.
ROWS_KEY, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def bound_batches(spark: SparkSession) -> None:
    """Batches of ROWS rows for this session, unless it has set their size."""
    if spark.conf.get(ROWS_KEY, None) is None:
        spark.conf.set(ROWS_KEY, ROWS)


#: Seconds between two clean-ups at least, and when the last one was.
PAUSE = 4.0
_last = [0.0]


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of frames that are gone, now and then."""
    if time.monotonic() - _last[0] < PAUSE:
        return
    _last[0] = time.monotonic()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nothing reads any more."""
    for df in frames:
        read = folders(df)
        for path in [p for p in list(_made) if p.rsplit("/", 1)[1] in read]:
            delete(spark, path)


def total_bytes(df: DataFrame) -> int:
    """Size of the files a scan reads, from their listing alone."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return total


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def key_of(*cols: str):
    """A 128-bit key of the named columns; nulls differ from every value."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))
