"""Folders that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made in this process that nothing has deleted yet.
_made: set[str] = set()


def base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to setCheckpointDir; in local mode without either, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.faultlens.files.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="faultlens-files-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.faultlens.files.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path; cleanup() deletes what was written there."""
    path = f"{base(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: lineage ends here, and a lost executor costs a re-read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.discard(path)


def cleanup(spark: SparkSession) -> None:
    """Deletes all that was written here in this process; only when no result that reads it is needed any more."""
    for path in list(_made):
        delete(spark, path)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _made:
        try:
            cleanup(spark)
        except Exception:  # the session's JVM has gone already  # noqa: BLE001
            pass
