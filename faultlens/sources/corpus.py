"""File corpora as they are: every regular file, hidden and empty ones too, listed and read by tasks.

Spark's own file readers leave out names that begin with _ or . and, for binary files,
empty ones.  Here a table of folders is expanded level by level, each level by one job whose
tasks list folders and emit entries as they come; the driver sees one row per level.  Files
are read whole, or in ranges for files that no task should hold.

Paths are plain ones, file: URIs, or URIs of a store that pyarrow.fs knows (s3, gs, hdfs).
"""

from __future__ import annotations

import os
from datetime import UTC, datetime
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.sources import shared

SKIPPED = "README.txt"
ENTRY = "path string, file string, size long, modified timestamp, folder boolean, root int"
ENTRY_ARROW = pa.schema([("path", pa.string()), ("file", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("folder", pa.bool_()), ("root", pa.int32())])
#: Bytes that a task should read, entries in a batch, folders listed by one task.
SHARE, BATCH, FOLDERS = 64 << 20, 4096, 64


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it.  A local name may hold any character."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def entries(folder: str):
    """(name, size, modified, is a folder) of what stands in a folder; what is neither a file nor a folder is left out."""
    store, at = store_of(folder)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(at) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False) or e.is_file():
                    s = e.stat()
                    yield e.name, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC), e.is_dir(follow_symlinks=False)
        return
    for e in store.get_file_info(fs.FileSelector(at)):
        if e.type in (fs.FileType.File, fs.FileType.Directory):
            yield e.base_name, e.size or 0, e.mtime, e.type == fs.FileType.Directory


def listed(missing_ok: bool):
    """Entries of folders."""

    def run(batches):
        rows = []
        for batch in batches:
            for folder, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for name, size, modified, is_folder in entries(folder):
                        rows.append((f"{folder.rstrip('/')}/{name}", name, 0 if is_folder else size, modified, is_folder, root))
                        if len(rows) >= BATCH:
                            yield made(rows)
                            rows = []
                except (FileNotFoundError, NotADirectoryError):
                    if not missing_ok:
                        raise
        yield made(rows)

    return run


def made(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(ENTRY_ARROW)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, ENTRY_ARROW, strict=True)], schema=ENTRY_ARROW)


def matching(glob: str):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([fnmatchcase(n, glob) for n in batch.column(1).to_pylist()], pa.bool_()))

    return run


def listing(spark: SparkSession, paths: list[str], recursive: bool = False, glob: str | None = None, missing_ok: bool = False) -> DataFrame:
    """path, file, size, modified and root of all regular files of the folders, but for README.txt.

    root is the number of the folder in paths.  glob is matched with names, letter case
    counting.  A folder that isn't there is an error, or has no files with missing_ok.
    Links to files count as files, links to folders are not followed.
    """
    found = None
    folders = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "folder string, root int")
    while True:
        level = shared.written(folders.mapInArrow(listed(missing_ok), ENTRY), "listing")
        files = level.where(~F.col("folder") & (F.col("file") != SKIPPED))
        found = files if found is None else found.unionByName(files)
        inner = level.where("folder").select(F.col("path").alias("folder"), "root")
        if not recursive or not (n := inner.count()):
            break
        folders = inner.repartition(-(-n // FOLDERS), "folder")
    if glob is not None:
        found = found.mapInArrow(matching(glob), ENTRY)
    return found.select("path", "file", "size", "modified", "root")


def read_whole(batches):
    """Adds content to rows whose first column is a path; batches stay small."""
    for batch in batches:
        begin, held, data = 0, 0, []
        for k, path in enumerate(batch.column(0).to_pylist()):
            store, at = store_of(path)
            with store.open_input_stream(at) as f:
                data.append(f.read())
            held += len(data[-1])
            if held >= SHARE // 4 or k == batch.num_rows - 1:
                rows = batch.slice(begin, k + 1 - begin)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(data, pa.binary())], [*rows.schema.names, "content"])
                begin, held, data = k + 1, 0, []


def corpus(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None, content: bool = True) -> DataFrame:
    """path, file, size, modified and content of every regular file of a folder, without README.txt.

    Names that begin with _ or . and empty files are there.  With content=False nothing is
    read.  A file over 2 GB has no place in a column: read it with ranges().
    """
    files = listing(spark, [path], recursive, glob).drop("root")
    return with_content(files) if content else files


def with_content(files: DataFrame) -> DataFrame:
    """Files with their bytes, dealt over tasks by size."""
    total = files.agg((F.coalesce(F.sum(F.col("size") + (1 << 14)), F.lit(0)) / SHARE).alias("n")).first()[0]  # opening a file counts as 16 kB
    dealt = files.repartition(max(1, int(total)), "path")
    return dealt.mapInArrow(read_whole, "path string, file string, size long, modified timestamp, content binary")


def ranges(files: DataFrame, width: int = SHARE) -> DataFrame:
    """path, size and at: where each range of `width` bytes of a file begins, dealt over tasks; an empty file has one."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(width).cast("long")))
    cut = files.select("path", "size", at.alias("at"))
    total = files.agg((F.coalesce(F.sum(F.greatest("size", F.lit(1 << 14))), F.lit(0)) / SHARE).alias("n")).first()[0]
    return cut.repartition(max(1, int(total)), "path", "at")


def range_of(path: str, begin: int, end: int) -> bytes:
    """Bytes of a file from begin to end, or to the file's end."""
    store, at = store_of(path)
    with store.open_input_file(at) as f:
        size = f.size()
        begin, end = max(0, begin), min(end, size)
        if end <= begin:
            return b""
        f.seek(begin)
        return f.read(end - begin)


def placed(root: str, name: str | None) -> tuple[str, fs.FileSystem, str, str]:
    """Path of a name below root, its file system, its place there, and a place to write it first; its folder is made."""
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"not a name inside the corpus: {name!r}")
    path = f"{root.rstrip('/')}/{name}"
    store, at = store_of(path)
    folder, _, last = at.rpartition("/")
    store.create_dir(folder, recursive=True)
    return path, store, at, f"{folder}/.{last}.{os.getpid()}"


def report_of(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "size"])


def put(root: str):
    """Writes files and reports them; an attempt that is run again replaces what it wrote."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path, store, at, unfinished = placed(root, name)
                with store.open_output_stream(unfinished) as f:
                    f.write(data or b"")
                store.move(unfinished, at)
                rows.append((path, len(data or b"")))
            yield report_of(rows)

    return run


def copied(root: str):
    """Copies files part by part, whatever their size."""

    def run(batches):
        for batch in batches:
            rows = []
            for source, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path, store, at, unfinished = placed(root, name)
                there, where = store_of(source)
                size = 0
                with there.open_input_stream(where) as f, store.open_output_stream(unfinished) as out:
                    while part := f.read(1 << 20):
                        out.write(part)
                        size += len(part)
                store.move(unfinished, at)
                rows.append((path, size))
            yield report_of(rows)

    return run


def copy_existing(wanted: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Copies the files whose names are wanted (a column `file`) below root; returns a table of path and size.

    files: path and file, of distinct names, as a flat listing has them.  A wanted name that isn't there is no error.
    """
    some = files.join(wanted.select("file").distinct(), "file", "left_semi").select("path", "file")
    return shared.written(some.mapInArrow(copied(root), "path string, size long"), "copied")


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Writes rows (name, content) as files below root, folders as needed; returns a table of path and size.

    A null content is an empty file.  Names must be distinct.
    """
    return shared.written(rows.select(F.col("name").cast("string"), F.col("content").cast("binary")).mapInArrow(put(root), "path string, size long"), "files")
