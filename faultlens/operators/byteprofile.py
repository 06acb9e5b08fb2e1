"""Profiles of byte contents: chunks, printable share, lines, patterns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_counts(files: DataFrame, key: str = "id", width: int = 4) -> DataFrame:
    """(key, chunk, n): fixed-width chunks of `content`, a rest dropped.

    Chunks are slices of the binary; slicing hex text would scan each text once a chunk.
    """
    whole = files.where(F.octet_length("content") >= width)
    at = F.explode(F.sequence(F.lit(0), (F.octet_length("content") / width).cast("int") - 1))
    cut = whole.select(key, "content", at.alias("at")).select(key, F.substring(F.col("content"), F.col("at") * width + 1, F.lit(width)).alias("chunk"))
    return cut.groupBy(key, "chunk").agg(F.count("*").alias("n"))


def counted(content: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct chunks of some bytes and their counts, from the most frequent on; ties: the larger chunk first."""
    whole = np.frombuffer(content, np.uint8)[: len(content) // width * width].reshape(-1, width)
    if width == 4:
        values, n = np.unique(whole.view(">u4").ravel(), return_counts=True)
        values = values.astype(">u4").view(np.uint8).reshape(-1, 4)
    else:
        values, n = np.unique(whole, axis=0, return_counts=True)
    order = np.lexsort((-np.arange(len(n)), -n))
    return values[order], n[order]


def top_chunks(files: DataFrame, key: str = "id", width: int = 4, k: int = 3) -> DataFrame:
    """The k most frequent chunks of each row's content that occur more than once; ties: the larger chunk first.

    The count filter comes after the cut, so a file of single chunks has none.  A row holds
    its whole file, so its task counts its chunks and nothing is shuffled; files that no row
    should hold go through byteranges.top_chunks.  Null content has no chunks.
    """
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, rnk, chunk, n = [], [], [], []
            for i, content in enumerate(batch.column(1)):
                values, counts = counted(content.as_py() or b"", width)
                for j in range(min(k, len(counts))):
                    if counts[j] > 1:
                        rows.append(i)
                        rnk.append(j + 1)
                        chunk.append(values[j].tobytes().hex())
                        n.append(int(counts[j]))
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(rnk, pa.int64()), pa.array(chunk, pa.string()), pa.array(n, pa.int64())], [key, "rnk", "chunk", "n"])

    return files.select(key, "content").mapInArrow(run, f"`{key}` {kind}, rnk long, chunk string, n long")


def nonprintable(text: Column) -> tuple[Column, Column, Column]:
    """size, bytes outside space to tilde, and their percent cut to one decimal (null if empty)."""
    size = F.octet_length(text).cast("long")
    count = size - F.length(F.regexp_replace(text, "[^ -~]", ""))
    tenths = F.floor(count * 1000 / F.nullif(size, F.lit(0)))
    return size, count.cast("long"), tenths.cast("double") / 10.0


def has_bytes(content: Column, needle: bytes) -> Column:
    """A true byte match."""
    return F.contains(content, F.lit(needle))


def has_hex(content: Column, needle: bytes) -> Column:
    """A match in hex text, which can start inside a byte: the older behaviour."""
    return F.hex(content).contains(needle.hex().upper())


def looks_textual(content: Column) -> Column:
    """An approximation: valid UTF-8 without a zero byte."""
    return F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.lit(b"\x00"))


def dump(content: Column, n: int = 160) -> Column:
    """The first n bytes as hex."""
    return F.lower(F.hex(F.substring(content, 1, n)))
