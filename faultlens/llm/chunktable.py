"""Documents packed into compressed chunks, so that whole texts move as few rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, store
from . import textarrays as ta

SCHEMA = "cid long, ids binary, known binary, offsets binary, raw long, data binary"
ARROW = pa.schema([("cid", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("offsets", pa.binary()), ("raw", pa.int64()), ("data", pa.binary())])


def pack(extra=None, fields=()):
    """Chunks of documents; extra(chunk, rows of the batch) adds binary columns of these names."""
    schema = pa.schema([*ARROW, *((f, pa.binary()) for f in fields)])

    def run(batches):
        from pyspark import TaskContext

        cid = TaskContext.get().partitionId() << 32
        out = blobs.Rows(schema)
        for batch in batches:
            ids = batch.column(0)
            known = np.array(ids.is_valid(), bool) if len(ids) else np.zeros(0, bool)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for c in ta.chunks(batch.column(1)):
                rows = slice(c.first, c.first + c.n)
                data = pa.compress(c.data.tobytes(), codec="zstd", asbytes=True)
                more = extra(c, batch.slice(c.first, c.n)) if extra else ()
                out.add(cid, ids[rows].tobytes(), known[rows].tobytes(), c.offsets.tobytes(), len(c.data), data, *more)
                cid += 1
                yield from out.ready()
        yield out.flush()

    return run


def chunk_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Writes the chunks of docs once; a chunk's cid stays what it is from then on."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return store.materialize(rows.mapInArrow(pack(), SCHEMA), "chunks", "none")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, ta.Chunk]:
    """Ids, which of them are known, and the chunk of one row."""
    raw = pa.decompress(row["data"], decompressed_size=row["raw"], codec="zstd", asbytes=True) if row["raw"] else b""
    chunk = ta.Chunk(np.frombuffer(raw, np.uint8), np.frombuffer(row["offsets"], np.int64), 0)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), chunk


def each(batches):
    """Rows of record batches as dicts, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def with_replies(table: DataFrame, **replies: DataFrame) -> DataFrame:
    """Each chunk with its replies: one array of (bucket, bits) per named set."""
    for name, r in replies.items():
        table = table.join(r.withColumnRenamed("replies", name).hint("merge"), "cid", "left")
    return table


def gathered(rows: DataFrame, answer) -> DataFrame:
    """Sends packed keys to their buckets, and the bits of each chunk back to it."""
    bits = rows.groupBy("bucket").applyInArrow(answer, blobs.REPLY)
    return bits.groupBy("cid").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"))
