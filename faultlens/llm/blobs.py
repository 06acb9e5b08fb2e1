"""Exchange of packed keys: many keys travel in few rows.

A chunk sorts its distinct keys into buckets by hash and sends one row per bucket, so
the JVM moves bytes and not rows, and a key that fills a third of the corpus arrives at
most once per chunk.  A bucket answers each of its rows with one bit per key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ROW = "cid long, bucket int, keys binary, extra binary"
REPLY = "cid long, bucket int, bits binary"


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high bits of uniformly distributed 64-bit keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Split:
    """Sorted keys by bucket: the buckets that occur, and where each one's keys begin and end."""

    def __init__(self, keys: np.ndarray, n: int):
        self.buckets, begin = np.unique(bucket_of(keys, n), return_index=True)
        self.edges = np.append(begin, len(keys))

    def __iter__(self):
        """(bucket, slice of its keys)."""
        return ((int(b), slice(i, j)) for b, i, j in zip(self.buckets, self.edges[:-1], self.edges[1:], strict=True))

    def unpack(self, replies) -> np.ndarray:
        """A chunk's answer bits in the order of its sorted keys; replies: (bucket, bits) pairs."""
        out = np.zeros(self.edges[-1], bool)
        for r in replies or ():
            k = np.searchsorted(self.buckets, r["bucket"])
            lo, hi = self.edges[k], self.edges[k + 1]
            out[lo:hi] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=hi - lo).astype(bool)
        return out


def number_for(n_bytes: int, per_bucket: int) -> int:
    """Buckets so that each holds about per_bucket bytes of input, at least 6."""
    return int(max(6, -(-n_bytes // per_bucket)))


class Rows:
    """Collects rows and hands them out as record batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 4 << 20):
        self.schema, self.limit, self.rows, self.size = schema, limit, [[] for _ in schema], 0

    def add(self, *values) -> None:
        for column, v in zip(self.rows, values, strict=True):
            column.append(v)
            self.size += len(v) if isinstance(v, bytes) else 16

    def ready(self):
        if self.size >= self.limit:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(self.rows, self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [[] for _ in self.schema], 0
        return batch


KEYS = pa.schema([("cid", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
BITS = pa.schema([("cid", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])

