"""Media columns: payloads in tar shards, addressed by content.

A payload becomes an 8-bit grey PNG, 192 samples wide.  Each task appends its images to
tar shards in the shared folder, every distinct one once a shard; a row carries the image's
digest, shard, offset and length.  Two operators work on such rows: one reads only the
first bytes of each image and fills metadata columns, the other reads whole images.

Shard names hold the attempt that wrote them, and rows are written to a table when their
shards are closed, so a repeated task leaves shards that no row names and breaks nothing.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

WIDTH = 192
SHARD = 256 << 20
#: Index rows that a task holds before it closes its shard and lets them go.
HELD = 200_000
#: PNG's signature and the length of what comes before its data.
SIGNATURE, HEADER = b"\x89PNG\r\n\x1a\n", 33
INDEX = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """A grey image of the payload, rows of WIDTH samples without filters."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png made."""
    at, data = len(SIGNATURE), []
    while at < len(image):
        (size,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        if kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    return rows[:, 1:].tobytes()


def to_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with spaces up to a positive multiple of WIDTH, and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" "), len(raw)


def open_folder(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class Shards:
    """Appends members to tar files of about SHARD bytes, each payload once in a file."""

    def __init__(self, folder: str, name: str):
        self.fs, self.root = open_folder(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.number, self.stream, self.at = name, 0, None, 0
        self.places: dict[bytes, tuple] = {}

    def add(self, payload: bytes) -> tuple[str, str, int, int]:
        key = hashlib.sha256(payload).digest()
        if key not in self.places:
            image = to_png(payload)
            digest = hashlib.sha256(image).hexdigest()
            if self.stream is None:
                self.shard, self.at = f"{self.name}-{self.number}.tar", 0
                self.stream = self.fs.open_output_stream(f"{self.root}/{self.shard}")
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            head = info.tobuf(tarfile.GNU_FORMAT)
            self.stream.write(head + image + bytes(-len(image) % 512))
            self.places[key] = (digest, self.shard, self.at + len(head), len(image))
            self.at += len(head) + len(image) + -len(image) % 512
            if self.at >= SHARD:
                place = self.places[key]
                self.close()
                return place
        return self.places[key]

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(bytes(1024))
            self.stream.close()
            self.stream, self.number = None, self.number + 1
            self.places.clear()


def save(folder: str):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shards = Shards(folder, f"shard-{task.partitionId()}-{task.taskAttemptId()}")
        held = []
        for batch in batches:
            columns: list[list] = [[] for _ in INDEX]
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                payload, n = to_payload(text.as_py())
                for c, v in zip(columns, (doc_id.as_py(), n, *shards.add(payload)), strict=True):
                    c.append(v)
            held.append(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, INDEX, strict=True)], schema=INDEX))
            if sum(b.num_rows for b in held) >= HELD:
                shards.close()
            if shards.stream is None:  # rows leave only when all their shards are whole
                yield from held
                held = []
        shards.close()
        yield from held

    return run


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, str]:
    """Stores the payload of every row; (doc_id, n_bytes, digest, shard, offset, length), and the folder.

    Null text is an empty payload, one row of spaces.  Equal payloads of a shard share one
    member.  Rows without an id and repeated rows are stored like others.  A very long text
    is one image, which one task holds with its payload.
    """
    folder = folder or store.new_path(docs.sparkSession, "media")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
    return store.materialize(rows.mapInArrow(save(folder), schema), "media-index"), folder


class Reader:
    """Range reads from shards; keeps one shard open."""

    def __init__(self, folder: str):
        self.fs, self.root = open_folder(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, size: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.root}/{shard}")
        return self.file.read_at(size, offset)


def header(raw: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits a sample and colour type, from an image's first bytes."""
    if raw[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    return struct.unpack(">IIBB", raw[16:26])


def headers(folder: str):
    def run(batches):
        reader = Reader(folder)
        for b in batches:
            found = [header(reader.read(s.as_py(), o.as_py(), HEADER)) for s, o in zip(b.column("shard"), b.column("offset"), strict=True)]
            cols = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "width", "height", "bits", "colour"])

    return run


def media_metadata(index: DataFrame, folder: str) -> DataFrame:
    """index with width, height, bits and colour, from header-only range reads.

    Whatever the length of a payload, its first bytes alone are read.  Rows without an id and
    repeated rows have their own columns; an empty index gives none.
    """
    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(headers(folder), f"{plain}, width long, height long, bits long, colour long")


def bodies(folder: str):
    def run(batches):
        reader = Reader(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for r in b.to_pylist():
                image = reader.read(r["shard"], r["offset"], r["length"])
                payload = from_png(image)
                samples = np.frombuffer(payload, np.uint8)
                count = np.bincount(samples, minlength=256)
                mean = float((count * np.arange(256)).sum()) / len(samples)
                feature = f"{r['width']}x{r['height']}x{r['bits']}:mean={mean:.4f}:distinct={int((count > 0).sum())}:mode={int(count.argmax())}"
                values = (r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature)
                for c, v in zip(out, values, strict=True):
                    c.append(v)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def media_features(rows: DataFrame, folder: str) -> DataFrame:
    """Reads whole images back: sizes, digests, checksum and feature of each row.

    Null and empty texts are payloads of blanks.  A task holds one payload at a time, so a
    very long text costs its task that text's memory.  An empty table gives no row.
    """
    return rows.mapInArrow(bodies(folder), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark, sf_dir: str) -> DataFrame:
    index, folder = store_media(store.table(spark, sf_dir, "documents"))
    return media_features(media_metadata(index, folder), folder)
