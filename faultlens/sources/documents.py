"""Nested JSON documents as a sink: one indented document per target, assembled from sorted rows.

A row is a place in a document and its value: target, keys (from the root down; "[]" as the
last one is an item of a list) and value, which is JSON.  Rows of a target come sorted, as
they should stand; a container is closed when a row outside of it comes.  A task holds a row
at a time, however large the document.  Documents appear when all tasks have ended well, and
a job that fails leaves none.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from faultlens.sources.corpus import store_of

NAME = "faultlens_documents"
ITEM = "[]"


class Assembler:
    """Writes one document to a stream, row by row, indented by two blanks."""

    def __init__(self, out):
        self.out, self.open, self.kinds, self.counts = out, [], [], []
        self.last: tuple | None = None

    def put(self, text: str) -> None:
        self.out.write(text.encode())

    def entry(self, key: str, text: str) -> None:
        """Begins an entry of the innermost container."""
        self.put((",\n" if self.counts[-1] else "\n") + "  " * len(self.kinds) + ("" if key == ITEM else json.dumps(key) + ": ") + text)
        self.counts[-1] += 1

    def begin(self, kind: str) -> None:
        self.kinds.append(kind)
        self.counts.append(0)

    def close(self, depth: int) -> None:
        while len(self.kinds) > depth:
            kind = self.kinds.pop()
            self.counts.pop()
            self.put("\n" + "  " * len(self.kinds) + ("]" if kind == ITEM else "}"))
        del self.open[max(0, depth - 1) :]

    def add(self, keys: list[str], value: str | None) -> None:
        if not keys or ITEM in keys[:-1]:
            raise ValueError(f"not a place in a document: {keys}")
        if keys == self.last and keys[-1] != ITEM:
            raise ValueError(f"two values at {keys}")
        kind = lambda k: ITEM if keys[k] == ITEM else ""
        if not self.kinds:
            self.put("[" if kind(0) else "{")
            self.begin(kind(0))
        same = 0
        while same < min(len(self.open), len(keys) - 1) and self.open[same] == keys[same]:
            same += 1
        self.close(same + 1)
        for k in range(same, len(keys) - 1):
            self.entry(keys[k], "[" if kind(k + 1) else "{")
            self.begin(kind(k + 1))
            self.open.append(keys[k])
        if (self.kinds[-1] == ITEM) != (keys[-1] == ITEM):
            raise ValueError(f"a list and an object at {keys[:-1]}")
        text = json.dumps(None if value is None else json.loads(value), indent=2)
        self.entry(keys[-1], text.replace("\n", "\n" + "  " * len(self.kinds)))
        self.last = list(keys)

    def end(self) -> None:
        self.close(0)


@dataclass
class Written(WriterCommitMessage):
    """Documents of one task: their unfinished and their final paths."""

    moves: list[tuple[str, str]]


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staging = f"{self.path}/_unfinished-{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext

        store, root = store_of(f"{self.staging}/{TaskContext.get().taskAttemptId()}")
        store.create_dir(root, recursive=True)
        moves, target, out, document = [], None, None, None
        try:
            for batch in iterator:
                for name, keys, value in zip(*(batch.column(c).to_pylist() for c in ("target", "keys", "value")), strict=True):
                    if name != target or document is None:
                        if document is not None:
                            document.end()
                            out.close()
                        if not name or "/" in name or any(m[1] == f"{self.path}/{name}.json" for m in moves[-1:]):
                            raise ValueError(f"not a new document's name: {name!r}")
                        target, out = name, store.open_output_stream(f"{root}/{len(moves)}")
                        document = Assembler(out)
                        moves.append((f"{root}/{len(moves)}", f"{self.path}/{name}.json"))
                    document.add(keys, value)
            if document is not None:
                document.end()
        finally:
            if out is not None:
                out.close()
        return Written(moves)

    def commit(self, messages) -> None:
        store, _ = store_of(self.path)
        moves = [m for message in messages if message is not None for m in message.moves]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("a document came from two tasks: deal rows by target")
        for unfinished, final in moves:
            store.move(unfinished, store_of(final)[1])
        self.abort(messages)

    def abort(self, messages) -> None:
        """Deletes what isn't a finished document."""
        store, staging = store_of(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "target string, keys array<string>, value string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write_documents(rows: DataFrame, path: str, *order) -> None:
    """Writes path/<target>.json for every target; rows have target, keys, value and the columns of order.

    A document is one file and so one task's; its rows are sorted there, by disk if need be,
    and never held.  Documents of other targets stay; one of the same target is replaced.
    """
    rows.sparkSession.dataSource.register(DocumentSource)
    dealt = rows.repartition("target").sortWithinPartitions("target", *order)
    dealt.select("target", "keys", "value").write.format(NAME).mode("append").save(path)
