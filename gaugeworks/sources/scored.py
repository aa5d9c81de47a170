"""Scored lines as a data source: JSON lines written under a commit protocol, read as far as they were committed, a partition a file.

Each task writes one file under a name that no other attempt uses; the commit then puts a manifest with the files' names, lines and sizes beside them, by way of a temporary name. What no manifest names (a task that failed, a
run that was killed) is never read. Folders are local or shared paths, or URIs that Arrow's file systems know.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from gaugeworks.operators.scoring import LINE


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(path: str, data: bytes) -> None:
    """A reader sees the whole file or none."""
    store, at = _store(path)
    folder, _, name = at.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, at)


@dataclass
class Written(WriterCommitMessage):
    name: str
    lines: int
    size: int


@dataclass
class File(InputPartition):
    path: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> Written:
        # strict JSON: a number that is none is refused, and text stays as it is; only a line feed ends a line
        name, lines, size = f"{uuid.uuid4().hex}.jsonl", 0, 0
        store, at = _store(f"{self.path}/lines")
        part = f"{at}/.{name}"
        out = None
        try:
            for r in rows:  # line by line: a task holds none but the one it writes
                if out is None:
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(part, buffer_size=1 << 20)
                line = (json.dumps(r.asDict(recursive=True), ensure_ascii=False, allow_nan=False) + "\n").encode()
                out.write(line)
                lines, size = lines + 1, size + len(line)
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(part)
            raise
        if out is not None:
            out.close()
            store.move(part, f"{at}/{name}")
        return Written(name, lines, size)

    def commit(self, messages: list[Written | None]) -> None:
        files = [{"name": m.name, "lines": m.lines, "size": m.size} for m in messages if m and m.lines]
        if files:
            _put(f"{self.path}/manifests/{uuid.uuid4().hex}.json", (json.dumps({"files": files}, indent=2) + "\n").encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.lines:
                store, at = _store(f"{self.path}/lines/{m.name}")
                store.delete_file(at)


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[File]:
        from pyarrow import fs

        store, at = _store(f"{self.path}/manifests")
        found = []
        for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if info.base_name.endswith(".json") and not info.base_name.startswith("."):
                with store.open_input_stream(info.path) as file:
                    found += [File(f"{self.path}/lines/{f['name']}") for f in json.loads(file.read())["files"]]
        return found or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition.path:
            store, at = _store(partition.path)
            with store.open_input_stream(at, buffer_size=1 << 20) as file:
                for line in io.BufferedReader(file):
                    if line != b"\n":
                        r = json.loads(line)
                        answers = r["answers"] and [(a["qid"], a["keys"], a["p"], a["logits"]) for a in r["answers"]]
                        yield (r["request_sha256"], r["id"], answers, r["error"], r["latency_ms"])


class ScoredLines(DataSource):
    """format("scored_lines"): rows of LINE in a folder (the path)."""

    @classmethod
    def name(cls) -> str:
        return "scored_lines"

    def schema(self) -> str:
        return LINE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"].rstrip("/"), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("scored lines are only appended to")
        return _Writer(self.options["path"].rstrip("/"))
