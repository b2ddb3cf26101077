"""Sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def jsonl(df: DataFrame, path: str) -> None:
    """One object a line, in UTF-8."""
    df.write.mode("overwrite").json(path)


class _JsonArrayWriter(DataSourceWriter):
    """Tasks write parts of records beside the file; the commit frames them, in the order of partitions, into one array."""

    def __init__(self, path: str, indent: int, overwrite: bool):
        self.fs, self.path = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.uri, self.indent, self.overwrite, self.parts = path, indent, overwrite, f"{self.path}.parts-{uuid.uuid4().hex}"

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "fs"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.fs = pafs.FileSystem.from_uri(self.uri)[0] if "://" in self.uri else pafs.LocalFileSystem()

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        at = TaskContext.get()
        part = f"{self.parts}/{at.partitionId():08}-{at.taskAttemptId()}"  # an attempt that is lost leaves a part that no commit names
        self.fs.create_dir(self.parts, recursive=True)
        n, pad = 0, " " * self.indent
        with self.fs.open_output_stream(part) as out:
            for row in iterator:
                text = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=self.indent, default=str).replace("\n", f"\n{pad}")
                out.write(f"{',' if n else ''}\n{pad}{text}".encode())
                n += 1
        return _Part(part, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = sorted(m.path for m in messages if m is not None and m.rows)
        if not self.overwrite and self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_dir(self.parts)
            raise FileExistsError(self.uri)
        whole = f"{self.path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(whole) as out:
            out.write(b"[")
            for i, part in enumerate(done):
                out.write(b"," if i else b"")
                with self.fs.open_input_stream(part) as text:
                    while piece := text.read(1 << 20):
                        out.write(piece)
            out.write(b"\n]\n" if done else b"]\n")
        self.fs.move(whole, self.path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.fs.get_file_info(self.parts).type != pafs.FileType.NotFound:
            self.fs.delete_dir(self.parts)


@dataclass
class _Part(WriterCommitMessage):
    path: str
    rows: int


class JsonArray(DataSource):
    """The format json_array: options path (a file that driver and executors share) and indent."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _JsonArrayWriter(self.options["path"], int(self.options.get("indent", "4")), overwrite)


def json_array(df: DataFrame, path: str, indent: int = 4, overwrite: bool = True) -> None:
    """The rows as one JSON array in one file, indented, non-ASCII as it is, nulls kept, in the order of the partitions.

    Tasks write their records, the driver only copies these bytes one after the other; no row is held but the one at hand. The file is there whole or not at all.
    """
    df.sparkSession.dataSource.register(JsonArray)
    df.write.format("json_array").option("indent", str(indent)).mode("overwrite" if overwrite else "append").save(path)


def append(df: DataFrame, path: str) -> None:
    """Adds records to a checkpoint of JSON lines; each call is atomic."""
    df.write.mode("append").json(path)


def model(fitted, path: str) -> None:
    fitted.write().overwrite().save(path)
