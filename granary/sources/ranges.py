"""Bytes by place: entries carry where they lie, and tasks read the ranges that they need.

A place ``loc`` is (uri, at, raw, data): a file, the byte of it at which the entry begins, and, for entries of disc
images, the size of a physical sector and where its 2,048 bytes of data begin (2,048 and 0: no sectors to skip).
Only such rows go through joins and sorts; contents are read at the end, by whoever uses them.

    spark.dataSource.register(ByteRanges)
    spark.read.format("byte_ranges").option("path", "/data/game.iso").option("chunk", "8388608").load()
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from granary.scratch import cut, scratch_path

SECTOR = 2048
LOC = "struct<uri: string, at: long, raw: int, data: int>"
#: Bytes of one range, and of the ranges of one task.
CHUNK, TASK = 8 << 20, 128 << 20
#: Bytes that a reader keeps, so that a parser's small reads don't each go to the store.
KEPT = 64 << 10
_URI = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)$", re.S)


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a plain path; spaces and the like needn't be escaped."""
    m = _URI.match(uri)
    if m is None or m[1] == "file":
        return fs.LocalFileSystem(), m[3] if m else uri
    store, root = fs.FileSystem.from_uri(f"{m[1]}:{m[2] or '//'}/")
    return store, root.rstrip("/") + m[3]


class Files:
    """The files that a task has open, the last few of them."""

    MOST = 8

    def __init__(self) -> None:
        self.open: dict[str, pa.NativeFile] = {}

    def __getitem__(self, uri: str) -> pa.NativeFile:
        if uri not in self.open:
            while len(self.open) >= self.MOST:
                self.open.pop(next(iter(self.open))).close()
            store, path = store_of(uri)
            self.open[uri] = store.open_input_file(path)
        return self.open[uri]


class Source:
    """Random access to an entry: ``size``, and ``read``, which gives zeros where the file has nothing."""

    def __init__(self, files: Files, loc, size: int):
        self.files, self.size = files, size
        self.uri, self.at, self.raw, self.data = loc["uri"], loc["at"], loc["raw"], loc["data"]
        self.kept_at, self.kept = 0, b""

    def read(self, start: int, n: int) -> bytes:
        """``n`` bytes from ``start``; those past the end of the entry or of the file, or before the begin, are zeros."""
        if start < 0:
            lead = min(n, -start)
            return bytes(lead) + self.read(0, n - lead)
        real = max(0, min(n, self.size - start))
        if real > KEPT // 2:
            got = self._physical(start, real)
        else:
            if real and not self.kept_at <= start <= start + real <= self.kept_at + len(self.kept):
                self.kept_at, self.kept = start, self._physical(start, min(KEPT, self.size - start))
            got = self.kept[start - self.kept_at : start - self.kept_at + real] if real else b""
        return got.ljust(n, b"\0")

    def _physical(self, start: int, n: int) -> bytes:
        file = self.files[self.uri]
        if self.raw == SECTOR:
            return _read_at(file, self.at + start, n)
        first, last = start // SECTOR, (start + n - 1) // SECTOR
        span = (last - first + 1) * self.raw
        got = np.frombuffer(_read_at(file, self.at + first * self.raw, span), np.uint8).reshape(-1, self.raw)
        return got[:, self.data : self.data + SECTOR].tobytes()[start - first * SECTOR :][:n]


class Buffer:
    """Bytes in memory, read like a Source."""

    def __init__(self, data: bytes):
        self.bytes, self.size = data, len(data)

    def read(self, start: int, n: int) -> bytes:
        if start < 0:
            lead = min(n, -start)
            return bytes(lead) + self.read(0, n - lead)
        return self.bytes[start : start + n].ljust(n, b"\0")


def _read_at(file: pa.NativeFile, at: int, n: int) -> bytes:
    real = max(0, min(n, file.size() - at))
    return (file.read_at(real, at) if real else b"").ljust(n, b"\0")


def plain(uri: str | F.Column) -> F.Column:
    """``loc`` of a whole file."""
    uri = F.lit(uri) if isinstance(uri, str) else uri
    return F.struct(uri.alias("uri"), F.lit(0).cast("long").alias("at"), F.lit(SECTOR).alias("raw"), F.lit(0).alias("data"))


def spread(rows: DataFrame, n_bytes: int, *by: str) -> DataFrame:
    """Rows that name ``n_bytes`` of content dealt to as many tasks as these need; only the names are moved."""
    return rows.repartition(max(1, -(-n_bytes // TASK)), *by)


def ranges(entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(entry, loc, size, start, last): the ranges of ``chunk`` bytes of entries (entry, size, loc), dealt to tasks; an empty entry has none."""
    total = entries.agg(F.sum("size")).first()[0] or 0
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk).cast("long"))
    rows = entries.filter("size > 0").select("entry", "loc", "size", F.explode(starts).alias("start"))
    return spread(rows.withColumn("last", F.col("start") + chunk >= F.col("size")), total, "entry", "start")


def each_source(batch: pa.RecordBatch, files: Files) -> Iterator[tuple[dict, Source]]:
    """Rows of a batch that have ``loc`` and ``size``, each with its source."""
    source, last = None, None
    for r in batch.to_pylist():
        place = (tuple(r["loc"].values()), r["size"])
        if place != last:
            source, last = Source(files, r["loc"], r["size"]), place
        yield r, source


def bind(entries: DataFrame) -> DataFrame:
    """``entries`` (with ``loc`` and ``size``) with ``content`` at last; for entries of under 2 GiB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for batch in batches:
            for i, (r, source) in enumerate(each_source(batch, files)):
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([source.read(0, r["size"])], pa.binary())], names=[*row.schema.names, "content"])

    return entries.mapInArrow(run, entries.select("*", F.lit(b"").alias("content")).schema)


def save(folder: str, name: str, pieces: Iterator[bytes]) -> tuple[str, int]:
    """(uri, size) of a new file ``folder``/``name``, written under another name first: a task that is run again replaces it whole."""
    store, root = store_of(folder)
    store.create_dir(root)
    part, size = f"{root}/.{name}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(part) as f:
        for piece in pieces:
            size += len(piece)
            f.write(piece)
    store.move(part, f"{root}/{name}")
    return f"{folder}/{name}", size


def located(entries: DataFrame) -> DataFrame:
    """Entries with ``loc``: as they are, or, if they have ``content`` instead, written as files below the shared folder."""
    if "loc" in entries.columns:
        return entries
    folder = scratch_path(entries.sparkSession, "stored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["content"])
            names = [(str(e), c.as_py() or b"") for e, c in zip(batch.column("entry").to_pylist(), batch.column("content"), strict=True)]
            uris = [save(folder, name, iter([data]))[0] for name, data in names]
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(uris), pa.array([len(d) for _, d in names], pa.int64())], names=[*rest.schema.names, "_uri", "_size"])

    kept = entries.drop("content")
    rows = entries.select(*kept.columns, "content").mapInArrow(run, kept.select("*", F.lit("").alias("_uri"), F.lit(0).cast("long").alias("_size")).schema)
    rows = cut(rows, "located")
    return rows.withColumn("size", F.col("_size")).withColumn("loc", plain(F.col("_uri"))).drop("_uri", "_size")


@dataclass
class _Span(InputPartition):
    """Ranges of files: (path, loc, size, start, end) each."""

    parts: list[tuple[str, dict, int, int, int]]


class ByteRanges(DataSource):
    """Options: ``path`` (a file, a folder or a disc image), ``chunk`` and ``overlap`` (bytes), ``task`` (bytes of one partition).

    Rows (path, size, start, data, last): each chunk with ``overlap`` bytes of the next.  A file of any size is read by as many
    tasks as its bytes need; the driver lists paths only.  An empty file has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, size long, start long, data binary, last boolean"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _RangeReader(o["path"], int(o.get("chunk", CHUNK)), int(o.get("overlap", 0)), int(o.get("task", TASK)))


class _RangeReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, overlap: int, task: int):
        if chunk < 1 or overlap < 0:
            raise ValueError("chunk must be at least 1 and overlap at least 0")
        self.path, self.chunk, self.overlap, self.task = path, chunk, overlap, task

    def _listed(self) -> Iterator[tuple[str, dict, int]]:
        from granary.sources import disc

        store, root = store_of(self.path)
        info = store.get_file_info(root)
        lead = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        if info.type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
                if f.type == fs.FileType.File:
                    yield f.path[len(root.rstrip("/")) + 1 :], {"uri": lead + f.path, "at": 0, "raw": SECTOR, "data": 0}, f.size
            return
        if info.type != fs.FileType.File:
            raise FileNotFoundError(self.path)
        with store.open_input_file(root) as f:
            layout = disc.layout_of(f, info.size)
            if layout is not None:
                for path, start, size in disc.walk(f, layout):
                    yield path, {"uri": self.path, "at": start * layout.raw, "raw": layout.raw, "data": layout.data}, size
                return
        yield root.rsplit("/", 1)[-1], {"uri": self.path, "at": 0, "raw": SECTOR, "data": 0}, info.size

    def partitions(self) -> list[InputPartition]:
        out, held, room = [], [], self.task
        for path, loc, size in sorted(self._listed(), key=lambda x: (x[0].lower(), x[0])):
            at = 0
            while at < size:
                end = min(size, at + max(room // self.chunk, 1) * self.chunk)
                held.append((path, loc, size, at, end))
                room -= end - at
                at = end
                if room < self.chunk:
                    out.append(_Span(held))
                    held, room = [], self.task
        return [*out, *([_Span(held)] if held else [])] or [_Span([])]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        files = Files()
        for path, loc, size, first, end in partition.parts:
            source = Source(files, loc, size)
            for start in range(first, end, self.chunk):
                data = source.read(start, min(self.chunk + self.overlap, size - start))
                columns = [pa.array([path]), pa.array([size], pa.int64()), pa.array([start], pa.int64()), pa.array([data], pa.binary()), pa.array([start + self.chunk >= size])]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "size", "start", "data", "last"])
