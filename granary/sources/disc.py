"""ISO 9660 images as a Spark data source (from the public standard ECMA-119).

    spark.dataSource.register(DiscImage)
    spark.read.format("disc_image").option("path", "/data/game.iso").load()

Rows are (path, size, start, raw, data): the place of each file in the image.  Sectors of
2048 bytes, and of 2352 bytes with their 2048 bytes of data at 24 or 16, are known.  The
directories are read once, when the scan is planned; contents are read by executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LAYOUTS = ((2048, 0), (2352, 24), (2352, 16))
SECTOR, DIRECTORY_LIMIT = 2048, 64 << 20


@dataclass
class Layout:
    raw: int
    data: int

    def read(self, file, start: int, size: int) -> bytes:
        """``size`` bytes of user data from sector ``start``; zeros where the image ends before."""
        if self.raw == SECTOR:
            file.seek(start * SECTOR)
            got = file.read(size)
        else:
            parts = []
            for k in range(-(-size // SECTOR)):
                file.seek((start + k) * self.raw + self.data)
                parts.append(file.read(SECTOR).ljust(SECTOR, b"\0"))
            got = b"".join(parts)[:size]
        return got.ljust(size, b"\0")


def layout_of(file, size: int) -> Layout | None:
    for raw, data in LAYOUTS:
        file.seek(16 * raw + data)
        if file.read(6) == b"\x01CD001" and (raw == SECTOR or size % raw == 0):
            return Layout(raw, data)
    return None


def walk(file, layout: Layout) -> Iterator[tuple[str, int, int]]:
    """(path, first sector, size) of every file; a directory that was seen is not entered again."""
    root = layout.read(file, 16, SECTOR)[156:190]
    todo, seen = [("", root)], set()
    while todo:
        base, record = todo.pop()
        start, size = int.from_bytes(record[2:6], "little"), int.from_bytes(record[10:14], "little")
        if start in seen or size > DIRECTORY_LIMIT:
            continue
        seen.add(start)
        data, at = layout.read(file, start, size), 0
        while at < len(data):
            n = data[at]
            if n == 0:  # records don't cross sectors
                at = (at // SECTOR + 1) * SECTOR
                continue
            entry = data[at : at + n]
            at += n
            name = entry[33 : 33 + entry[32]] if n > 33 else b""
            if name in (b"\0", b"\x01", b""):
                continue
            path = base + name.decode("utf-8", "replace").split(";")[0].rstrip(".")
            if entry[25] & 2:
                todo.append((path + "/", entry))
            else:
                yield path, int.from_bytes(entry[2:6], "little"), int.from_bytes(entry[10:14], "little")


class DiscImage(DataSource):
    """Option ``path``: an image that driver and executors can open."""

    @classmethod
    def name(cls) -> str:
        return "disc_image"

    def schema(self) -> str:
        return "path string, size long, start long, raw int, data int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from granary.sources.ranges import store_of

        store, path = store_of(partition.value)
        with store.open_input_file(path) as f:
            layout = layout_of(f, f.size())
            if layout is None:
                raise ValueError(f"no known image layout: {partition.value}")
            for path, start, size in walk(f, layout):
                yield path, size, start, layout.raw, layout.data


def contents(spark: SparkSession, image: str, files: DataFrame) -> DataFrame:
    """``files`` of a disc image (path, size, start, raw, data) with ``content``, read where the rows are."""

    def run(batches):
        import pyarrow as pa

        with open(image, "rb") as f:
            for batch in batches:
                rows = batch.to_pylist()
                got = [Layout(r["raw"], r["data"]).read(f, r["start"], r["size"]) for r in rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*batch.schema.names, "content"])

    return files.mapInArrow(run, files.select("*", F.lit(b"").alias("content")).schema)
