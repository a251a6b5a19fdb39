"""Written tracks with a commit: nothing is seen below the folder before all of it is there.

    spark.dataSource.register(TrackFolder)
    rows.write.format("track_folder").option("path", folder).mode("append").save()

Rows are (track_id, out, line, status, wav): the path below the folder, the manifest's line, and the bytes of the
file, null where a track couldn't be made.  A task writes its files below a folder of the job that no reader looks
into, and a list of them; tasks that are run again or twice write under other names.  The commit moves what the tasks that count have
listed, then writes the manifest ``tracks.csv`` from their lines, and removes the job's folder; an abort only removes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from granary.functions.numbers import duration
from granary.operators.catalog import manifest
from granary.scratch import cut, drop
from granary.sources import ranges, wav

MANIFEST, REPORT = "tracks.csv", "report.json"
SCHEMA = "track_id long, out string, line string, status string, wav binary"
#: Columns of the manifest, in order (fixed values of its format).
FIELDS = ("file", "source", "offset", "format", "channels", "sample_rate", "seconds", "loop_start", "loop_end", "note")


class TrackFolder(DataSource):
    """Options: ``path``, the folder, and ``head``, the manifest's first line."""

    @classmethod
    def name(cls) -> str:
        return "track_folder"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"].rstrip("/"), self.options.get("head", ",".join(FIELDS)))


@dataclass
class _Written(WriterCommitMessage):
    """Where a task's list is, and the least id in it."""

    listed: str
    first: int
    done: int
    failed: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, head: str):
        self.folder, self.head, self.job = folder, head, f".pending-{uuid.uuid4().hex}"
        store, root = ranges.store_of(folder)
        store.create_dir(f"{root}/{self.job}")  # by the planner: a task that outlives an abort can't bring it back

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, root = ranges.store_of(self.folder)
        task = f"{self.job}/{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{task}", recursive=False)
        first, done, failed, k = 1 << 62, 0, 0, 0
        with store.open_output_stream(f"{root}/{task}/list") as listed:
            for batch in batches:
                for i, out, line, status, data in zip(*(batch.column(c) for c in ("track_id", "out", "line", "status", "wav")), strict=True):
                    row = {"track_id": i.as_py(), "out": out.as_py(), "line": line.as_py(), "status": status.as_py(), "at": None}
                    if data.is_valid:
                        row["at"], k, done = f"{task}/{k}", k + 1, done + 1
                        with store.open_output_stream(f"{root}/{row['at']}") as f:
                            f.write(data.as_buffer())
                    else:
                        failed += 1
                    first = min(first, row["track_id"])
                    listed.write(json.dumps(row).encode() + b"\n")
        return _Written(f"{task}/list", first, done, failed)

    def _listed(self, store: fs.FileSystem, root: str, messages: list) -> Iterator[dict]:
        """Rows of all tasks by the ids that their lists begin with, one list at a time."""
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.first):
            with store.open_input_stream(f"{root}/{m.listed}") as f:
                for line in f.read().splitlines():
                    yield json.loads(line)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = ranges.store_of(self.folder)
        made: set[str] = set()
        for row in self._listed(store, root, messages):
            if row["at"] is not None:
                target = f"{root}/{row['out']}"
                if (parent := target.rsplit("/", 1)[0]) not in made:
                    made.add(parent)
                    store.create_dir(parent)
                store.move(f"{root}/{row['at']}", target)
        with store.open_output_stream(f"{root}/{self.job}/{MANIFEST}") as f:
            f.write(self.head.encode() + b"\n")
            for row in self._listed(store, root, messages):
                f.write(row["line"].encode() + b"\n")
        counts = {"written": sum(m.done for m in messages if m), "failed": sum(m.failed for m in messages if m)}
        with store.open_output_stream(f"{root}/{self.job}/{REPORT}") as f:
            f.write(json.dumps(counts).encode())
        for name in (REPORT, MANIFEST):  # the manifest last: where it is, all files are
            store.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        store.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = ranges.store_of(self.folder)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


def fields(source: str = "source") -> dict[str, F.Column]:
    """The manifest's columns of tracks (wav.TRACK, ``out`` and the path that they come from)."""
    seconds = F.format_string("%.3f", duration(F.col("samples"), F.col("rate")))
    values = (F.col("out"), F.col(source), F.format_string("0x%X", F.col("offset")), F.col("format"), F.col("channels"), F.col("rate"), seconds, F.col("loop_start"), F.col("loop_end"), F.lit(""))
    return dict(zip(FIELDS, values, strict=True))


def write_tracks(entries: DataFrame, tracks: DataFrame, folder: str, loops_twice: bool = False) -> dict[str, int]:
    """Write ``tracks`` (wav.TRACK, ``track_id``, ``out`` and ``source``) as WAVE files below ``folder``, with their manifest, in one commit.

    Gives the numbers of tracks ``written`` and ``failed``; a track that can't be made has a line in the manifest, but no file.  Tracks are
    dealt out by rising number, as places; each task reads the samples of its own.  If the job fails or is cancelled,
    neither files nor a manifest appear.
    """
    spark = entries.sparkSession
    spark.dataSource.register(TrackFolder)
    lines = manifest(tracks, fields(), "track_id")
    places = ranges.located(entries).select("entry", "size", "loc")
    rows = tracks.join(places, "entry").join(lines, "track_id")
    rows = rows.select("track_id", "out", "line", "size", "loc", "data_at", "data_size", "channels", "bits", "rate", "loop_start", "loop_end")
    n_bytes = tracks.agg(F.sum("data_size")).first()[0] or 0
    dealt = cut(rows.repartitionByRange(max(1, -(-n_bytes // ranges.TASK)), "track_id").sortWithinPartitions("track_id"), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ranges.Files()
        for batch in batches:
            for r, source in ranges.each_source(batch, files):
                status, made = wav.rendered(source, r, loops_twice)
                columns = [pa.array([r["track_id"]], pa.int64()), *[pa.array([x], pa.string()) for x in (r["out"], r["line"], status)], pa.array([made], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["track_id", "out", "line", "status", "wav"])

    dealt.mapInArrow(run, SCHEMA).write.format("track_folder").option("path", folder).mode("append").save()
    drop(dealt)
    store, root = ranges.store_of(folder.rstrip("/"))
    with store.open_input_stream(f"{root}/{REPORT}") as f:
        return json.loads(f.read())
