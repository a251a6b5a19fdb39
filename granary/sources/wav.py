"""RIFF/WAVE (from the public specification): headers to rows, PCM to samples, and samples to files."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.numbers import duration
from granary.operators.catalog import manifest
from granary.scratch import cut
from granary.sources import ranges

TRACK = (
    "entry long, offset long, end long, format string, label string, channels int, rate long, samples long, "
    "loop_start long, loop_end long, data_at long, data_size long, bits int"
)


def parse(source: ranges.Source | ranges.Buffer, at: int) -> list[dict]:
    """The track of the RIFF/WAVE chunk list at ``at``, of which only the headers of chunks are read; none if it isn't one."""
    head = source.read(at, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return []
    end = min(source.size, at + 8 + int.from_bytes(head[4:8], "little"))
    form, body, loop = None, None, (None, None)
    k = at + 12
    while k + 8 <= end:
        head = source.read(k, 8)
        name, size = head[:4], int.from_bytes(head[4:8], "little")
        if name == b"fmt " and size >= 16:
            form = struct.unpack("<HHIIHH", source.read(k + 8, 16))
        elif name == b"smpl" and size >= 60 and int.from_bytes(source.read(k + 36, 4), "little"):
            first, last = struct.unpack("<II", source.read(k + 8 + 44, 8))
            loop = (first, last + 1)
        elif name == b"data":
            body = (k + 8, min(size, end - k - 8))
        k += 8 + size + size % 2
    if form is None or body is None or form[0] != 1 or form[5] not in (8, 16) or not 0 < form[1] <= 64:
        return []
    samples = body[1] // (form[1] * form[5] // 8)
    if loop[0] is not None and not loop[0] < loop[1] <= samples:
        loop = (None, None)
    track = {
        "offset": at, "end": end, "format": "WAV", "label": None, "channels": form[1], "rate": form[2], "samples": samples,
        "loop_start": loop[0], "loop_end": loop[1], "data_at": body[0], "data_size": body[1], "bits": form[5],
    }
    return [track]


def batch_of(rows: list[dict], schema: str = TRACK) -> pa.RecordBatch:
    """Rows as a batch of a schema of longs, ints and strings; fields that a row lacks are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def tracks(entries: DataFrame) -> DataFrame:
    """TRACK rows of every WAVE file in entries with ``content``, alone or inside something else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data, at = ranges.Buffer(r["content"] or b""), -1
                while (at := data.bytes.find(b"RIFF", at + 1)) >= 0:
                    out += [{"entry": r["entry"], **got} for got in parse(data, at)]
            yield batch_of(out)

    return entries.select("entry", "content").mapInArrow(run, TRACK)


def decode(data: bytes, channels: int, bits: int) -> np.ndarray:
    """int16 frames by channels."""
    if bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.int16) - 128) * 256
    else:
        x = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    return x[: len(x) // channels * channels].reshape(-1, channels)


def encode(frames: np.ndarray, rate: int, loop: tuple[int, int] | None = None) -> bytes:
    """A 16-bit WAVE file; ``loop`` (start, end past the last frame) goes into a smpl chunk before the data."""
    body = np.ascontiguousarray(frames, dtype="<i2").tobytes()
    channels = frames.shape[1]
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16)
    if loop:
        head += b"smpl" + struct.pack("<I9I6I", 60, 0, 0, 1_000_000_000 // max(rate, 1), 60, 0, 0, 0, 1, 0, 0, 0, loop[0], loop[1] - 1, 0, 0)
    size = 4 + len(head) + 8 + len(body)
    return b"RIFF" + struct.pack("<I", min(size, 0xFFFFFFFF)) + b"WAVE" + head + b"data" + struct.pack("<I", min(len(body), 0xFFFFFFFF)) + body


def twice(frames: np.ndarray, loop: tuple[int, int] | None, rate: int, fade_seconds: int = 10) -> np.ndarray:
    """Frames up to the loop's end, the loop again, and a linear fade over more of it."""
    if not loop:
        return frames
    body = frames[loop[0] : loop[1]]
    n = fade_seconds * rate
    tail = np.tile(body, (-(-n // max(len(body), 1)), 1))[:n]
    gain = 1 - np.arange(len(tail)) / max(n, 1)
    return np.concatenate([frames[: loop[1]], body, (tail * gain[:, None]).astype(np.int16)])


def rendered(source: ranges.Source, track: dict, loops_twice: bool) -> tuple[str, bytes | None]:
    """(status, WAVE file) of a track's row; an error is its status, and gives no file."""
    try:
        frames = decode(source.read(track["data_at"], track["data_size"]), track["channels"], track["bits"])
        loop = (track["loop_start"], track["loop_end"]) if track["loop_start"] is not None else None
        out = twice(frames, loop, track["rate"]) if loops_twice else frames
        return "written", encode(out, track["rate"], None if loops_twice else loop)
    except (OSError, ValueError, TypeError, ArithmeticError, struct.error) as e:
        return f"failed: {e}", None


def export(entries: DataFrame, tracks: DataFrame, loops_twice: bool = False) -> DataFrame:
    """(entry, offset, status, wav): one WAVE file for each track; an error leaves wav null.

    Entries have ``loc`` (or ``content``, which is stored first): only the places of tracks are joined and dealt
    out, and the task that makes a file reads its samples.
    """
    places = ranges.located(entries).select("entry", "size", "loc")
    rows = tracks.join(places, "entry").select("entry", "offset", "size", "loc", "data_at", "data_size", "channels", "bits", "rate", "loop_start", "loop_end")
    n_bytes = tracks.agg(F.sum("data_size")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ranges.Files()
        for batch in batches:
            for r, source in ranges.each_source(batch, files):
                status, made = rendered(source, r, loops_twice)
                columns = [pa.array([r[c]], pa.int64()) for c in ("entry", "offset")] + [pa.array([status]), pa.array([made], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["entry", "offset", "status", "wav"])

    return ranges.spread(rows, n_bytes, "entry", "offset").mapInArrow(run, "entry long, offset long, status string, wav binary")


def write(entries: DataFrame, tracks: DataFrame, folder: str, loops_twice: bool = False) -> DataFrame:
    """Write ``tracks`` (TRACK, ``track_id``, ``out`` and ``source``) as WAVE files below ``folder`` and their manifest as ``folder``/tracks.csv.

    Gives (track_id, out, status) of each.  Executors write the files, each first under another name, as
    pyarrow names file systems.  The manifest is a folder of text files whose lines, in file order, are
    the header and the tracks by number.
    """
    done = cut(export(entries, tracks, loops_twice).join(tracks.select("entry", "offset", "track_id", "out"), ["entry", "offset"]).mapInArrow(
        _save(folder), "track_id long, out string, status string"
    ), "written")
    seconds = F.format_string("%.3f", duration(F.col("samples"), F.col("rate")))
    fields = {
        "file": F.col("out"), "source": F.col("source"), "offset": F.format_string("0x%X", F.col("offset")), "format": F.col("format"),
        "channels": F.col("channels"), "sample_rate": F.col("rate"), "seconds": seconds, "loop_start": F.col("loop_start"),
        "loop_end": F.col("loop_end"), "note": F.lit(""),
    }
    lines = manifest(tracks, fields, "track_id")
    head = tracks.sparkSession.createDataFrame([(-1, ",".join(fields))], "track_id long, line string")
    lines.unionByName(head).repartitionByRange("track_id").sortWithinPartitions("track_id").select("line").write.text(f"{folder}/tracks.csv")
    return done


def _save(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for out, data in zip(batch.column("out"), batch.column("wav"), strict=True):
                if data.is_valid:
                    path = f"{root}/{out.as_py()}"
                    store.create_dir(path.rsplit("/", 1)[0])
                    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
                        f.write(data.as_py())
                    store.move(part, path)
            yield batch.select(["track_id", "out", "status"])

    return run
