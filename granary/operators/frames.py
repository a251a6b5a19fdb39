"""Runs of frames that pass a test, over bytes of any length, with no task that sees more than a chunk.

A chunk is summed up by its runs: those inside it that are long enough, and those that touch one of its borders, however
short.  Runs that touch at a border are one run, so only summaries are brought together, and the sum of two
chunks is again a list of runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.intervals import merge_touching
from granary.sources import ranges

#: A test takes frames as rows of bytes and says of each whether it passes.
Test = Callable[[np.ndarray], np.ndarray]


def runs_of(passed: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of a chunk that touch its borders or are of ``least`` frames or more."""
    edge = np.flatnonzero(np.diff(np.r_[False, passed, False]))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if a == 0 or b == len(passed) or b - a >= least:
            yield a, b


def _merged(summaries: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Runs from the summaries of chunks (keys, first, end)."""
    rows = summaries.select(F.struct(*keys).alias("_g"), "first", "end")
    whole = merge_touching(rows, "_g", "first", "end").withColumn("n", F.col("end") - F.col("first"))
    return whole.filter(F.col("n") >= least).select("_g.*", "first", "n")


def frame_runs(entries: DataFrame, spans: DataFrame, frame: int, test: Test, least: int, chunk: int = ranges.CHUNK) -> DataFrame:
    """(entry, start, first, n): maximal runs of at least ``least`` frames that pass, in spans (entry, start, end) of entries (entry, size, loc).

    Frames of ``frame`` bytes are counted from the start of a span; what is left at its end is no frame.  Runs end where their span ends.
    A span may be of any length: it is cut into chunks of whole frames, which any tasks read.
    """
    step = max(chunk // frame, 1) * frame
    cut_at = F.sequence(F.col("start"), F.col("end") - frame, F.lit(step).cast("long"))
    whole = spans.select("entry", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter(F.col("end") - F.col("start") >= frame)
    total = whole.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    rows = whole.withColumn("at", F.explode(cut_at)).join(entries.select("entry", "size", "loc"), "entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ranges.Files()
        for batch in batches:
            out = []
            for r, source in ranges.each_source(batch, files):
                n = min(step, r["end"] - r["at"]) // frame
                got = np.frombuffer(source.read(r["at"], n * frame), np.uint8).reshape(n, frame)
                base = (r["at"] - r["start"]) // frame
                out += [(r["entry"], r["start"], base + a, base + b) for a, b in runs_of(np.asarray(test(got), dtype=bool), least)]
            columns = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["entry", "start", "first", "end"])

    found = ranges.spread(rows, total, "entry", "at").mapInArrow(run, "entry long, start long, first long, end long")
    return _merged(found, ["entry", "start"], least)


def value_runs(df: DataFrame, key: str, column: str, frame: int, test: Test, least: int, chunk: int = 1 << 16) -> DataFrame:
    """(key, first, n): runs of frames in the bytes of a text or binary column, cut into chunks as ``frame_runs`` does; nulls have none.

    ``key`` tells rows apart.
    """
    step = max(chunk // frame, 1) * frame
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first, end = [], [], []
            for i, value in enumerate(batch.column("v").cast(pa.binary())):
                data = np.frombuffer(value.as_buffer(), np.uint8) if len(value.as_py()) else np.zeros(0, np.uint8)
                for at in range(0, len(data) - frame + 1, step):
                    n = min(step, len(data) - at) // frame
                    for a, b in runs_of(np.asarray(test(data[at : at + n * frame].reshape(n, frame)), dtype=bool), least):
                        row.append(i)
                        first.append(at // frame + a)
                        end.append(at // frame + b)
            columns = [batch.column("k").take(pa.array(row, pa.int64())), pa.array(first, pa.int64()), pa.array(end, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "first", "end"])

    rows = df.select(F.col(key).alias("k"), F.col(column).alias("v")).filter("v is not null")
    return _merged(rows.mapInArrow(run, f"`{key}` {kind}, first long, end long"), [key], least)
