"""Multi-pattern search over text or binary columns, and over the bytes of entries where they lie."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.patterns import Patterns
from granary.sources import ranges

_HIT = "entry long, name string, offset long"


def first_hits(df: DataFrame, key: str, column: str, patterns: Sequence[str]) -> DataFrame:
    """(key, pattern, first_at): first place (from 1) of each pattern that a text holds."""
    dim = F.explode(F.array(*map(F.lit, patterns))).alias("pattern")
    hits = df.select(key, column, dim)
    return hits.select(key, "pattern", F.locate("\0", F.lit("")).alias("first_at")).limit(0) if not patterns else hits.select(
        key, "pattern", F.expr(f"instr(`{column}`, pattern)").alias("first_at")
    ).filter("first_at > 0")


def all_hits(df: DataFrame, key: str, column: str, patterns: Sequence[str | bytes]) -> DataFrame:
    """(key, pattern, offset): every hit, overlapping ones too, by byte offset from 0.

    The values of a batch are searched as one buffer, and hits over the border of two values are left out;
    texts stay in their partitions.  Null values have no hits; an empty pattern is an error.
    """
    raw = [p if isinstance(p, bytes) else p.encode() for p in patterns]
    names = dict(zip(raw, [p if isinstance(p, str) else p.hex() for p in patterns], strict=True))
    machine = Patterns(names)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = pa.array([names[p] for p in machine.patterns], pa.string())
        for batch in batches:
            values = batch.column("v").cast(pa.large_binary())
            _, places, data = values.buffers()
            begin = np.frombuffer(places, np.int64)[values.offset : values.offset + len(values) + 1]
            text = np.frombuffer(data, np.uint8)[begin[0] : begin[-1]] if data is not None and len(values) else np.zeros(0, np.uint8)
            begin = begin - begin[0]
            at, which = machine.find(text)
            row = np.searchsorted(begin, at, side="right") - 1
            whole = at + machine.sizes[which] <= begin[row + 1]
            at, which, row = at[whole], which[whole], row[whole]
            columns = [batch.column("k").take(pa.array(row)), said.take(pa.array(which)), pa.array(at - begin[row], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "pattern", "offset"])

    rows = df.select(F.col(key).alias("k"), F.col(column).alias("v")).filter("v is not null")
    return rows.mapInArrow(run, f"`{key}` {kind}, pattern string, offset long")


class _Named:
    """Signatures by the names that they stand for; one may stand for several."""

    def __init__(self, patterns: dict[str, list[bytes]]):
        self.names: dict[bytes, list[str]] = {}
        for name, ps in patterns.items():
            for p in ps:
                self.names.setdefault(p, []).append(name)
        self.machine = Patterns(self.names)

    def rows(self, entry: int, start: int, data: bytes, chunk: int, last: bool) -> Iterator[tuple[int, str, int]]:
        """Hits of a chunk; those that begin past it belong to the next one."""
        for at, k in zip(*(x.tolist() for x in self.machine.find(data)), strict=True):
            if at < chunk or last:
                for name in self.names[self.machine.patterns[k]]:
                    yield entry, name, start + at


def _batch(rows: list[tuple[int, str, int]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    kinds = (pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["entry", "name", "offset"])


def chunk_hits(chunks: DataFrame, patterns: dict[str, list[bytes]], chunk: int) -> DataFrame:
    """Hits of named signatures in ``chunks`` (entry, start, data, last).

    Each chunk carries the bytes of the next one that a signature over the border needs; a hit
    that begins past ``chunk`` belongs to that next one.  Output: (entry, name, offset).
    """
    named = _Named(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry, start, data, last in zip(*(batch.column(c) for c in ("entry", "start", "data", "last")), strict=True):
                yield _batch(list(named.rows(entry.as_py(), start.as_py(), data.as_py() or b"", chunk, last.as_py())))

    return chunks.select("entry", "start", "data", "last").mapInArrow(run, _HIT).distinct()


def range_hits(entries: DataFrame, patterns: dict[str, list[bytes]], chunk: int = ranges.CHUNK) -> DataFrame:
    """(entry, name, offset) of named signatures in entries (entry, size, loc), read and searched range by range in the same task."""
    named = _Named(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ranges.Files()
        for batch in batches:
            for r, source in ranges.each_source(batch, files):
                n = min(chunk + named.machine.longest - 1, r["size"] - r["start"])
                yield _batch(list(named.rows(r["entry"], r["start"], source.read(r["start"], n), chunk, r["last"])))

    return ranges.ranges(entries.select("entry", "size", "loc"), chunk).mapInArrow(run, _HIT)
