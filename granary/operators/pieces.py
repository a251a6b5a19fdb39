"""Streams that lie in pieces: logical places, logical ranges cut into physical pieces, and their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.overlap import overlapping
from granary.scratch import cut
from granary.sources import ranges


def laid_out(pieces: DataFrame, stream: str, order: str, size: str) -> DataFrame:
    """``pieces`` with ``at``: where each begins in its stream, the sum of the sizes before it."""
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("at", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def slices(pieces: DataFrame, wanted: DataFrame, stream: str, order: str, off: str, size: str, start: str, end: str) -> DataFrame:
    """The physical pieces of logical ranges: all columns of ``wanted`` (``stream``, ``start``, ``end`` and any others),
    ``k``, the piece's place in its stream (null behind the last one), ``to``, where it belongs in the range, ``off`` and ``size``.

    A piece with a null ``off`` is one of zeros, and so is what lies behind the last piece, or in a stream without pieces.  Pieces without bytes and
    empty ranges give no rows.  Ranges and pieces meet in an overlap join, so one long stream is spread over its places.  Pieces are laid out and
    written once; what lies behind the last one is told by the stream's end alone.
    """
    rows = laid_out(pieces, stream, order, size).select(
        stream, F.col(order).alias("_k"), F.col("at").alias("_at"), (F.col("at") + F.col(size)).alias("_end"), F.col(off).cast("long").alias("_off")
    )
    rows = cut(rows, "pieces")
    found = overlapping(wanted, rows, stream, (start, end, "_at", "_end"))
    low = F.greatest(F.col(f"left.{start}"), F.col("right._at"))
    high = F.least(F.col(f"left.{end}"), F.col("right._end"))
    inside = found.select(
        *[F.col("left")[c].alias(c) for c in wanted.columns], F.col("right._k").alias("k"), (low - F.col(f"left.{start}")).alias("to"),
        (F.col("right._off") + low - F.col("right._at")).alias("off"), (high - low).alias("size"),
    )
    ends = rows.groupBy(stream).agg(F.max("_end").alias("_last"))
    begins = F.greatest(F.col(start), F.coalesce("_last", F.lit(0)))
    behind = wanted.filter(F.col(stream).isNotNull() & (F.col(start) < F.col(end))).join(ends, stream, "left").filter(begins < F.col(end))
    behind = behind.select(
        *wanted.columns, F.lit(None).cast(pieces.schema[order].dataType).alias("k"), (begins - F.col(start)).alias("to"),
        F.lit(None).cast("long").alias("off"), (F.col(end) - begins).alias("size"),
    )
    return inside.unionByName(behind)


def gathered(found: DataFrame, key: list[str], entries: DataFrame, entry: str) -> DataFrame:
    """(key, bytes): the bytes of ranges from their ``slices``, read piece by piece where the entries (entry, size, loc) lie.

    A range is one row of places, and its bytes are put together by the task that reads them; ranges are
    as long as the caller cuts them.
    """
    listed = F.array_sort(F.collect_list(F.struct("to", "off", F.col("size").alias("n")))).alias("pieces")
    rows = found.groupBy(*key, entry).agg(listed).join(entries.select(F.col("entry").alias(entry), "size", "loc"), entry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ranges.Files()
        for batch in batches:
            for i, (r, source) in enumerate(ranges.each_source(batch, files)):
                parts = [bytes(p["n"]) if p["off"] is None else source.read(p["off"], p["n"]) for p in r["pieces"]]
                row = batch.slice(i, 1).select(key)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([b"".join(parts)], pa.binary())], names=[*key, "bytes"])

    return rows.mapInArrow(run, rows.select(*key, F.lit(b"").alias("bytes")).schema)
