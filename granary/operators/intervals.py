"""Greedy claims, gaps and runs over ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, entry: str, start: str, end: str) -> DataFrame:
    """``df`` with ``island``: the start of the group of touching intervals that a row is in."""
    before = Window.partitionBy(entry).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(entry).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col(start) >= F.max(end).over(before), F.lit(True))
    return df.withColumn("_open", F.when(opens, F.col(start))).withColumn("island", F.max("_open").over(upto)).drop("_open")


def claim_greedy(df: DataFrame, entry: str, start: str, end: str) -> DataFrame:
    """(entry, start, end) of the intervals that win when each, by rising start, is taken unless it
    begins before the end of the last one taken.

    Not a running maximum: a losing interval claims nothing.  An interval that begins after
    all before it have ended starts anew, so islands are dealt out and each is read as a sorted
    stream, of which only the last end is held.  Null bounds lose; of equal starts the least end wins.
    """
    rows = islands(df.select(entry, start, end).dropna(), entry, start, end)
    schema = rows.drop("island").schema
    rows = rows.repartition(entry, "island").sortWithinPartitions(entry, "island", start, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, upto = None, None
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)
            won = []
            for i, (key, s, e) in enumerate(zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if key != island or s >= upto:
                    island, upto = key, e
                    won.append(i)
            yield batch.select([0, 1, 2]).take(pa.array(won, pa.int64()))

    return rows.mapInArrow(run, schema)


def gaps(df: DataFrame, entry: str, start: str, end: str) -> DataFrame:
    """(entry, gap_start, gap_end): what lies between intervals and is covered by none."""
    before = Window.partitionBy(entry).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(entry, F.max(end).over(before).alias("gap_start"), F.col(start).alias("gap_end"))
    return rows.filter("gap_start < gap_end")


def free(entries: DataFrame, claimed: DataFrame, entry: str, size: str, start: str, end: str, align: int = 1) -> DataFrame:
    """(entry, gap_start, gap_end): all of an entry's bytes, up to a multiple of ``align``, that no interval covers, those
    before the first and after the last, too.  ``claimed``: (entry, start, end); an entry without any is one gap."""
    whole = entries.select(entry, (F.floor(F.col(size) / align) * align).cast("long").alias("_size"))
    at = F.max(end).over(Window.partitionBy(entry).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    inner = claimed.select(entry, F.coalesce(at, F.lit(0)).cast("long").alias("gap_start"), F.col(start).cast("long").alias("gap_end"))
    last = claimed.groupBy(entry).agg(F.max(end).cast("long").alias("_to"))
    outer = whole.join(last, entry, "left").select(entry, F.coalesce("_to", F.lit(0)).cast("long").alias("gap_start"), F.col("_size").alias("gap_end"))
    return inner.unionByName(outer).filter("gap_start < gap_end")


def runs(df: DataFrame, entry: str, order: list[str], holds: Column, least: int) -> DataFrame:
    """(entry, run, n): maximal runs of at least ``least`` rows for which ``holds``; ``run`` numbers them."""
    w = Window.partitionBy(entry).orderBy(*order)
    rows = df.withColumn("_ok", F.coalesce(holds, F.lit(False))).withColumn("_all", F.row_number().over(w))
    good = rows.filter("_ok").withColumn("_run", F.col("_all") - F.row_number().over(w))
    found = good.groupBy(entry, "_run").agg(F.count("*").alias("n"), F.min("_all").alias("first_row"))
    return found.filter(F.col("n") >= least).select(entry, "first_row", "n")


def merge_touching(df: DataFrame, entry: str, start: str, end: str) -> DataFrame:
    """(entry, start, end, pieces): touching or overlapping intervals made one."""
    rows = df.select(entry, start, end)
    before = Window.partitionBy(entry).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(entry).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_new", F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True)).cast("int"))
    rows = rows.withColumn("_group", F.sum("_new").over(upto))
    out = rows.groupBy(entry, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("pieces"))
    return out.drop("_group")
