"""Offsets and sizes that follow from other rows of a bank."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.scratch import cut


def next_different(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``df`` with ``next``: the first later value that differs from the row's own.

    The next row's value is what follows each block of equal values, so it is carried back
    over the block; rows stream through two windows.
    """
    w = Window.partitionBy(group).orderBy(order)
    edge = F.when(F.lead(value).over(w) != F.col(value), F.lead(value).over(w))
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("_edge", edge).withColumn("next", F.first("_edge", ignorenulls=True).over(ahead)).drop("_edge")


def cumulative(df: DataFrame, group: str, order: str, size: str, start: int = 0) -> DataFrame:
    """``df`` with ``off``: the sum of the sizes before it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("off", F.coalesce(F.sum(size).over(w), F.lit(0)) + start)


def next_greater(df: DataFrame, group: str, offset: str, end: str) -> DataFrame:
    """``df`` with ``next``: the least offset of the group over the row's own, else the group's ``end``.

    Rows of equal offsets share it; a null offset has none and is nobody's next.
    """
    w = Window.partitionBy(group).orderBy(offset).rangeBetween(1, Window.unboundedFollowing)
    return df.withColumn("next", F.when(F.col(offset).isNotNull(), F.coalesce(F.min(offset).over(w), F.col(end))))


def first_larger(df: DataFrame, group: str, order: list[str], value: str, end: str) -> DataFrame:
    """``df`` with ``next``: the value of the first later row of the group, by ``order``, that is larger than the row's own, else the group's ``end``.

    Rows are range-sorted by group and order and written once, so a long group lies in several stretches.  A task streams a stretch with a
    stack of the rows that wait for a larger value.  Only rows that still wait at its end, and those that are larger than all before them in
    it, of which one must be the answer, go on to a stream over each group.  Rows of equal order come in some order; a
    null value has no next and is nobody's.  ``value`` holds longs.
    """
    rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = cut(rows.select(F.struct("*").alias("row"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "stretches")
    keyed = rows.select(F.col("row")[group].alias("g"), "p", "m", F.col("row")[value].cast("long").alias("v")).filter("v is not null")
    kind = df.schema[group].dataType.simpleString()
    waiting = cut(keyed.repartition("g", "p").sortWithinPartitions("g", "p", "m").mapInArrow(_larger(True), f"g {kind}, p int, m long, v long, next long, top boolean"), "waiting")
    rest = waiting.filter("next is null or top").select("g", "p", "m", "v")
    far = rest.repartition("g").sortWithinPartitions("g", "m").mapInArrow(_larger(False), f"g {kind}, p int, m long, v long, next long, top boolean")
    found = waiting.select("m", "next").join(far.select("m", F.col("next").alias("far")), "m", "left")
    out = rows.join(found.select("m", F.coalesce("next", "far").alias("_next")), "m", "left")
    own = [F.col("row")[c].alias(c) for c in df.columns]
    return out.select(*own, F.when(F.col("row")[value].isNotNull(), F.coalesce("_next", F.col("row")[end].cast("long"))).alias("next"))


def _larger(stretches: bool):
    """Rows (g, p, m, v) in order, by stretch or by group, with the first larger value behind each and whether it is larger than all before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, high, stack = None, None, []
        for batch in batches:
            out = []
            for g, p, m, v in zip(*(batch.column(c).to_pylist() for c in ("g", "p", "m", "v")), strict=True):
                if (key := (g, p if stretches else 0)) != group:
                    out += [(*x, None, top) for x, top in stack]
                    group, high, stack = key, None, []
                while stack and stack[-1][0][3] < v:
                    x, top = stack.pop()
                    out.append((*x, v, top))
                stack.append(((g, p, m, v), high is None or v > high))
                high = v if high is None else max(high, v)
            yield _rows(out, batch.schema.field("g").type)
        if stack:
            yield _rows([(*x, None, top) for x, top in stack], batch.schema.field("g").type)

    return run


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * 6
    kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["g", "p", "m", "v", "next", "top"])


def reused(df: DataFrame, group: str, order: str, value: str, again: Column) -> DataFrame:
    """``df`` with ``used``: its own value, or, where ``again`` holds, that of the last row before for which it doesn't (0: none)."""
    own = F.when(~F.coalesce(again, F.lit(False)), F.col(value))
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit(0)))


def common_divisor(df: DataFrame, group: str, size: str, unit: int = 16) -> DataFrame:
    """(group, step): the greatest common divisor of the group's sizes, each cut to a multiple of ``unit``; at least ``unit``.

    Divisors are folded over the distinct sizes, few for each group.
    """
    n = F.floor(F.col(size) / unit).cast("long")
    sizes = df.select(group, n.alias("_n")).groupBy(group).agg(F.collect_set("_n").alias("_n"))

    def gcd(a: Column, b: Column) -> Column:  # 64 steps suffice for any pair of longs of this size
        step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(96)), F.struct(a.alias("a"), b.alias("b")), step, lambda s: s["a"])

    step = F.aggregate("_n", F.lit(0).cast("long"), gcd) * unit
    return sizes.select(group, F.greatest(step, F.lit(unit).cast("long")).alias("step"))


def verdicts(df: DataFrame, group: str, holds: Column, known: Column) -> DataFrame:
    """(group, every, some, said): whether ``holds`` is true of every and of some row of the group, and the tri-state
    of those that are ``known``: true or false if all agree, else null."""
    yes, sure = F.coalesce(holds, F.lit(False)), F.coalesce(known, F.lit(False))
    of_sure = F.when(sure, yes)
    said = F.when(F.bool_and(of_sure) == F.bool_or(of_sure), F.bool_and(of_sure))
    return df.groupBy(group).agg(F.bool_and(yes).alias("every"), F.bool_or(yes).alias("some"), said.alias("said"))
