"""Joins of spans that overlap, by bins of several widths.

A span belongs to the level whose bins are just as wide as it is long or wider, so it lies in two bins at most, however long it is.
Two spans meet on the wider of their levels: each is dealt into the bins of its own level and of wider levels that
the other side has.  A pair is taken in one bin only, that in which the overlap begins.  So the join is an equi-join on
(entry, level, bin), which shuffles, spreads a hot entry over its bins, and lets skewed bins be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.scratch import cut, small

#: Bits of the width of the least bins, and of the step from one level to the next.
LEAST, STEP, LEVELS = 6, 4, 14


def _level(start: Column, end: Column) -> Column:
    """Least level whose bins are at least as wide as the span."""
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(end - start <= 1 << (LEAST + STEP * k), k).otherwise(out)
    return out


def _packed(df: DataFrame, entry: str, start: str, end: str) -> list[str]:
    """Columns of a side that travel in its struct; entry and whole bounds are join columns anyway, and are put back behind the join."""
    whole = {c for c in (start, end) if df.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")}
    return [c for c in df.columns if c != entry and c not in whole]


def _dealt(df: DataFrame, entry: str, start: str, end: str, side: str, levels: list[int]) -> DataFrame:
    """Rows of a side for each bin: entry, level, bin, the bounds, and the row's other columns as a struct."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    packed = _packed(df, entry, start, end)
    rows = df.filter(F.col(entry).isNotNull() & (s < e)).select(
        F.struct(*packed).alias(side) if packed else F.lit(True).alias(side), F.col(entry).alias("_entry"), s.alias(f"{side}_s"), e.alias(f"{side}_e")
    )
    own = _level(F.col(f"{side}_s"), F.col(f"{side}_e"))
    bins = []
    for k in levels:
        width = LEAST + STEP * k
        at = F.sequence(F.shiftright(f"{side}_s", width), F.shiftright(F.col(f"{side}_e") - 1, width))
        bins.append(F.when(own <= k, F.transform(at, _tagged(k))).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>")))
    return rows.withColumn("_x", F.explode(F.flatten(F.array(*bins)))).select("*", F.col("_x.level").alias("_level"), F.col("_x.bin").alias("_bin")).drop("_x")


def _restored(df: DataFrame, entry: str, start: str, end: str, side: str) -> Column:
    """The row of a side behind the join, as a struct of all its columns."""
    packed = _packed(df, entry, start, end)
    joined = {entry: F.col("_entry"), start: F.col(f"{side}_s"), end: F.col(f"{side}_e")}
    return F.struct(*[(F.col(side)[c] if c in packed else joined[c].cast(df.schema[c].dataType)).alias(c) for c in df.columns])


def _tagged(k: int):
    return lambda b: F.struct(F.lit(k).alias("level"), b.alias("bin"))


def _levels(df: DataFrame, start: str, end: str) -> set[int]:
    """Levels that a side's spans are of, at most LEVELS numbers."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    return {r[0] for r in df.filter(s < e).select(_level(s, e)).distinct().collect()}


def _pairs(left: DataFrame, right: DataFrame, entry: str, spans: tuple[str, str, str, str]) -> DataFrame:
    ls, le, rs, re_ = spans
    levels = sorted(_levels(left, ls, le) | _levels(right, rs, re_)) or [0]
    a, b = _dealt(left, entry, ls, le, "l", levels), _dealt(right, entry, rs, re_, "r", levels)
    both = a.join(b, ["_entry", "_level", "_bin"])
    bits = F.col("_level") * STEP + LEAST
    begins = F.call_function("shiftright", F.greatest("l_s", "r_s"), bits)
    wider = F.greatest(_level(F.col("l_s"), F.col("l_e")), _level(F.col("r_s"), F.col("r_e")))
    return both.filter(
        (F.col("_level") == wider) & (F.col("_bin") == begins) & (F.col("l_s") < F.col("r_e")) & (F.col("r_s") < F.col("l_e"))
    )


def overlapping(left: DataFrame, right: DataFrame, entry: str, spans: tuple[str, str, str, str]) -> DataFrame:
    """All pairs of a row of ``left`` and one of ``right`` with one ``entry`` whose spans overlap: (left, right), the rows as structs.

    ``spans``: start and end (behind the last) of the left rows, then of the right ones.  Spans that are empty or have a null bound or entry overlap nothing;
    rows that repeat give pairs that repeat.
    """
    both = _pairs(left, right, entry, spans)
    return both.select(_restored(left, entry, *spans[:2], "l").alias("left"), _restored(right, entry, *spans[2:], "r").alias("right"))


def outside(points: DataFrame, spans: DataFrame, entry: str, at: str, start: str, end: str) -> DataFrame:
    """Rows of ``points`` whose place ``at`` lies in none of the spans; null places lie in none.

    Spans are written once.  A point has one bin on each level that they have, so it leaves by one anti-join a level, and no
    row of ``points`` is repeated or joined back.
    """
    rows = spans.select(F.col(entry).alias("_entry"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    rows = cut(rows.filter(F.col("_entry").isNotNull() & (F.col("_s") < F.col("_e"))).withColumn("_level", _level(F.col("_s"), F.col("_e"))), "spans")
    out = points
    for r in rows.groupBy("_level").count().orderBy("_level").collect():  # at most LEVELS rows
        width = LEAST + STEP * r["_level"]
        bins = F.sequence(F.shiftright("_s", width), F.shiftright(F.col("_e") - 1, width))
        dealt = rows.filter(F.col("_level") == r["_level"]).select("_entry", "_s", "_e", F.explode(bins).alias("_bin"))
        place = F.col(at).cast("long")
        covers = (F.col(entry) == F.col("_entry")) & (F.shiftright(place, width) == F.col("_bin")) & (F.col("_s") <= place) & (place < F.col("_e"))
        out = out.join(small(dealt, 2 * r["count"] * 40), covers, "left_anti")
    return out
