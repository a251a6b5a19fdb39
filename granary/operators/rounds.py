"""Entries inside entries, in rounds: what may be opened, and the table of entries that grows by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.intervals import claim_greedy
from granary.operators.naming import dense_ids
from granary.operators.overlap import outside
from granary.scratch import cut, small

#: Bits of the numbers that one block of parents holds; blocks are added up in one row each.
BLOCK = 14


def accepted(members: DataFrame, claims: DataFrame | None, entry: str, start: str, end: str, most: int | None = None) -> DataFrame:
    """Rows of ``members`` (one a place) that begin in none of the claims, and in no accepted member before them; of an entry the first ``most`` by place.

    ``claims`` has the same three columns.  A member may end inside a claim: only where it begins counts.
    """
    free = members if claims is None else cut(outside(members, claims, entry, start, start, end), "free")
    won = claim_greedy(free.select(entry, start, end), entry, start, end)
    rows = free.join(won, [entry, start, end], "left_semi").select(*members.columns)
    if most is None:
        return rows
    place = F.row_number().over(Window.partitionBy(entry).orderBy(start))
    return rows.withColumn("_k", place).filter(F.col("_k") <= most).drop("_k")


def numbered_after(derived: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """``derived`` with ``entry``: numbers by ``order`` that go on after those of the entries known so far."""
    top = known.agg(F.max("entry")).first()[0]
    return dense_ids(derived, order, "entry").withColumn("entry", F.col("entry") + (0 if top is None else top + 1))


def grow(roots: DataFrame, inside: DataFrame, content: str, at: str, child: str, depth: int) -> DataFrame:
    """(entry, parent, content, at, depth): ``roots`` (entry, content) and, round by round, what is inside them, at most ``depth`` levels down.

    ``inside``: (content, at, child), what of each content was accepted.  Numbers go on by (parent, at).  Only ``inside`` is sorted, once:
    a parent's first number is the sum of what the parents before it hold, and an entry's place in its parent is its place among
    what the content holds.  So a round moves parents, and never the larger table that comes of them; a round without entries ends it.
    """
    level = roots.select("entry", F.lit(None).cast("long").alias("parent"), F.col(content).alias("content"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("depth"))
    out = level
    what = cut(inside.select(F.col(content).alias("content"), F.col(at).cast("long").alias("at"), F.col(child).alias("child")), "inside")
    what = cut(dense_ids(what.filter("content is not null"), ["content", "at"], "_g"), "held")
    holds = what.groupBy("content").agg(F.min("_g").alias("_low"), F.count("*").alias("_n"))
    n_what, top = what.count(), roots.agg(F.max("entry")).first()[0]
    after = 0 if top is None else top + 1
    for k in range(1, depth + 1):
        parents = level.select(F.col("entry").cast("long").alias("parent"), "content").join(small(holds, 64 * n_what), "content")
        parents = cut(parents.withColumn("_block", F.shiftright("parent", BLOCK)), "parents")
        blocks = cut(parents.groupBy("_block").agg(F.sum("_n").alias("_s"), F.count("*").alias("_c")), "blocks")
        total, n_blocks = blocks.agg(F.sum("_s"), F.count("*")).first()
        if not total:
            break
        before = F.coalesce(F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = F.sum("_n").over(Window.partitionBy("_block").orderBy("parent").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
        placed = parents.withColumn("_own", own).join(small(blocks.select("_block", before.alias("_before")), 24 * n_blocks), "_block")
        placed = placed.select("parent", "content", (F.col("_before") + F.col("_own") - F.col("_low") + after).alias("_first"))
        level = placed.join(small(what, 64 * n_what), "content").select(
            (F.col("_first") + F.col("_g")).alias("entry"), "parent", F.col("child").alias("content"), "at", F.lit(k).alias("depth")
        )
        level = cut(level, "level") if k < depth else level
        out, after = out.unionByName(level), after + total
    return out
