"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, small

_ROW = 24


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: hang neighbours on the least vertex of each neighbourhood.

    ``edges``: (u, v), u > v.  Large: neighbours above u move to its least neighbour.
    Small: u and its neighbours below move to the least of them.
    """
    pairs = edges
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    side = small(least, least.count() * _ROW)
    joined = pairs.join(side, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    out = cut(moved.filter("u <> v").distinct(), "edges")
    drop(least)
    return out


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least reachable id for every id that some pair of different ids holds.

    Nulls and loops are ignored, repeated pairs count once; no pairs give no rows.  Every
    round is written to the shared folder, so nothing depends on an executor staying alive,
    and nothing is gathered on the driver but two numbers per round.
    """
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut(edges.filter("u <> v").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())

    now = state(edges)
    while now[0]:
        bigger = _star(edges, large=True)
        smaller = _star(bigger, large=False)
        drop(bigger)
        drop(edges)
        edges, before, now = smaller, now, state(smaller)
        if now == before:
            break
    tops = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        tops.select("id", F.col("id").alias("component"))
    )
