"""Lookups with first-match semantics, pairing, and comparison of two catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.scratch import cut, drop


#: Rows that a list of formats or keys may have to be sent to every task.
SHORT_ROWS = 100_000

#: How the names of a left and a right channel end, and whether the end includes the extension (fixed values, in order of trial).
DUAL_ENDS = [("L", "R", False), ("l", "r", False), ("left", "right", False), ("Left", "Right", False), (".V0", ".V1", True), (".L", ".R", True)]


def short(df: DataFrame) -> DataFrame:
    """Hint a broadcast for a list whose rows were counted and are few; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(SHORT_ROWS + 1).count() <= SHORT_ROWS else df


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str], take: list[str]) -> DataFrame:
    """``left`` with ``take`` from the first row of ``right``, by ``order``, that agrees on ``on``."""
    best = right.groupBy(*on).agg(F.min(F.struct(*order, *[c for c in take if c not in order])).alias("_m"))
    return left.join(best, on, "left").select(*left.columns, *[F.col(f"_m.{c}").alias(f"first_{c}") for c in take])


def with_companion(left: DataFrame, right: DataFrame, on: list[str], present: bool = True) -> DataFrame:
    """Rows of ``left`` that have (or lack) a companion."""
    return left.join(right.select(*on), on, "left_semi" if present else "left_anti")


def pair_rows(df: DataFrame, group: list[str], order: list[str], key: str, equal: Column | None = None) -> DataFrame:
    """(left, right): neighbours 1-2, 3-4, ... of each group by ``order``; the partner next in order
    decides, and if ``equal`` (on columns l, r) doesn't hold there is no pair."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    rows = df.withColumn("_n", n)
    both = Window.partitionBy(*group, F.floor((F.col("_n") - 1) / 2))
    row = F.struct(*df.columns)
    halves = rows.select(F.min(F.when(F.col("_n") % 2 == 1, row)).over(both).alias("l"), F.when(F.col("_n") % 2 == 0, row).alias("r"))
    halves = halves.filter("r is not null")
    if equal is not None:
        halves = halves.filter(equal)
    return halves.select(F.col(f"l.{key}").alias("left_key"), F.col(f"r.{key}").alias("right_key"))


def extension_candidates(df: DataFrame, path: str, formats: DataFrame) -> DataFrame:
    """``df`` with every format that takes the path's extension, best rank first.

    ``formats``: (ext, format, rank), a fixed list.
    """
    from granary.functions.text import extension

    return df.withColumn("ext", F.lower(extension(F.col(path)))).join(short(formats), "ext")


def digest_match(ours: DataFrame, theirs: DataFrame, digest: list[str], key: str) -> DataFrame:
    """(outcome, n): rows of equal digests matched one to one; what is left over is MISSED or EXTRA."""
    n = F.row_number().over(Window.partitionBy(*digest).orderBy(key))
    a = ours.select(*digest, n.alias("_n"), F.lit(1).alias("_a"))
    b = theirs.select(*digest, n.alias("_n"), F.lit(1).alias("_b"))
    both = a.join(b, [*digest, "_n"], "full_outer")
    outcome = F.when(F.col("_b").isNull(), "EXTRA").when(F.col("_a").isNull(), "MISSED").otherwise("OK")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def key_search(scales: DataFrame, group: str, value: str, keys: DataFrame) -> DataFrame:
    """(group, key): the first listed key that fits all values of a group.

    ``keys``: (rank, key, lo, hi), a short list.  Values are reduced to their range first, so the list
    meets one row of each group.
    """
    ranges = scales.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    fits = ranges.join(short(keys), (F.col("_lo") >= F.col("lo")) & (F.col("_hi") <= F.col("hi")))
    return fits.groupBy(group).agg(F.min_by("key", "rank").alias("key"))


def dual_partners(path: Column) -> Column:
    """Paths that would pair with ``path``, in order of trial: array of (lower-case partner, whether ``path`` is the left)."""
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    dot = F.length(name) - F.length(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    found = []
    for left, right, whole in DUAL_ENDS:
        for end, other, is_left in ((left, right, True), (right, left, False)):
            size = F.length(name) if whole else dot
            head, tail = F.left(name, size), F.substring(name, size + 1, F.length(name))
            partner = F.concat(folder, F.left(head, size - len(end)), F.lit(other), tail)
            found.append(F.when((size > len(end)) & head.endswith(end), F.struct(F.lower(partner).alias("partner"), F.lit(is_left).alias("is_left"))))
    return F.array_compact(F.array(*found))


def pair_by_name(tracks: DataFrame, entries: DataFrame, equal: list[str]) -> DataFrame:
    """(left_key, right_key) of tracks that are the two channels of one sound.

    ``tracks``: ``track``, ``entry`` and the columns ``equal``, one for each entry that can pair; ``entries``: ``entry`` and
    ``path``.  The first partner path (``dual_partners``) that any entry has, whatever the case, decides: if that
    entry isn't among the tracks or differs in a column of ``equal``, there is no pair.  Tracks are
    served by rising number, and each is in one pair at most; that is settled in rounds in which the pairs that come
    first at both of their ends are taken.
    """
    named = entries.groupBy(F.lower("path").alias("partner")).agg(F.min("entry").alias("other"))
    mine = tracks.join(entries.select("entry", "path"), "entry")
    tries = mine.select("track", *equal, F.posexplode(dual_partners(F.col("path"))).alias("place", "x")).select("track", *equal, "place", "x.*")
    first = tries.join(named, "partner").groupBy("track", *equal).agg(F.min_by(F.struct("other", "is_left"), "place").alias("x"))
    theirs = tracks.select(F.col("track").alias("to"), F.col("entry").alias("other"), *[F.col(c).alias(f"_{c}") for c in equal])
    edges = first.select("track", *equal, "x.*").join(theirs, "other").filter("track <> to")
    for c in equal:
        edges = edges.filter(F.col(c).eqNullSafe(F.col(f"_{c}")))
    edges = cut(edges.select("track", "to", "is_left"), "edges")
    taken = None
    while not edges.isEmpty():
        ends = edges.select("track", F.explode(F.array("track", "to")).alias("end")).groupBy("end").agg(F.min("track").alias("first"))
        at = lambda c: ends.select(F.col("end").alias(c), F.col("first").alias(f"first_{c}"))
        won = cut(edges.join(at("track"), "track").join(at("to"), "to").filter("first_track = track and first_to = track").select("track", "to", "is_left"), "pairs")
        gone = won.select(F.explode(F.array("track", "to")).alias("end"))
        left = edges.join(gone.select(F.col("end").alias("track")), "track", "left_anti").join(gone.select(F.col("end").alias("to")), "to", "left_anti")
        left = cut(left.select("track", "to", "is_left"), "edges")
        drop(edges)
        edges, taken = left, won if taken is None else taken.unionByName(won)
    pairs = edges if taken is None else taken
    return pairs.select(F.when(F.col("is_left"), F.col("track")).otherwise(F.col("to")).alias("left_key"), F.when(F.col("is_left"), F.col("to")).otherwise(F.col("track")).alias("right_key"))


def merged_pairs(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """``tracks`` with pairs (left_key, right_key) made one row each: the left one's, with ``right_track`` and two ``channels``.

    Rows of right channels go; rows in no pair have a null ``right_track`` and one channel.
    """
    rows = tracks.join(pairs.select(F.col("right_key").alias("track")), "track", "left_anti")
    rows = rows.join(pairs.select(F.col("left_key").alias("track"), F.col("right_key").alias("right_track")), "track", "left")
    return rows.withColumn("channels", F.when(F.col("right_track").isNull(), 1).otherwise(2))


def named_by_hash(rows: DataFrame, hash_column: str, names: DataFrame, name: str, known: str | None = None) -> DataFrame:
    """``rows`` with ``name`` from a list of names, found by the hash of the trimmed lower-case name; null if none has it.

    Of names with one hash the one that equals the row's column ``known``, whatever the case, is taken, else the last in order;
    empty names are left out.
    """
    from granary.functions.numbers import name_hash

    listed = names.select(F.trim(name).alias("_name")).filter("length(_name) > 0").select(name_hash("_name").alias(hash_column), "_name")
    last = listed.groupBy(hash_column).agg(F.max("_name").alias("name"))
    found = rows.join(last, hash_column, "left")
    if known is None:
        return found
    # hashes of several names are few, and only their names need a look
    several = listed.groupBy(hash_column).agg(F.min(F.lower("_name")).alias("_low"), F.max(F.lower("_name")).alias("_high")).filter("_low <> _high")
    own = listed.join(several.select(hash_column), hash_column, "left_semi").groupBy(hash_column, F.lower("_name").alias("_known")).agg(F.max("_name").alias("_own"))
    found = found.withColumn("_known", F.lower(F.trim(known))).join(own, [hash_column, "_known"], "left")
    return found.select(*rows.columns, F.coalesce("_own", "name").alias("name"))


def follow(links: DataFrame, key: str, to: str, most: int) -> DataFrame:
    """(key, last, steps): where a chain of links from each key ends after at most ``most`` steps; a chain that
    is longer, or that meets itself, has a null end.  A key that nothing follows ends at its own link."""
    step = links.select(F.col(key).alias("_at"), F.col(to).alias("_to"))
    now = links.select(key, F.col(to).alias("last"), F.lit(1).alias("steps"), F.lit(True).alias("_on"))
    for _ in range(most):
        more = now.join(step, F.col("last") == F.col("_at"), "left")
        on = F.col("_on") & F.col("_at").isNotNull()
        now = more.select(key, F.when(on, F.col("_to")).otherwise(F.col("last")).alias("last"), (F.col("steps") + on.cast("int")).alias("steps"), on.alias("_on"))
    return now.select(key, F.when(F.col("steps") <= most, F.col("last")).alias("last"), F.when(F.col("steps") <= most, F.col("steps")).alias("steps"))
