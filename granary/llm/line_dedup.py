"""Line deduplication by a suffix array over line sequences (native: DataFrame functions only).

A document is the sequence of its lines that aren't blank, and a line is named by the rank of its
text among all lines that occur twice (found by hash, then told apart by text).  Suffixes are
ranked by prefix doubling: by their first line, then by the first two, four, ... lines, each from pairs
of ranks of the level before.  A level's groups of equal rank are its longest-common-prefix intervals; one row for each
is range-sorted to number them in order, and the numbers are joined back.  A suffix alone in its
interval leaves, and doubling goes on until none is left, so each level works on what is still repeated.

Of each interval the earliest suffix is its source.  A suffix that isn't the source of its deepest
interval is compared with that source: the length of their common prefix follows from the levels
by descent, longest step first, as a place differs in rank where the runs end.  Pairs that could be
carried on to the left are left out, as are runs inside other runs; what remains are the maximal
repeated runs, and the later copies, those of at least ``min_lines`` lines, are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, small

MIN_LINES = 1
_BLANK = " \t\r\f\x0b"
_PLACE = ("doc_id", "part", "i")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def _full(lines: Column) -> Column:
    """(n, line) of the lines that aren't blank."""
    numbered = F.transform(lines, lambda x, n: F.struct(n.alias("n"), x.alias("line")))
    return F.filter(numbered, lambda x: F.length(F.translate(x["line"], _BLANK, "")) > 0)


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, part, i, n, line): the i-th line that isn't blank is line n of the text."""
    rows = docs.withColumn("_part", F.xxhash64("text")).filter("doc_id is not null and text is not null")
    rows = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_part").alias("part"), F.posexplode(_full(_lines(F.col("text")))).alias("i", "x")
    )
    return rows.select("doc_id", "part", "i", F.col("x.n").alias("n"), F.col("x.line").alias("line"))


def _distinct_places(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with each place once: rows of ``docs`` that repeat id and text are one document.  Ids alone say where to look."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    twice = cut(ids.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id"), "twice")
    if not (n := twice.count()):
        drop(twice)
        return rows
    few = small(twice, n * 16)
    return rows.join(few, "doc_id", "left_anti").unionByName(rows.join(few, "doc_id", "left_semi").dropDuplicates([*_PLACE]))


def _numbered(groups: DataFrame, by: list[str]) -> DataFrame:
    """``groups`` with ``rank``, their place in the order of ``by``; written once."""
    return cut(groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _line_ranks(lines: DataFrame, often: DataFrame, n_often: int) -> DataFrame:
    """Level 1 of ``suffix_levels`` from (place, line, h) and (h, all), the hashes that occur twice or more and how often.

    Texts are moved once, for the aggregation, and each repeated one once a task.  A hash all of whose lines have one text
    stands for it from there on; the lines of others are joined by text.
    """
    rows = lines.join(small(often.select("h"), n_often * 16), "h", "left_semi")
    groups = rows.groupBy("h", "line").agg(F.count("*").alias("c"), F.min(F.struct(*_PLACE)).alias("first")).filter("c > 1")
    groups = cut(groups.join(small(often, n_often * 24), "h"), "groups")
    alone = F.col("c") == F.col("all")
    ranks = _numbered(groups.select("h", F.when(~alone, F.col("line")).alias("line"), "first"), ["h", "line"])
    plain, texts = ranks.filter("line is null").drop("line"), ranks.filter("line is not null")
    out = lines.drop("line").join(small(plain, plain.count() * 64), "h").select(*_PLACE, "rank", "first")
    size = texts.agg(F.sum(F.octet_length("line") + 64)).first()[0]
    out = out if size is None else out.unionByName(lines.join(small(texts, size), ["h", "line"]).select(*_PLACE, "rank", "first"))
    out = cut(out, "suffixes")
    drop(groups, ranks)
    return out


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose ``keys`` occur at least twice, with the ``rank`` of the keys in their order and
    the ``first`` place that has them instead of the keys."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("c"), F.min(F.struct(*_PLACE)).alias("first")).filter("c > 1").drop("c")
    ranks = _numbered(groups, keys)
    out = cut(rows.join(small(ranks, ranks.count() * 64), keys).select(*_PLACE, "rank", "first"), "suffixes")
    drop(ranks)
    return out


def suffix_levels(docs: DataFrame, min_lines: int = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """(depth, suffixes) for depths 1, 2, 4, ... up to ``min_lines``, then its doubles, until no suffix is repeated.

    A row (doc_id, part, i, rank, first) for every suffix whose first ``depth`` lines occur
    elsewhere: ``rank`` orders the suffixes by these lines (a line's own rank is that of its hash and
    text); equal ranks are one interval; ``first`` is the earliest (doc_id, part, i) of the interval.
    The tables are in the shared folder; the caller drops them.
    """
    lines = cut(_distinct_places(docs, line_table(docs).select(*_PLACE, "line", _hash(F.col("line")).alias("h"))), "lines")
    often = cut(lines.groupBy("h").agg(F.count("*").alias("all")).filter("all > 1"), "often")
    levels = [(1, _line_ranks(lines, often, often.count()))]
    drop(lines, often)
    while True:
        depth, level = levels[-1]
        step = depth if depth >= min_lines else min(depth, min_lines - depth)
        by = Window.partitionBy("doc_id", "part").orderBy("i").rangeBetween(step, step)
        pairs = level.select(*_PLACE, F.col("rank").alias("r1"), F.first("rank").over(by).alias("r2")).filter("r2 is not null")
        after = _ranked(pairs, ["r1", "r2"])
        if after.isEmpty():
            drop(after)
            return levels
        levels.append((depth + step, after))


def suffix_ranks(docs: DataFrame, depth: int) -> DataFrame:
    """The level of ``suffix_levels`` at one depth."""
    found = None
    for d, level in suffix_levels(docs, depth):
        if d == depth:
            found = level
        else:
            drop(level)
    return line_table(docs).select(*_PLACE, F.lit(0).alias("rank"), F.struct(*_PLACE).alias("first")).limit(0) if found is None else found


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, part, i, n, source): maximal runs of ``n`` lines from the i-th on, at least ``min_lines``, that
    the earlier place ``source`` (doc_id, part, i) has, too.

    The source is the earliest place of the longest doubled prefix that an earlier place has;
    runs inside another run of their document are left out.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    levels = suffix_levels(docs, min_lines)
    place = F.struct(*_PLACE)
    deep = None
    for depth, level in levels:
        if depth >= min_lines:
            later = level.filter(F.col("first") != place).select(*_PLACE, F.struct(F.lit(depth).alias("depth"), "first").alias("at"))
            deep = later if deep is None else deep.unionByName(later)
    if deep is None:
        deep = levels[0][1].limit(0).select(*_PLACE, F.struct(F.lit(0).alias("depth"), "first").alias("at"))
    deep = deep.groupBy(*_PLACE).agg(F.max_by("at", F.col("at.depth")).alias("at")).select(*_PLACE, F.col("at.depth").alias("n"), F.col("at.first").alias("source"))
    before = F.lag(F.struct("i", "source")).over(Window.partitionBy("doc_id", "part").orderBy("i"))
    carried = F.coalesce(
        (before["i"] == F.col("i") - 1) & (before["source"]["doc_id"] == F.col("source.doc_id"))
        & (before["source"]["part"] == F.col("source.part")) & (before["source"]["i"] == F.col("source.i") - 1),
        F.lit(False),
    )
    pairs = cut(deep.withColumn("carried", carried).filter("not carried").drop("carried"), "pairs")
    n_pairs = pairs.count()
    for depth, level in reversed(levels if n_pairs else []):
        ranks = level.select(F.col("doc_id").alias("d"), F.col("part").alias("p"), F.col("i").alias("k"), F.col("rank"))
        here = ranks.toDF("d", "p", "k", "here")
        there = ranks.toDF("d2", "p2", "k2", "there")
        rows = pairs.withColumn("x", F.col("i") + F.col("n")).withColumn("y", F.col("source.i") + F.col("n"))
        rows = rows.join(here, (F.col("doc_id") == F.col("d")) & (F.col("part") == F.col("p")) & (F.col("x") == F.col("k")))
        rows = rows.join(
            there, (F.col("source.doc_id") == F.col("d2")) & (F.col("source.part") == F.col("p2")) & (F.col("y") == F.col("k2")) & (F.col("here") == F.col("there"))
        )
        longer = cut(rows.select(*_PLACE), "longer")
        longer_ = small(longer, longer.count() * 32).withColumn("more", F.lit(depth))
        new = cut(pairs.join(longer_, list(_PLACE), "left").select(*_PLACE, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "source"), "pairs")
        drop(pairs, longer)
        pairs = new
    drop(*(level for _, level in levels))
    end = F.max(F.col("i") + F.col("n")).over(Window.partitionBy("doc_id", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.coalesce(end >= F.col("i") + F.col("n"), F.lit(False))
    return pairs.withColumn("inside", inside).filter("not inside").drop("inside")


def deduplicate_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """All columns of ``docs`` (``doc_id``, ``text`` and any others) with later copies of repeated
    line runs taken out of ``text``, and ``n_lines``, ``n_removed`` (longs) and ``runs``: the maximal runs taken
    out, each with ``line``, its first line in the text, ``n``, its number of lines that aren't blank, and
    ``source_id`` and ``source_i``, the document and the place, in lines that aren't blank, where it occurs
    first.  Columns of these names are replaced.

    Lines end at line feeds; they are compared as they are; blank lines stay and don't part
    a run.  A text whose lines all go becomes empty, and its row stays.  A null text stays
    null and has no lines; rows with a null doc_id stay whole and are nobody's earlier copy; of
    rows that repeat one id, those with equal texts are one document, others are ordered by a
    hash of the text.  An empty table stays empty.
    """
    runs = repeated_runs(docs, min_lines)
    run = F.struct("i", "n", F.col("source.doc_id").alias("source_id"), F.col("source.i").alias("source_i"))
    gone = runs.groupBy(F.col("doc_id").alias("id"), "part").agg(F.array_sort(F.collect_list(run)).alias("gone"))
    gone = cut(gone, "gone")
    drop(runs)
    size = gone.agg(F.sum(F.size("gone") * 32 + 48)).first()[0] or 0
    base = docs.drop("n_lines", "n_removed", "runs")
    # the caller's columns travel in one struct, so that none of their names can clash
    rows = base.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("part"), "text"
    ).join(small(gone, size), ["id", "part"], "left")
    lines = _lines(F.col("text"))
    # only texts with runs are cut into lines again
    places = F.when(F.col("gone").isNotNull(), F.transform(_full(lines), lambda x: x["n"]))
    rows = rows.withColumn("places", places)
    numbers = F.array_distinct(F.flatten(F.transform("gone", lambda g: F.slice("places", g["i"] + 1, g["n"]))))
    rows = rows.withColumn("numbers", numbers)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("numbers"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda n: F.get(lines, n)), "\n")
    )
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("numbers")).cast("long")
    shown = F.transform("gone", lambda g: F.struct(F.get("places", g["i"]).alias("line"), g["n"].alias("n"), g["source_id"].alias("source_id"), g["source_i"].alias("source_i")))
    own = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in base.columns]
    return rows.select(*own, n_lines.alias("n_lines"), n_removed.alias("n_removed"), shown.alias("runs"))


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    return deduplicate_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


ORACLE = r"""
with l as (
  select doc_id, n, line, row_number() over (partition by doc_id order by n) as i from (
    select doc_id, unnest(range(len(s))) as n, unnest(s) as line
    from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null))
  where length(translate(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11), '')) > 0),
f as (select *, row_number() over (partition by line order by doc_id, i) as k from l),
gone as (select doc_id, n from f where k > 1),
d as (select doc_id, unnest(range(len(s))) as n, unnest(s) as line
  from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null)),
kept as (select doc_id, string_agg(line, chr(10) order by n) as t
  from d anti join gone using (doc_id, n) group by doc_id),
r as (select doc_id, count(*) as c from gone group by doc_id)
select doc_id, coalesce(len(string_split(text, chr(10))), 0) as n_lines, coalesce(c, 0) as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from documents left join kept using (doc_id) left join r using (doc_id)
"""
