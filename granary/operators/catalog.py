"""Filters, counts and the manifest of a catalog of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(df: DataFrame, columns: list[str], text: str, kind: str | None = None, kind_column: str = "format") -> DataFrame:
    """Rows of a kind (None: all) in which one of the columns holds ``text``, whatever the case."""
    q = text.strip().lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(q))
    return df.filter(hit if kind is None else hit & (F.col(kind_column) == kind))


def counts(df: DataFrame, kind: str, last: str = "RAW") -> DataFrame:
    """(kind, n), with the kind ``last`` at the end, then by falling count and name."""
    n = df.groupBy(kind).agg(F.count("*").alias("n"))
    return n.orderBy(F.col(kind) == last, F.desc("n"), kind)


def counts_with_total(df: DataFrame, kind: str) -> DataFrame:
    """(kind, n) with a row "All"."""
    rolled = df.rollup(kind).agg(F.count("*").alias("n"), F.grouping(kind).alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "All").otherwise(F.col(kind)).alias(kind), "n")


def quoted(text: Column) -> Column:
    """A CSV field: quoted if it holds a comma, a quote or a line break."""
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def manifest(df: DataFrame, columns: dict[str, Column], *keys: str) -> DataFrame:
    """One ``line`` of CSV for each row, and its ``keys``."""
    return df.select(*keys, F.concat_ws(",", *[quoted(F.coalesce(c.cast("string"), F.lit(""))) for c in columns.values()]).alias("line"))


def preview(df: DataFrame, group: str, time: str, seconds: int) -> DataFrame:
    """Rows within so many seconds of the first of their group."""
    first = F.min(time).over(Window.partitionBy(group))
    return df.withColumn("_first", first).filter(F.col(time) < F.col("_first") + F.make_dt_interval(secs=F.lit(seconds))).drop("_first")


def select_ids(df: DataFrame, key: str, ids: list[int] | None = None) -> DataFrame:
    """Rows with the given ids; all rows if there is no list.  An empty list selects nothing."""
    return df if ids is None else df.filter(F.col(key).isin(ids)) if ids else df.limit(0)


def default_selection(df: DataFrame, note: str = "note") -> DataFrame:
    """Rows that can be exported: those without a note."""
    return df.filter(F.col(note).isNull())


def byte_range(header: Column, size: Column) -> Column:
    """(first, last) of a header such as ``bytes=5-9`` or ``bytes=5-`` over ``size`` bytes; null if it isn't one or lies outside."""
    form = r"^bytes=(\d+)-(\d*)$"
    first = F.try_to_number(F.regexp_extract(header, form, 1), F.lit("999999999999999999")).cast("long")
    last = F.regexp_extract(header, form, 2)
    last = F.when(F.length(last) > 0, F.try_to_number(last, F.lit("999999999999999999")).cast("long")).otherwise(size - 1)
    fine = header.rlike(form) & (first <= last) & (last < size)
    return F.when(fine, F.struct(first.alias("first"), last.alias("last")))


def payload(columns: list[str]) -> Column:
    """Columns as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*columns))


def request_id(url: Column) -> Column:
    """The number in the parameter ``id`` of an address; null if it has none."""
    return F.try_to_number(F.regexp_extract(url, r"[?&]id=([0-9]{1,18})(&|#|$)", 1), F.lit("9" * 18)).cast("long")


def listed(columns: list[tuple[str, int]], last: str) -> Column:
    """A line of columns of fixed width, those of negative width to the left, one space apart, and a last one after two."""
    cells = [F.rpad(F.col(c).cast("string"), -w, " ") if w < 0 else F.lpad(F.col(c).cast("string"), w, " ") for c, w in columns]
    return F.concat(F.concat_ws(" ", *cells), F.lit("  "), F.col(last))


def durations(df: DataFrame, group: str, samples: str, rate: str) -> DataFrame:
    """(group, n, ms): rows and their whole duration, each in whole milliseconds; a rate under 1 counts as 1."""
    ms = F.floor(F.col(samples) * 1000 / F.greatest(F.col(rate), F.lit(1)))
    return df.groupBy(group).agg(F.count("*").alias("n"), F.sum(ms).alias("ms"))
