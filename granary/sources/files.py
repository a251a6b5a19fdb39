"""Folders as tables of entries, and entries as tables of overlapping chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.naming import dense_ids
from granary.sources import ranges

CHUNK = ranges.CHUNK


def entries(spark: SparkSession, root: str, content: bool = False, loc: bool = False) -> DataFrame:
    """(entry, path, size[, loc][, content]) of all files below ``root``, numbered by lower-case path.

    ``path`` is relative to ``root``.  Only paths and sizes are sorted and numbered; ``content`` is read
    after that, where the rows are, and without it the files' bytes are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    prefix = len("/" + base.split(":", 1)[-1].lstrip("/")) + 1
    columns = [F.substring(path, F.lit(prefix + 1), F.length(path)).alias("path"), F.col("length").alias("size")]
    rows = numbered(files.select(*columns, ranges.plain(F.col("path")).alias("loc")))
    rows = ranges.bind(rows) if content else rows
    return rows.select("entry", "path", "size", *(["loc"] if loc else []), *(["content"] if content else []))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``entry`` first: their number by lower-case path."""
    out = dense_ids(rows.withColumn("_lower", F.lower("path")), ["_lower", "path"], "entry").drop("_lower")
    return out.select("entry", *rows.columns)


def chunks(entries: DataFrame, chunk: int = CHUNK, overlap: int = 64) -> DataFrame:
    """(entry, start, data, last) of entries with ``content``, each chunk with ``overlap`` bytes of the next."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.octet_length("content") - 1, F.lit(0)).cast("long"), F.lit(chunk).cast("long"))
    rows = entries.filter("content is not null").select("entry", "content", F.explode(starts).alias("start"))
    data = F.expr(f"substring(content, cast(start as int) + 1, {chunk + overlap})")
    return rows.select("entry", "start", data.alias("data"), (F.col("start") + chunk >= F.octet_length("content")).alias("last"))


def scannable(entries: DataFrame, least: int = 16) -> DataFrame:
    """Entries of at least ``least`` bytes, without bodies whose header file is beside them (.bd with .hd)."""
    from granary.functions.text import extension, stem

    ext, base = F.lower(extension(F.col("path"))), F.lower(stem(F.col("path")))
    heads = entries.filter(ext == "hd").select(base.alias("_stem"), F.lit("bd").alias("_ext")).distinct()
    rows = entries.withColumn("_stem", base).withColumn("_ext", ext)
    return rows.join(heads, ["_stem", "_ext"], "left_anti").filter(F.col("size") >= least).drop("_stem", "_ext")
