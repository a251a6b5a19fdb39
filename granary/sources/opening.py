"""One way in: a folder, a disc image or a single file as a table of entries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import serial, titled
from granary.sources import disc, files, ranges


def open_source(spark: SparkSession, path: str, content: bool = False, loc: bool = False) -> DataFrame:
    """(entry, path, size[, loc][, content]) of what ``path`` holds.

    A folder gives its files, numbered by lower-case path; a disc image that ``disc`` knows gives the files in it in
    the same order; any other file is one entry with its own name.  Contents are read by place, so executors must reach
    the path itself by a file system that pyarrow knows; nothing but places is sorted or joined.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    if status.isDirectory():
        return files.entries(spark, path, content, loc)
    store, root = ranges.store_of(path)
    try:
        with store.open_input_file(root) as f:
            layout = disc.layout_of(f, status.getLen())
    except (OSError, pa.ArrowInvalid):  # in a store that only Spark reads
        layout = None
    if layout is None:
        name = F.regexp_extract("path", r"([^/]*)$", 1)
        rows = spark.read.format("binaryFile").load(path).select(F.lit(0).cast("long").alias("entry"), name.alias("path"), F.col("length").alias("size"), ranges.plain(path).alias("loc"))
    else:
        spark.dataSource.register(disc.DiscImage)
        found = spark.read.format("disc_image").option("path", path).load()
        at = F.struct(F.lit(path).alias("uri"), (F.col("start") * F.col("raw")).alias("at"), "raw", "data")
        rows = files.numbered(found.select("path", "size", at.alias("loc")))
    rows = ranges.bind(rows) if content else rows
    return rows.select("entry", "path", "size", *(["loc"] if loc else []), *(["content"] if content else []))


def title_of(entries: DataFrame, name: str) -> DataFrame:
    """One row (title, serial): the serial in the first 4,096 bytes of SYSTEM.CNF, if ``entries`` (with ``content``) have one, and ``name`` with it."""
    text = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    found = entries.filter(F.lower("path") == "system.cnf").agg(F.min_by(serial(text), "entry").alias("serial"))
    return found.select(titled(F.lit(name), F.col("serial")).alias("title"), "serial")
