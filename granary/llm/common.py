"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.scratch import BROADCAST_BYTES, cut, drop, drop_path, scratch_path, shared_folder, small

__all__ = ["BROADCAST_BYTES", "bound_batches", "crc_split", "cut", "drop", "drop_path", "scratch_path", "shared_folder", "small", "table", "tidy"]

Batches = Iterator[pa.RecordBatch]
#: Bytes of an Arrow batch that goes to a Python worker: rows alone, of which Spark takes 10,000, don't bound it.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of the session to BATCH_BYTES; a bound that the user has set stays."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` that gives freed memory back to the system at its end: a worker process lives on for
    later tasks and stages, and would else keep what its largest task took.  A full collection empties
    Python's lists of free tuples, each of which would hold a megabyte around it back."""

    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


def crc_split(doc_id: Column) -> Column:
    """True for held-out rows: the crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
