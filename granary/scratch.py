"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured size is at most this; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own where it is unset and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/granary-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back: later steps need nothing from before, and no
    executor's loss costs more than the step in work."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*frames: DataFrame) -> None:
    """Remove tables made by ``cut`` once nothing reads them any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/granary-" in path:
                drop_path(df.sparkSession, path)


def small(df: DataFrame, n_bytes: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a side whose size was measured; beyond the bound leave a shuffled join."""
    return F.broadcast(df) if n_bytes <= bound else df
