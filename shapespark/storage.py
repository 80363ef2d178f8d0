"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast when it is counted and at most so large.
BROADCAST_BYTES = 24 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, which goes when the application ends. Where that is unset, a temporary folder on one
    machine (as in tests); on a cluster each executor would write to a disk of its own, so there it is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="shapespark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    folder = f"{found.rstrip('/')}/shapespark-{context.applicationId}"
    if folder not in _marked:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _marked.add(folder)
    return folder


#: Folders that are deleted when the application ends.
_marked: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts the lineage of iterative plans, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
