"""Where streams and written tables may put files that all machines see."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset a temporary one, on a single machine only."""
    name = "spark.checkpoint.dir"
    found = spark.sparkContext.getConf().get(name, None) or spark.conf.get(name, None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {name} to a folder that all machines of {master} see")
    return temporary_folder()


@lru_cache(maxsize=1)
def temporary_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own among the shared ones, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone, and with it what its file system deletes on exit
        pass
