"""The folder that driver and executors share, for tables and files that are written and read again."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import warnings
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on a local master a temporary folder of our own where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "recitary-shared")
    return path.rstrip("/")


def remover(spark: SparkSession, root: str) -> Callable[[str], None]:
    """Removes a path below root, also after the session was stopped: what it needs outlives that."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = of(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def remove(path: str) -> None:
        try:
            files.delete(of(path), True)
        except (Py4JError, OSError) as e:
            warnings.warn(f"{path} was not removed: {type(e).__name__}", stacklevel=2)

    return remove


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remover(spark, path), path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: read as often as wanted, it is the same."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
