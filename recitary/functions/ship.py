"""Sends this package to the executors, so that Python functions find it there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application: the package, its data files too, as a zip file on every executor's path."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return spark
    _sent.add(sc.applicationId)
    top = Path(__file__).resolve().parents[2]
    path = os.path.join(tempfile.mkdtemp(), "recitary_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((top / "recitary").rglob("*")):
            if f.is_file() and f.suffix != ".pyc":
                z.write(f, f.relative_to(top))
    sc.addPyFile(path)
    return spark
