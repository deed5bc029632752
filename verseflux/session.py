"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_NAME = "verseflux"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Not needed if the package is installed on the cluster or passed with ``--py-files``; in
    those cases it does no harm.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix=f"{_NAME}-package-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, _NAME), "zip", root, _NAME))
        _shipped.add(sc.applicationId)
    return spark
