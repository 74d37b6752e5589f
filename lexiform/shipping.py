"""Makes the package importable on executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package's sources to the executors, once for each application; UDFs are unpickled there by import."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexiform-"), "lexiform_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in sorted(os.walk(here)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("lexiform", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _DONE.add(sc.applicationId)
