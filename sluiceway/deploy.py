"""Workers need this package: it is sent along with the application, once."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Add the package's sources to the files that Spark gives to every Python worker."""
    here = os.path.dirname(os.path.abspath(__file__))
    if spark.sparkContext.applicationId in _SENT or not os.path.isdir(here):  # within an archive it was sent already
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="sluiceway-"), "sluiceway.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.join("sluiceway", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(archive)
    _SENT.add(spark.sparkContext.applicationId)
