"""Named queries of the package."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from . import listing, models, scores, selection, texts, vectors  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "ship"]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of this application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = tempfile.mkdtemp(prefix="lapsewise-ship-")
    archive = shutil.make_archive(os.path.join(target, "lapsewise"), "zip", root, "lapsewise")
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
