"""Sends this package to the executors, which need it to run the Python parts of a query."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application, once."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="tidemark-", suffix=".zip", dir=os.path.realpath(tempfile.gettempdir()))
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _sent.add(app)
