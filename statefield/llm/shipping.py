"""Makes this package importable by Python workers when it isn't on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application's files, once; nothing if PYTHONPATH already leads to it."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _done or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="statefield-py-")) / "statefield.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "statefield").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _done.add(app)
