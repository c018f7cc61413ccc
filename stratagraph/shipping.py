"""Makes the package importable in Python workers that were not given its folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the application, unless PYTHONPATH names its folder already."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="stratagraph-")) / "stratagraph.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
