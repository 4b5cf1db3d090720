"""Making this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send the package to the workers once a Spark application, unless their PYTHONPATH has it already."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    path = Path(tempfile.mkdtemp(prefix="fieldwright-code-")) / "fieldwright.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((_ROOT / "fieldwright").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    context.addPyFile(str(path))
