"""Make the package importable in Spark's Python workers, wherever the driver found it."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    folder = tempfile.mkdtemp(prefix="nodeloom-ship-")
    path = os.path.join(folder, "nodeloom.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
