"""Put this package on the executors' import path, where it isn't installed there."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    store = io.BytesIO()
    with zipfile.ZipFile(store, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, str(source.relative_to(root.parent)))
    target = Path(tempfile.mkdtemp(prefix="strandline-ship-")) / "strandline.zip"
    target.write_bytes(store.getvalue())
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
