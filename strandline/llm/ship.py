"""What the operators of this subpackage need of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..ship import ship as _ship

#: A Python worker holds a few batches at a time, whatever the length of the texts.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors and bound the size of Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    _ship(spark)
