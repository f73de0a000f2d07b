"""Materialised intermediate tables.

Long plans are cut by writing Parquet below the folder that the cluster names
in ``spark.checkpoint.dir``, which driver and executors share.  A lost executor
therefore never loses an intermediate table, and later passes read only the
columns they need.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_dir


_RECORDS: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/strandline/{label}-{uuid.uuid4().hex}"
    for record in _RECORDS:
        record.append(path)
    return path


@contextlib.contextmanager
def recorded(paths: list[str]) -> Iterator[list[str]]:
    """Gather in ``paths`` where tables are written meanwhile, to be removed once nothing reads them."""
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
