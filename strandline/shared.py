"""The folder that driver and executors share, and tables kept in it between steps.

Iterations keep their state as Parquet, bucketed by the key that the next step
joins on, so a step shuffles its messages only; what an older step wrote is
removed.  A lost executor loses none of it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import StrandlineError

BUCKET_ROWS = 500_000

_PRIVATE: dict[str, str] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder; a private one is made where none is set, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise StrandlineError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _PRIVATE:
            _PRIVATE[app] = "file://" + tempfile.mkdtemp(prefix="strandline-")
        where = _PRIVATE[app]
    return where.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def file_versions(df: DataFrame) -> tuple:
    """(path, length, modification time) of the files that a frame reads."""
    found = []
    for name in sorted(df.inputFiles()):
        files, at = file_system(df.sparkSession, name)
        status = files.getFileStatus(at)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(found)


def planned_ahead(spark: SparkSession) -> SparkSession:
    """A session of its own for static plans, with the same settings and tables.

    A step over buckets has its partitions and joins laid down; planning each stage
    anew took longer than running it.  Frames of that session are planned so, whatever
    other threads do, and the caller's session stays as it is.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.adaptive.enabled", "false")
    # both sides of a step's joins lie in buckets of the key, one sorted file each: nothing to copy around or to sort again
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return own


class Tables:
    """Bucketed tables of one iteration; with ``rows``, their number grows with the rows, so that a task's does not; or ``buckets`` of them."""

    def __init__(self, spark: SparkSession, rows: int = 0, buckets: int | None = None) -> None:
        self.spark, self.root = planned_ahead(spark), f"{shared_dir(spark)}/strandline-steps"
        self.buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // BUCKET_ROWS + 1)
        # what a step shuffles meets the buckets where they lie
        self.spark.conf.set("spark.sql.shuffle.partitions", str(self.buckets))
        self.paths: dict[str, str] = {}

    def put(self, df: DataFrame, key: str, deal: bool = True) -> DataFrame:
        """``df`` written in buckets of ``key``; without ``deal`` its partitions hold whole buckets already."""
        name = f"strandline_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        dealt = df.repartition(self.buckets, key) if deal else df
        dealt.write.bucketBy(self.buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        self.paths[name] = path
        found = self.spark.table(name)
        found._strandline = name
        return found

    def drop(self, df: DataFrame | None) -> None:
        """Remove what ``put`` wrote; nothing reads it any more."""
        name = getattr(df, "_strandline", None)
        if name in self.paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            files, at = file_system(self.spark, self.paths.pop(name))
            files.delete(at, True)
