"""The periodic crawl pass as a Structured Streaming query.

Pages arrive as a stream of files; every trigger is one pass over what came
since the last.  The graph's tables are versioned folders: a pass writes the
next version and then the pointer, so a retried batch writes the same version
again and readers never see half of one.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import crawl, graphstore
from ..schemas import EDGE, LINK, never

PAGE = "page_id long, url string, html string"


class GraphTables:
    """Links and edges below a folder, one version for each pass."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, version: int, name: str) -> str:
        return f"{self.root}/v={version}/{name}"

    def _exists(self, version: int) -> bool:
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path(version, 'edges')}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def read(self, version: int) -> tuple[DataFrame, DataFrame]:
        """Tables of a version; those before the first are empty."""
        while version >= 0 and not self._exists(version):
            version -= 1
        if version < 0:
            return self.spark.createDataFrame([], LINK), self.spark.createDataFrame([], EDGE)
        return self.spark.read.schema(LINK).parquet(self.path(version, "links")), self.spark.read.schema(EDGE).parquet(self.path(version, "edges"))

    def write(self, version: int, links: DataFrame, edges: DataFrame) -> None:
        links.write.mode("overwrite").parquet(self.path(version, "links"))
        edges.write.mode("overwrite").parquet(self.path(version, "edges"))


def crawl_pass(tables: GraphTables, pages: DataFrame, version: int, now) -> None:
    """One pass: the pages' links replace their sources' edges."""
    links, edges = tables.read(version - 1)
    own = pages.select(ids.link_id(F.col("url")).alias("id"), "url", never().alias("retrieved_at"))
    crawled = crawl.crawl_pages(own, pages.select("url", "html"))
    tables.write(version, *graphstore.graph_update(links, edges, crawled, now))


def crawl_stream(spark: SparkSession, source: str, target: str, checkpoint: str, interval: str | None = "5 minutes", max_files: int | None = None, clock=datetime.now):
    """Start the stream: a pass for every interval, or with ``interval=None`` over all that is there, then stop."""
    reader = spark.readStream.schema(PAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    tables = GraphTables(spark, target)
    writer = reader.parquet(source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: crawl_pass(tables, batch, n, F.lit(clock())))
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
