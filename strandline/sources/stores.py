"""Stores by URI: where link, edge and document tables live.

``in-memory:`` starts empty and ends with the session; ``parquet:<folder>`` keeps
each table as a log of commits; ``index:<folder>`` is such a folder with an index
of the documents beside it, for searches; ``postgresql:`` (and CockroachDB, which
speaks its protocol) goes through JDBC with a partitioned read on the id, and
needs the driver's jar.  ``es:`` is refused: its place is taken by ``index:``.

Changes go in by key (``upsert_links``, ``upsert_edges``, ``put_documents``,
``put_scores``): each writes its own rows only, and several writers at once keep
each other's.  ``write`` replaces a table by a frame that may be made from the
table itself.  It never takes away the old rows before the new ones are complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import StrandlineError, UnknownEdgeLinks
from ..functions import ids
from ..operators import graphstore, index
from ..operators.graphstore import _time
from ..operators.segments import SegmentedIndex
from ..schemas import DOCUMENT, EDGE, LINK, NIL_ID, never
from ..shared import file_system, shared_dir
from .deltalog import DeltaTable, Kind

GRAPH_TABLES = {"links": LINK, "edges": EDGE}
INDEX_TABLES = {"documents": DOCUMENT}
#: what each table's ranges are taken on
RANGE_COLUMN = {"links": "id", "edges": "src", "documents": "link_id"}
KEY = {"links": "id", "edges": "id", "documents": "link_id"}


class Store:
    """Tables of fixed schemas."""

    def __init__(self, spark: SparkSession, tables: dict[str, StructType]) -> None:
        self.spark, self.tables = spark, tables

    def _schema(self, name: str) -> StructType:
        if name not in self.tables:
            raise StrandlineError(f"no table {name!r}; there are {', '.join(self.tables)}")
        return self.tables[name]

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self._schema(name))

    def read(self, name: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
        """A table's rows, or those with lo <= id < hi."""
        raise NotImplementedError

    def write(self, name: str, df: DataFrame) -> None:
        raise NotImplementedError

    def link_ids(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``id``: that of the stored link, or the one that the URL gives."""
        known = self.read("links").select("url", F.col("id").alias("_id"))
        return urls.join(known, "url", "left").withColumn("id", F.coalesce("_id", ids.link_id(F.col("url")))).drop("_id")

    def upsert_links(self, incoming: DataFrame) -> None:
        """Insert or touch by URL (url[, retrieved_at]); the latest retrieval wins."""
        raise NotImplementedError

    def upsert_edges(self, pairs: DataFrame, now, cutoffs: DataFrame | None = None, unknown: str | None = None) -> None:
        """Insert or touch (src, dst) at ``now``; older edges of the sources of ``cutoffs`` (src, updated_before) go.  All in one commit.

        ``unknown`` says what becomes of edges with an end that is no link: 'drop',
        'error', or (default) that the caller has seen to it.
        """
        raise NotImplementedError

    def put_documents(self, texts: DataFrame) -> None:
        """Insert or replace texts by link id; PageRanks stay."""
        raise NotImplementedError

    def put_scores(self, scores: DataFrame) -> None:
        """Set PageRanks (link_id, score); an unknown id becomes a placeholder document."""
        raise NotImplementedError

    def reset(self) -> None:
        """Empty every table."""
        for name in self.tables:
            self.write(name, self._empty(name))

    def close(self) -> None:
        """Give back what the store holds; its tables stay, except in memory."""


def _links(rows: DataFrame) -> DataFrame:
    """One row for each id: the latest retrieval."""
    return rows.groupBy("id").agg(F.max("url").alias("url"), F.max("retrieved_at").alias("retrieved_at"))


def _edges(rows: DataFrame) -> DataFrame:
    """One row for each pair of ends, the latest update; a row without ``dst`` says that older edges of its source are gone."""
    merged = rows.groupBy("src", "dst").agg(F.min("id").alias("id"), F.max("updated_at").alias("updated_at"))
    cuts = merged.where("dst is null")
    left = graphstore.remove_stale_edges_many(merged.where("dst is not null"), cuts.select("src", F.col("updated_at").alias("updated_before")))
    return left.unionByName(cuts)


def _documents(rows: DataFrame) -> DataFrame:
    """The latest commit's text and the latest commit's score of each document; one that has a score alone is a placeholder."""
    text, score = F.struct("_v", "indexed_at", "url", "title", "content"), F.struct("_v", "pagerank")
    met = rows.groupBy("link_id").agg(F.max(F.when(F.col("indexed_at").isNotNull(), text)).alias("t"), F.max(F.when(F.col("pagerank").isNotNull(), score)).alias("p"))
    shown = lambda c, default: F.when(F.col("t").isNotNull(), F.col(f"t.{c}")).otherwise(default).alias(c)
    return met.select("link_id", *[shown(c, F.lit("")) for c in ("url", "title", "content")], shown("indexed_at", never()), F.coalesce("p.pagerank", F.lit(0.0)).alias("pagerank"))


KINDS = {
    "links": Kind(LINK, "id", _links, grouped=True),
    "edges": Kind(EDGE, "src", _edges, lambda rows: rows.where("dst is not null")),
    "documents": Kind(DOCUMENT, "link_id", _documents, grouped=True),
}


class ParquetStore(Store):
    """Folders of Parquet, each a log of commits (see :mod:`deltalog`), in ranges of ids.

    Changes of several writers at once all stay.  ``ranges`` and ``compact_at``
    are the log's.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, StructType], root: str, **options) -> None:
        super().__init__(spark, tables)
        self.root = root.rstrip("/")
        self.logs = {name: DeltaTable(spark, f"{self.root}/{name}", KINDS[name], **options) for name in tables}

    def log(self, name: str) -> DeltaTable:
        self._schema(name)
        return self.logs[name]

    def read(self, name: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
        return self.log(name).read(lo, hi)

    def write(self, name: str, df: DataFrame) -> None:
        if name == "documents":  # a row of a whole table has a text and a score, as a commit of either alone has not
            df = df.withColumn("indexed_at", F.coalesce("indexed_at", never())).withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
        # ids that are not made from what their rows name, such as those of another store, have to be looked up from then on
        made = {"links": ids.link_id(F.col("url")), "edges": ids.edge_id(F.col("src"), F.col("dst"))}.get(name)
        self.log(name).replace(df, None if made is None else F.col("id") != made)

    def link_ids(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``id``: that of the stored link, or the one that the URL gives."""
        made = ids.link_id(F.col("url"))
        if not self.log("links").state().flags.get("flagged"):
            return urls.withColumn("id", made)
        known = self.read("links").select("url", F.col("id").alias("_id"))
        return urls.join(known, "url", "left").withColumn("id", F.coalesce("_id", made)).drop("_id")

    def upsert_links(self, incoming: DataFrame) -> None:
        when = F.coalesce(F.col("retrieved_at").cast("timestamp"), never()) if "retrieved_at" in incoming.columns else never()
        new = incoming.groupBy("url").agg(F.max(when).alias("retrieved_at"))
        self.log("links").append(self.link_ids(new))

    def upsert_edges(self, pairs: DataFrame, now, cutoffs: DataFrame | None = None, unknown: str | None = None) -> None:
        if unknown is not None:
            links = self.read("links")
            if unknown == "error" and not graphstore.unknown_edges(pairs, links).isEmpty():
                raise UnknownEdgeLinks("an edge names an unknown link")
            pairs = graphstore.known_edges(pairs.select("src", "dst"), links)
        new = pairs.select("src", "dst").distinct().withColumn("updated_at", _time(now)).withColumn("id", ids.edge_id(F.col("src"), F.col("dst")))
        if self.log("edges").state().flags.get("flagged"):
            known = self.read("edges").select("src", "dst", F.col("id").alias("_id"))
            new = new.join(known, ["src", "dst"], "left").withColumn("id", F.coalesce("_id", "id")).drop("_id")
        if cutoffs is not None:
            gone = cutoffs.select("src", F.lit(None).cast("string").alias("dst"), F.col("updated_before").alias("updated_at"), F.lit(None).cast("string").alias("id"))
            new = new.unionByName(gone)
        self.log("edges").append(new)

    def put_documents(self, texts: DataFrame) -> None:
        # dealt by id once, for the latest of each and for the files alike
        latest = index.incoming_texts(texts.repartitionByRange("link_id"))
        self.log("documents").append(latest.withColumn("indexed_at", F.coalesce("indexed_at", never())), dealt=True)

    def put_scores(self, scores: DataFrame) -> None:
        self.log("documents").append(index.incoming_scores(scores).select("link_id", F.col("score").alias("pagerank")))

    def reset(self) -> None:
        for name in self.tables:
            self.log(name).replace(self._empty(name))


class MemoryStore(ParquetStore):
    """A private folder among the session's shared ones; :meth:`close` removes it."""

    def __init__(self, spark: SparkSession, tables: dict[str, StructType]) -> None:
        super().__init__(spark, tables, f"{shared_dir(spark)}/strandline-memory-{uuid.uuid4().hex}")

    def reset(self) -> None:
        self.close()

    def close(self) -> None:
        files, at = file_system(self.spark, self.root)
        files.delete(at, True)


class IndexStore(ParquetStore):
    """Documents with their index, which follows the log of the documents in segments."""

    def search_index(self) -> SegmentedIndex:
        """The index as of now; what was committed since the last call is indexed first."""
        return SegmentedIndex(self.spark, f"{self.root}/index", self.log("documents")).refresh()


class JdbcStore(Store):
    def __init__(self, spark: SparkSession, tables: dict[str, StructType], url: str, partitions: int = 16, options: dict[str, str] | None = None) -> None:
        super().__init__(spark, tables)
        self.url, self.partitions, self.options = "jdbc:" + url, partitions, options or {}

    def predicates(self, name: str) -> list[str]:
        """One id range for each partition of the read."""
        column, bounds = RANGE_COLUMN[name], ids.partition_bounds(self.partitions)
        starts = [NIL_ID, *bounds[:-1]]
        last = len(bounds) - 1
        return [f"{column} >= '{lo}'" + ("" if i == last else f" AND {column} < '{hi}'") for i, (lo, hi) in enumerate(zip(starts, bounds, strict=True))]

    def read(self, name: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
        self._schema(name)
        found = self.spark.read.jdbc(self.url, name, predicates=self.predicates(name), properties=self.options)
        found = found.toDF(*[c.lower() for c in found.columns])
        key = F.col(RANGE_COLUMN[name])
        return found.where((key >= (lo or NIL_ID)) & (key < hi if hi else F.lit(True)))

    def statements(self, name: str, fresh: str) -> list[str]:
        """What brings a table to the rows of ``fresh``, row by row of its key, so that rows which stay keep what refers to them."""
        key = KEY[name]
        others = [c for c in self._schema(name).fieldNames() if c != key]
        there = f"SELECT 1 FROM {fresh} n WHERE n.{key} = {name}.{key}"
        columns = ", ".join([key, *others])
        return [
            f"DELETE FROM {name} WHERE NOT EXISTS ({there})",
            f"UPDATE {name} SET " + ", ".join(f"{c} = (SELECT n.{c} FROM {fresh} n WHERE n.{key} = {name}.{key})" for c in others) + f" WHERE EXISTS ({there})",
            f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {fresh} n WHERE NOT EXISTS (SELECT 1 FROM {name} WHERE {name}.{key} = n.{key})",
        ]

    def _beside(self, name: str, frames: list[DataFrame], statements: Callable[..., list[str]]) -> None:
        """Write frames to tables beside, then change the stored one in a single transaction."""
        fresh = [f"{name}_next_{uuid.uuid4().hex[:8]}" for _ in frames]
        self.transact([self._create_like(name, f) for f in fresh])
        try:
            for df, f in zip(frames, fresh, strict=True):
                df.select(*self._schema(name).fieldNames()).write.jdbc(self.url, f, mode="append", properties=self.options)
            self.transact(statements(*fresh))
        finally:
            self.transact([f"DROP TABLE {f}" for f in fresh])

    @staticmethod
    def _touch(name: str, fresh: str, keys: list[str], when: str, columns: list[str]) -> list[str]:
        """Later times for known keys, and the rows of new ones; rows of other writers stay."""
        same = " AND ".join(f"n.{k} = {name}.{k}" for k in keys)
        listed = ", ".join(columns)
        return [
            f"UPDATE {name} SET {when} = (SELECT n.{when} FROM {fresh} n WHERE {same}) WHERE EXISTS (SELECT 1 FROM {fresh} n WHERE {same} AND n.{when} > {name}.{when})",
            f"INSERT INTO {name} ({listed}) SELECT {listed} FROM {fresh} n WHERE NOT EXISTS (SELECT 1 FROM {name} WHERE {same})",
        ]

    def upsert_links(self, incoming: DataFrame) -> None:
        when = F.coalesce(F.col("retrieved_at").cast("timestamp"), never()) if "retrieved_at" in incoming.columns else never()
        new = incoming.groupBy("url").agg(F.max(when).alias("retrieved_at")).withColumn("id", ids.link_id(F.col("url")))
        self._beside("links", [new], lambda fresh: self._touch("links", fresh, ["url"], "retrieved_at", LINK.fieldNames()))

    def upsert_edges(self, pairs: DataFrame, now, cutoffs: DataFrame | None = None, unknown: str | None = None) -> None:
        # the database's foreign keys refuse unknown ends, unless they are left out here
        pairs = graphstore.known_edges(pairs.select("src", "dst"), self.read("links")) if unknown == "drop" else pairs
        new = pairs.select("src", "dst").distinct().withColumn("updated_at", _time(now)).withColumn("id", ids.edge_id(F.col("src"), F.col("dst")))
        touch = lambda fresh: self._touch("edges", fresh, ["src", "dst"], "updated_at", EDGE.fieldNames())
        if cutoffs is None:
            return self._beside("edges", [new], touch)
        # rows of edges from a source to itself say how long its edges count
        gone = cutoffs.groupBy("src").agg(F.max("updated_before").alias("updated_at")).select(F.col("src").alias("id"), "src", F.col("src").alias("dst"), "updated_at")
        cut = "DELETE FROM edges WHERE EXISTS (SELECT 1 FROM {} n WHERE n.src = edges.src AND edges.updated_at < n.updated_at)"
        return self._beside("edges", [new, gone], lambda fresh, cuts: [*touch(fresh), cut.format(cuts)])

    def _create_like(self, name: str, fresh: str) -> str:
        empty = " WITH NO DATA" if self.url.startswith("jdbc:derby:") else " WHERE 1 = 0"
        return f"CREATE TABLE {fresh} AS SELECT * FROM {name}{empty}"

    def transact(self, statements: list[str]) -> None:
        """Run all statements or none."""
        jvm = self.spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        if "driver" in self.options:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            connection.setAutoCommit(False)
            for sql in statements:
                statement = connection.createStatement()
                statement.execute(sql)
                statement.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def write(self, name: str, df: DataFrame) -> None:
        """Bring the table to the rows of ``df``."""
        self._beside(name, [df], lambda fresh: self.statements(name, fresh))


def _open(spark: SparkSession, uri: str, tables: dict[str, StructType]) -> Store:
    scheme = urlparse(uri).scheme
    makers: dict[str, Callable[[], Store]] = {
        "in-memory": lambda: MemoryStore(spark, tables),
        "parquet": lambda: ParquetStore(spark, tables, uri.split(":", 1)[1]),
        "postgresql": lambda: JdbcStore(spark, tables, uri, options={"stringtype": "unspecified"}),  # ids of type UUID are given as text
    }
    if tables is INDEX_TABLES:
        makers["index"] = lambda: IndexStore(spark, tables, uri.split(":", 1)[1])
    if scheme == "es":
        raise StrandlineError("unsupported store 'es': use index:<folder>, which keeps documents with their postings")
    if scheme not in makers:
        raise StrandlineError(f"unsupported store {scheme!r}; use one of {', '.join(makers)}")
    return makers[scheme]()


def open_graph(spark: SparkSession, uri: str) -> Store:
    return _open(spark, uri, GRAPH_TABLES)


def open_index(spark: SparkSession, uri: str) -> Store:
    return _open(spark, uri, INDEX_TABLES)
