"""A stored inverted index: postings with positions, laid out by term.

Documents are numbered as they are stored, and the postings of one term and field
are blocks of numbers, one for each run of documents that a task had at once.
Blocks are partitioned by a hash of the term and sorted by it inside, so a query
reads the row groups of its own terms only (``term`` and the partition are pushed
to the reader) and never the documents.  Documents are kept beside them, in files
sorted by id, so that those of a page of results are fetched by their ids; ids
come to the hits of a query by number.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.blocks import FIELDS, OPENED, PARCEL, parcels, unparcelled
from ..functions.let import let
from ..shared import file_system
from ..ship import ship
from .index import B, K1, repeated_ids

BUCKETS = 64
WINDOW_BITS = 16
DEALT = 8 << 20  # bytes of stored texts whose blocks make a task
STORED = "field string, term string, win long, docs array<int>, tfs array<int>, lengths array<int>, positions array<int>, bucket int"


def positional_postings(documents: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(field, term, link_id, tf, length, positions), made inside the row of a document; those in several rows are grouped."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), X.tokens(F.col(f), stop_words).alias("terms")) for f in FIELDS])
    listed = documents.select("link_id", F.explode(fields).alias("f")).select("link_id", "f.field", F.size("f.terms").cast("long").alias("length"), F.explode(X.term_positions(F.col("f.terms"))).alias("t"))
    found = listed.select("field", "t.term", "link_id", F.col("t.tf").cast("long").alias("tf"), "length", "t.positions")
    if repeated_ids(documents):
        return found.groupBy("field", "term", "link_id").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return found


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


class PostingsIndex:
    """Postings and field sizes below a folder, with the documents they were made of."""

    def __init__(self, spark: SparkSession, root: str, documents: DataFrame | None = None) -> None:
        ship(spark)
        self.spark, self.root, self._documents = spark, root.rstrip("/"), documents

    def write(self, documents: DataFrame, stop_words: tuple[str, ...] = (), copy: bool = True) -> PostingsIndex:
        """Index ``documents``; without ``copy`` they are stored elsewhere already, and their texts are kept here while they are indexed only."""
        self._documents, folder = (None, "documents") if copy else (documents, "work")
        kept = documents if copy else documents.select("link_id", *FIELDS)
        # sorted where they are: no text is shuffled, and the numbers are those of the rows as stored
        self._write(kept.sortWithinPartitions("link_id").withColumn("docno", F.monotonically_increasing_id()), folder)
        numbered = self.spark.read.parquet(f"{self.root}/{folder}")
        self._write(numbered.select("docno", "link_id"), "ids")
        terms = lambda f: F.array_join(X.tokens(F.col(f), stop_words), " ") if stop_words else X.spaced(F.col(f))
        offset = F.col("docno").bitwiseAND(F.lit((1 << WINDOW_BITS) - 1)).cast("int").alias("doc")
        texts = numbered.select(F.shiftright("docno", WINDOW_BITS).alias("win"), offset, *[terms(f).alias(f) for f in FIELDS])
        files, at = file_system(self.spark, f"{self.root}/{folder}")
        tasks = max(files.getContentSummary(at).getLength() // DEALT + 1, min(self.spark.sparkContext.defaultParallelism, BUCKETS))
        # more tasks than buckets hold a bucket in parts, so that a very common term fills many files rather than one task
        parts = -(-tasks // BUCKETS)
        tasks = min(tasks, BUCKETS) * parts
        sent = texts.mapInArrow(lambda batches: parcels(batches, BUCKETS, parts, tasks), PARCEL).repartitionById(tasks, F.col("task"))
        dealt = sent.drop("task").mapInArrow(unparcelled, OPENED).withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "field", "win")
        self._write(dealt, "postings", "bucket")
        total = self._stored().groupBy("field").agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, n: a + n)).alias("total"))
        sizes = self._ids().agg(F.count(F.lit(1)).alias("docs"), F.lit(repeated_ids(self._ids())).alias("repeated"))
        fields = sizes.select(F.explode(F.array(*map(F.lit, FIELDS))).alias("field"), "docs", "repeated").join(total, "field", "left")
        self._write(fields.select("field", "docs", F.coalesce("total", F.lit(0)).alias("total"), "repeated").coalesce(1), "fields")
        if not copy:
            files.delete(at, True)
        files, at = file_system(self.spark, f"{self.root}/_SUCCESS")
        files.create(at, True).close()
        return self

    def _write(self, df: DataFrame, folder: str, *by: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{folder}")

    def documents(self) -> DataFrame:
        return self._documents if self._documents is not None else self.spark.read.parquet(f"{self.root}/documents").drop("docno")

    def ranks(self) -> DataFrame:
        """(link_id, pagerank) of every document; no text is read."""
        return self.documents().select("link_id", "pagerank")

    def _ids(self) -> DataFrame:
        return self.spark.read.schema("docno long, link_id string").parquet(f"{self.root}/ids")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(f"{self.root}/postings")

    def _fields(self) -> DataFrame:
        return self.spark.read.schema("field string, docs long, total long, repeated boolean").parquet(f"{self.root}/fields")

    @cached_property
    def _key(self) -> str:
        """What tells documents apart: their number, or their id if one stands in several rows."""
        return "link_id" if self._fields().where("repeated").count() else "docno"

    def _found(self, terms: list[str], positions: bool) -> DataFrame:
        """(field, term, tf, length[, positions]) by the documents' key; buckets and row groups of other terms are not read."""
        found = self._stored().where(F.col("bucket").isin(*[_bucket(F.lit(t)) for t in terms]) & F.col("term").isin(*terms))
        zipped = ["docs", "tfs", "lengths", *(["positions"] if positions else [])]
        found = found.withColumn("positions", _by_document(F.col("positions"))) if positions else found
        spread = found.select("field", "term", "win", F.inline(F.arrays_zip(*zipped)))
        docno = (F.shiftleft("win", WINDOW_BITS) + F.col("docs")).alias("docno")
        rows = spread.select("field", "term", docno, F.col("tfs").cast("long").alias("tf"), F.col("lengths").cast("long").alias("length"), *zipped[3:])
        if self._key == "docno":
            return rows
        merged = [F.sum("tf").alias("tf"), F.max("length").alias("length"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")]
        return self._named(rows).groupBy("field", "term", "link_id").agg(*(merged if positions else merged[:2]))

    def _named(self, df: DataFrame) -> DataFrame:
        """``df`` with ids in place of numbers."""
        return df.join(self._ids(), "docno").drop("docno") if "docno" in df.columns else df

    def postings(self, terms: list[str]) -> DataFrame:
        """(field, term, link_id, tf, length, positions) of the terms."""
        return self._named(self._found(terms, True)).select("field", "term", "link_id", "tf", "length", "positions")

    def scores(self, terms: list[str]) -> DataFrame:
        """(link_id, score): BM25 of each field, the better one, over documents with any of the terms."""
        terms = list(dict.fromkeys(terms))
        if not terms:
            return self.spark.createDataFrame([], "link_id string, score double")
        found = self._found(terms, False)
        df = found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        fields = self._fields().drop("repeated")
        # df has at most two rows for each term of the query, fields two in all
        met = found.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(fields), "field")
        idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        average = F.greatest(F.col("total") / F.col("docs"), F.lit(1e-9))
        score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
        best = met.groupBy(self._key, "field").agg(F.sum(score).alias("score")).groupBy(self._key).agg(F.max("score").alias("score"))
        return self._named(best).select("link_id", "score")

    def phrase(self, terms: list[str]) -> DataFrame:
        """(link_id): documents in which the terms follow each other in one field."""
        if not terms:
            return self.spark.createDataFrame([], "link_id string")
        names = list(dict.fromkeys(terms))
        found = self._found(names, True).groupBy(self._key, "field").agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(names)])
        starts = [shifted(f"p{names.index(t)}", i) for i, t in enumerate(terms)]
        return self._named(found.where(F.size(reduce(F.array_intersect, starts)) > 0).select(self._key).distinct())


def shifted(column: str, by: int) -> Column:
    """Where the phrase would start, for each position of its ``by``-th term."""
    return F.transform(F.col(column), lambda p: p - by)


def _starts(marked: Column) -> Column:
    """Where documents begin: the first position of each is -1 - itself."""
    return F.filter(F.transform(marked, lambda x, i: F.when(x < 0, i)), lambda i: i.isNotNull())


def _by_document(marked: Column) -> Column:
    """The positions of each document of a block."""
    own = lambda at, end: F.transform(F.slice(marked, at + 1, end - at), lambda x: F.when(x < 0, -1 - x).otherwise(x))
    return let(_starts(marked), lambda starts: F.transform(starts, lambda at, k: own(at, F.coalesce(F.get(starts, k + 1), F.size(marked)))))
