"""The document index: analysed postings, document upserts and ranking scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import MissingLinkID, NotFound
from ..functions import text as X
from ..schemas import NIL_ID, never

K1 = 1.2
B = 0.75


def _missing(column: str = "link_id"):
    return F.col(column).isNull() | (F.col(column) == NIL_ID)


def index_rejects(incoming: DataFrame) -> DataFrame:
    """Documents that cannot be indexed, for want of a link id."""
    return incoming.where(_missing())


def incoming_texts(incoming: DataFrame) -> DataFrame:
    """One row for each document that can be indexed, the latest."""
    best = incoming.where(~_missing()).groupBy("link_id").agg(F.max(F.struct("indexed_at", "url", "title", "content")).alias("n"))
    return best.select("link_id", "n.*")


def incoming_scores(scores: DataFrame) -> DataFrame:
    """One (link_id, score) for each document."""
    return scores.where(~_missing()).groupBy("link_id").agg(F.max("score").alias("score"))


def index_documents(documents: DataFrame, incoming: DataFrame, strict: bool = False) -> DataFrame:
    """Insert or replace by link id; a known document keeps its PageRank, a new one has 0.

    Of several incoming documents with one id the latest indexed stays.
    """
    if strict and not index_rejects(incoming).isEmpty():
        raise MissingLinkID("a document has no link id")
    fields = ["url", "title", "content", "indexed_at"]
    new = incoming_texts(incoming).select("link_id", F.struct("indexed_at", "url", "title", "content").alias("n"))
    old = documents.select("link_id", F.struct(*fields).alias("o"), "pagerank")
    both = old.join(new, "link_id", "full_outer")
    return both.select("link_id", *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fields], F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))


def update_scores(documents: DataFrame, scores: DataFrame) -> DataFrame:
    """Set PageRanks (link_id, score); an unknown id becomes a placeholder document."""
    given = incoming_scores(scores)
    both = documents.join(given, "link_id", "full_outer")
    empty = F.col("indexed_at").isNull() & F.col("score").isNotNull()
    return both.select(
        "link_id",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("url", "title", "content")],
        F.when(empty, never()).otherwise(F.col("indexed_at")).alias("indexed_at"),
        F.coalesce("score", "pagerank", F.lit(0.0)).alias("pagerank"),
    )


def find_document(documents: DataFrame, link_id: str) -> DataFrame:
    return documents.where(F.col("link_id") == link_id).limit(1)


def require_document(documents: DataFrame, link_id: str):
    found = find_document(documents, link_id).collect()
    if not found:
        raise NotFound(f"document {link_id}")
    return found[0]


def repeated_ids(documents: DataFrame) -> bool:
    """Whether an id stands in several rows, so that rows are no whole documents; only ids are shuffled."""
    return not documents.groupBy("link_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def build_postings(documents: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(field, term, link_id, tf, length) of titles and contents; length counts the field's terms.

    Terms are counted inside the row of their document, so nothing is shuffled unless
    a document has several rows.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), X.tokens(F.col(f), stop_words).alias("terms")) for f in ("title", "content")])
    listed = documents.select("link_id", F.explode(fields).alias("f")).select("link_id", "f.field", F.size("f.terms").cast("long").alias("length"), F.explode(X.term_counts(F.col("f.terms"))).alias("t"))
    counted = listed.select("field", "t.term", "link_id", "t.tf", "length")
    if repeated_ids(documents):
        return counted.groupBy("field", "term", "link_id").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    return counted


def term_df(postings: DataFrame) -> DataFrame:
    """(field, term, df): documents that hold a term.  A document has one posting for a term, so rows are counted."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_stats(documents: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(field, docs, total): documents and terms of each field; one row for each of two fields."""
    sizes = F.array(*[F.struct(F.lit(f).alias("field"), F.size(X.tokens(F.col(f), stop_words)).cast("long").alias("n")) for f in ("title", "content")])
    return documents.select(F.explode(sizes).alias("s")).groupBy("s.field").agg(F.count(F.lit(1)).alias("docs"), F.sum("s.n").alias("total"))


def bm25_scores(documents: DataFrame, terms: list[str], stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(link_id, score): BM25 of each field, the better one, for documents with any of the terms.

    Postings are made for the query's terms alone: other words are filtered
    inside the scan's expressions and never shuffled.
    """
    if not terms:
        return documents.select("link_id", F.lit(0.0).alias("score")).limit(0)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), X.tokens(F.col(f), stop_words).alias("terms")) for f in ("title", "content")])
    counted = documents.select("link_id", F.explode(fields).alias("f")).select("link_id", "f.field", F.size("f.terms").cast("long").alias("length"), F.filter("f.terms", lambda t: t.isin(*terms)).alias("hits"))
    stats = counted.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("total"), *[F.count_if(F.array_contains("hits", t)).alias(f"df{i}") for i, t in enumerate(terms)])
    hits = counted.where(F.size("hits") > 0).join(F.broadcast(stats), "field")  # stats: one row for each of two fields
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = (F.size("hits") - F.size(F.array_remove("hits", t))).cast("double")
        idf = F.log1p((F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        average = F.greatest(F.col("total") / F.col("docs"), F.lit(1e-9))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / average))
    return hits.select("link_id", score.alias("score")).groupBy("link_id").agg(F.max("score").alias("score"))


def latest(documents: DataFrame) -> DataFrame:
    """One document for each id: the latest indexed."""
    w = Window.partitionBy("link_id").orderBy(F.desc("indexed_at"))
    return documents.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
