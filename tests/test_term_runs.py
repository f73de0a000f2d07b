from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import index as I
from strandline.operators.postings import positional_postings
from strandline.schemas import DOCUMENT

ROWS = [("a", "u", "b a b", "x y x x", None, 0.0), ("b", "u", "", None, None, 0.0), ("c", "u", "y", "y", None, 0.0)]


def test_runs(spark):
    row = spark.range(1).select(X.term_counts(F.array(*map(F.lit, "cabac"))).alias("c"), X.term_positions(F.array(*map(F.lit, "cabac"))).alias("p"), X.term_positions(X.tokens(F.lit(""))).alias("none")).first()
    assert [tuple(x) for x in row.c] == [("a", 2), ("b", 1), ("c", 2)]
    assert [tuple(x) for x in row.p] == [("a", 2, [1, 3]), ("b", 1, [2]), ("c", 2, [0, 4])]
    assert row.none == []


def test_postings_of_whole_documents_shuffle_nothing(spark):
    found = I.build_postings(spark.createDataFrame(ROWS, DOCUMENT))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r) for r in found.collect()}
    assert got == {("title", "a", "a", 1, 3), ("title", "b", "a", 2, 3), ("content", "x", "a", 3, 4), ("content", "y", "a", 1, 4), ("title", "y", "c", 1, 1), ("content", "y", "c", 1, 1)}


def test_a_document_in_several_rows_is_one(spark):
    found = I.build_postings(spark.createDataFrame([*ROWS, ("c", "u", "y y z", "y", None, 0.0)], DOCUMENT)).where("link_id = 'c'")
    assert {tuple(r) for r in found.collect()} == {("title", "y", "c", 3, 3), ("title", "z", "c", 1, 3), ("content", "y", "c", 2, 1)}


def test_positions_of_whole_documents_shuffle_nothing(spark):
    found = positional_postings(spark.createDataFrame(ROWS, DOCUMENT))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(map(str, r)) for r in found.where("link_id = 'a'").collect()} == {("title", "a", "a", "1", "3", "[1]"), ("title", "b", "a", "2", "3", "[0, 2]"), ("content", "x", "a", "3", "4", "[0, 2, 3]"), ("content", "y", "a", "1", "4", "[1]")}
    twice = positional_postings(spark.createDataFrame([*ROWS, ("c", "u", "y y z", "y", None, 0.0)], DOCUMENT)).where("link_id = 'c' and term = 'y'")
    assert {(r.field, r.tf, r.length, tuple(r.positions)) for r in twice.collect()} == {("title", 3, 3, (0, 0, 1)), ("content", 2, 1, (0, 0))}
