from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strandline.errors import MissingLinkID, NotFound
from strandline.functions import text as X
from strandline.operators import index as I
from strandline.operators import search as S
from strandline.operators.postings import PostingsIndex
from strandline.schemas import DOCUMENT, NIL_ID

NOW = datetime(2024, 1, 1)


def docs(spark, rows):
    return spark.createDataFrame([(f"{i:04d}", f"http://x/{i}", t, c, NOW, float(p)) for i, (t, c, p) in enumerate(rows)], DOCUMENT)


def ids_of(df):
    return [r.link_id for r in df.collect()]


@pytest.fixture
def stored(spark, tmp_path):
    return lambda documents: PostingsIndex(spark, f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}").write(documents)


def test_phrase_and_match(spark, stored):
    rows = [("", ("green harbour lamp" if i % 4 == 0 else "green lamp harbour") if i % 2 == 0 else "slow rivers, wide fields", 40 - i) for i in range(40)]
    found = stored(docs(spark, rows))
    assert ids_of(S.search(found, S.Query.parse('"Green HARBOUR lamp"'), page_size=50)) == [f"{i:04d}" for i in range(0, 40, 4)]
    assert ids_of(S.search(found, S.Query.parse("harbour absent"), page_size=50)) == [f"{i:04d}" for i in range(0, 40, 2)]
    assert S.search(found, S.Query.parse('"')).count() == S.search(found, S.Query.parse("")).count() == 0


def test_offset_rescore_and_total(spark, stored):
    d = docs(spark, [(f"Leaf-{i}", "meadow", 30 - i) for i in range(30)])
    found = stored(d)
    assert ids_of(S.search(found, S.Query.parse("meadow", 12), page_size=100)) == [f"{i:04d}" for i in range(12, 30)]
    assert S.search(found, S.Query.parse("meadow", 100)).count() == 0
    assert {r.total_count for r in S.search(found, S.Query.parse("leaf", "5")).collect()} == {30}
    assert [r.link_id for r in S.batches(found, S.Query.parse("leaf", 3), size=8)] == [f"{i:04d}" for i in range(3, 30)]
    turned = I.update_scores(d, d.selectExpr("link_id", "30 - pagerank as score"))
    assert ids_of(S.search(PostingsIndex(spark, found.root, turned), S.Query.parse("meadow"), page_size=50)) == [f"{i:04d}" for i in reversed(range(30))]


def test_a_page_reads_no_other_contents(spark, stored):
    found = stored(docs(spark, [("", f"meadow number {i}", i) for i in range(30)]))
    page = S.search(found, S.Query.parse("meadow"), page_size=3)
    plan = page._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 1 and "In(link_id, [0027,0028,0029])" in scans[0]
    hits = S.ranked(found, S.Query.parse("meadow"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in "".join(line for line in hits.splitlines() if "ReadSchema" in line and "postings" not in line and "fields" not in line)


def test_index(spark):
    d = spark.createDataFrame([], DOCUMENT)
    one = docs(spark, [("a", "b", 0)])
    d = I.update_scores(I.index_documents(d, one), one.selectExpr("link_id", "0.5D as score"))
    again = I.index_documents(d, docs(spark, [("new", "b", 0)]))
    row = I.require_document(again, "0000")
    assert row.title == "new" and row.pagerank == 0.5
    bad = spark.createDataFrame([(None, "u", "t", "c", NOW, 0.0), (NIL_ID, "u", "t", "c", NOW, 0.0)], "link_id string, url string, title string, content string, indexed_at timestamp, pagerank double")
    assert I.index_documents(d, bad).count() == 1 and I.index_rejects(bad).count() == 2
    with pytest.raises(MissingLinkID):
        I.index_documents(d, bad, strict=True)
    with pytest.raises(NotFound):
        I.require_document(d, "none")
    held = I.require_document(I.update_scores(d, spark.createDataFrame([("zz", 0.5)], "link_id string, score double")), "zz")
    assert (held.url, held.title, held.content, held.pagerank) == ("", "", "", 0.5) and held.indexed_at.year == 1


def test_blend(spark, stored):
    d = stored(docs(spark, [("", "term other words here", 1), ("", "term", 0.5)]))
    rows = {r.link_id: r for r in S.ranked(d, S.Query.parse("term"), "multiply").collect()}
    assert rows["0001"].rank_score == pytest.approx(rows["0001"].score * (rows["0001"].score + 0.5))
    rows = {r.link_id: r for r in S.ranked(d, S.Query.parse("term"), "sum").collect()}
    assert rows["0000"].rank_score == pytest.approx(rows["0000"].score + 1)


@pytest.mark.parametrize(
    ("offset", "to", "prev", "follow"),
    [(0, 3, None, "/search?q=moss&offset=3"), (3, 6, "/search?q=moss", "/search?q=moss&offset=6"), (6, 9, "/search?q=moss&offset=3", "/search?q=moss&offset=9"), (9, 12, "/search?q=moss&offset=6", None)],
)
def test_pagination(spark, offset, to, prev, follow):
    big = lambda n: F.lit(n).cast("long")
    row = spark.range(1).select(*S.pagination(F.lit("moss"), big(offset), big(3), big(12), 3)).first()
    assert tuple(row) == (offset + 1, to, 12, prev, follow)


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_highlight(spark):
    terms = ["fern", "Moss"]
    for text, expected in (("A FERN", "A <em>FERN</em>"), ("moss, then more.fern", "<em>moss</em>, then more.<em>fern</em>"), ("bark", "bark")):
        assert one(spark, X.highlight(F.col("t"), terms), text) == expected
    assert one(spark, X.escape_html(F.col("t")), "<a> & \"b\" 'c'") == "&lt;a&gt; &amp; &#34;b&#34; &#39;c&#39;"


def test_sentences(spark):
    text = "First one ends.Second asks ? Costs 5$.2 begins with a digit. v1.x stays"
    assert one(spark, X.sentences(F.col("t")), text) == ["First one ends.", "Second asks ?", " Costs 5$.", "2 begins with a digit.", " v1.x stays"]
    assert one(spark, X.sentences(F.col("t")), None) == []


# six sentences; the second (33 bytes with the blank before), the fifth and the sixth (18 bytes) hold terms
WALK = "We left at dawn. The old mill by the river slept. Nobody spoke. Rain fell. Our mill had lost its wheel. The river ran on."


def test_summary(spark):
    terms = ["MILL", "river"]
    ratios = spark.createDataFrame([(WALK,)], "t string").select(F.transform(X.sentences(F.col("t")), lambda s: X.match_ratio(s, terms))).first()[0]
    assert ratios == pytest.approx([0, 2 / 7, 0, 0, 1 / 6, 1 / 4])
    # the second, the last, then the fifth, of which 9 bytes are left of 60; a gap stands before the fifth
    assert one(spark, X.match_summary(F.col("t"), terms, 256), WALK) == "The old mill by the river slept... Our mill had lost its wheel. The river ran on."
    assert one(spark, X.match_summary(F.col("t"), terms, 60), WALK) == "The old mill by the river slept... Our mill... The river ran on."
    assert one(spark, X.match_summary(F.col("t"), ["none"], 256), WALK) == ""


def test_query():
    assert S.Query.parse('"a b"').phrase and not S.Query.parse('"a b').phrase
    assert S.Query.parse("x", "junk").offset == 0 and S.Query.parse("x", "7").offset == 7


def test_search_page(spark, stored):
    row = S.search_page(stored(docs(spark, [("", "We found the term here. Nothing else.", 1)])), "term").first()
    assert row.title == "http://x/0" and "<em>term</em>" in row.summary and row.total_count == 1


def test_stored_postings(spark, stored):
    d = docs(spark, [("", "red blue green", 1), ("Red Green", "blue red", 1), ("green red", "a a a b", 1), ("", "", 1)])
    found = stored(d)
    want = {r.link_id: r.score for r in I.bm25_scores(d, ["red", "a"]).collect()}
    assert {r.link_id: r.score for r in found.scores(["red", "a", "a"]).collect()} == pytest.approx(want)
    assert {r.link_id for r in found.phrase(["red", "green"]).collect()} == {"0001"}
    assert {r.link_id for r in found.phrase(["a", "a", "b"]).collect()} == {"0002"}
    assert found.scores([]).count() == found.phrase([]).count() == found.phrase(["none"]).count() == 0
    plan = found.postings(["red"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,red)" in plan
