from pyspark.sql import functions as F

from strandline.operators import segments
from strandline.operators.segments import _packed, _unpacked
from strandline.schemas import DOCUMENT
from strandline.sources.stores import open_index


def test_blocks_survive_packing(spark):
    d = [(3, 7, [0, 2, 9]), (5, 4, [1]), (900, 12, [0, 11])]
    row = spark.createDataFrame([(d,)], "d array<struct<doc int, length int, positions array<int>>>").select(_packed(F.col("d")).alias("p")).select("p", _unpacked(F.col("p")).alias("q")).first()
    assert row.p == [3, 3, 5, 900, 7, 4, 12, -1, 2, 9, -2, -1, 11]
    assert row.q == [[0, 2, 9], [1], [0, 11]]


def test_terms_are_grouped_where_their_documents_are(spark, tmp_path, monkeypatch):
    """Before blocks are dealt by term, nothing is shuffled but whole documents by window."""
    plans = []
    write = segments.SegmentedIndex._write_blocks
    monkeypatch.setattr(segments.SegmentedIndex, "_write_blocks", lambda self, seg, postings, n: (plans.append(postings.groupBy("field", "term", "win").count()._jdf.queryExecution().executedPlan().toString()), write(self, seg, postings, n)))
    store = open_index(spark, f"index:file://{tmp_path}/x")
    rows = [(f"{i:04d}", "u", "head", f"red red w{i}", None, 0.0) for i in range(30)]
    store.write("documents", spark.createDataFrame(rows, DOCUMENT))
    found = store.search_index()
    assert plans and all(p.count("Exchange ") == 1 for p in plans)
    block = found.blocks(["red"]).where("field = 'content'").select("tfs", "positions", "n", "tf_max", "len_min", "docs").collect()
    assert sum(b.n for b in block) == 30 and all(t == 2 and list(p) == [0, 1] for b in block for t, p in zip(b.tfs, b.positions, strict=True))
    assert {(b.tf_max, b.len_min) for b in block} == {(2, 3)}
