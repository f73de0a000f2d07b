from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from strandline.functions import blocks as K
from strandline.operators import index as I
from strandline.operators.postings import PostingsIndex, positional_postings
from strandline.schemas import DOCUMENT

from test_blocks_in_batches import TEXTS, batch, expected

ODD = [("a", "u", "b a b", "x y x x", None, 0.0), ("b", "u", "", None, None, 0.0), ("c", "u", "y", "The y", None, 0.0), *[(f"{i}", "u", None, f"red w{i} {TEXTS[i % 8]}", None, 0.0) for i in range(40)]]
TERMS = sorted({t for r in ODD for f in (r[2], r[3]) for t in (f or "").lower().split()} | {"b_1", "1", "x", "absent"})


def documents(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCUMENT).repartition(5)


def rows_of(df):
    return sorted((r.field, r.term, r.link_id, r.tf, r.length, tuple(r.positions)) for r in df.collect())


def test_only_short_numbers_are_shuffled(spark, tmp_path, monkeypatch):
    """Texts stay where they are, and postings go as parcels; before, texts and postings with their ids were dealt in ranges."""
    plans, write = {}, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.update({path.rsplit("/", 1)[1]: self._df._jdf.queryExecution().executedPlan().toString()}), write(self, path, *a, **k))[1])
    found = PostingsIndex(spark, f"file://{tmp_path}/x").write(spark.createDataFrame(ODD, DOCUMENT))
    assert "Exchange" not in plans["documents"]
    dealt = [line for line in plans["postings"].splitlines() if "Exchange " in line]
    assert len(dealt) == 1 and "task" in dealt[0] and "rangepartitioning" not in dealt[0]
    stored = spark.read.parquet(f"{found.root}/postings")
    assert "link_id" not in stored.columns and stored.count() < positional_postings(spark.createDataFrame(ODD, DOCUMENT)).count()


def test_postings_of_odd_rows(spark, tmp_path):
    twice = [*ODD, ("a", "u", "b", "y", None, 0.0), ("c", "u", "y y", "", None, 0.0)]
    for n, (rows, stop_words, copy) in enumerate(((ODD, (), True), (twice, ("red", "y"), True), (twice, (), False), ([], (), True))):
        docs = documents(spark, rows)
        made = PostingsIndex(spark, f"file://{tmp_path}/{n}").write(docs, stop_words, copy)
        found = PostingsIndex(spark, made.root, None if copy else docs)
        assert rows_of(found.postings(TERMS)) == rows_of(positional_postings(docs, stop_words).where(F.col("term").isin(TERMS)))
        assert sorted(map(str, found.documents().collect())) == sorted(map(str, docs.collect()))
        sizes = lambda df: sorted((r.field, r.docs, r.total) for r in df.where("docs > 0").collect())
        assert sizes(found._fields()) == sizes(I.field_stats(docs, stop_words))


def test_a_repeated_id_is_one_document(spark, tmp_path):
    docs = spark.createDataFrame([("a", "u", "", "red blue", None, 0.0), ("b", "u", "", "red", None, 0.0), ("a", "u", "", "red", None, 0.0)], DOCUMENT).repartition(3)
    found = PostingsIndex(spark, f"file://{tmp_path}/x").write(docs)
    assert sorted(r.link_id for r in found.scores(["red"]).collect()) == ["a", "b"]
    assert [r.link_id for r in found.phrase(["red", "blue"]).collect()] == ["a"]


def test_a_phrase_is_found_by_number(spark, tmp_path):
    """Ids come to the documents that hold the phrase; before, all postings of its terms were shuffled with their ids."""
    docs = spark.createDataFrame([(f"{i}", "u", "red" if i % 2 else "of", "we read of the sea of" if i % 3 else "the of", None, 0.0) for i in range(12)], DOCUMENT).repartition(3)
    hits = PostingsIndex(spark, f"file://{tmp_path}/x").write(docs).phrase(["of", "the"])
    assert sorted(r.link_id for r in hits.collect()) == sorted(f"{i}" for i in range(12) if i % 3)
    dealt = [line for line in hits._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line and "field" in line]
    assert dealt and all("docno" in line and "link_id" not in line for line in dealt)


def test_parcels_hold_all_blocks(monkeypatch):
    rows = [(i // 4, i % 4 * 900, "" if i % 3 else f"t{i} same", " ".join(f"w{(i * j) % 7}" for j in range(i % 9))) for i in range(50)]
    want = expected(rows) | {("content", f"w{k}", 13, 0): (70_000, list(range(k, 70_000, 3))) for k in range(3)}
    rows.append((13, 0, "", " ".join(f"w{j % 3}" for j in range(70_000))))  # positions beyond two bytes
    for held, tasks, parts in ((K.HELD, 1, 1), (120, 3, 1), (30, 8, 2)):
        monkeypatch.setattr(K, "HELD", held)
        sent = list(K.parcels(iter([batch(rows[:20]), batch(rows[20:])]), 4, parts, tasks))
        assert all(0 <= t < tasks for s in sent for t in s["task"].to_pylist())
        out, of = {}, {}
        for s in sent:
            for task, *parcel in zip(*s.columns, strict=True):
                for b in K.unparcelled(iter([type(s).from_arrays([[p] for p in parcel], names=s.schema.names[1:])])):
                    for field, term, win, docs, tfs, lengths, positions in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        of.setdefault((term, win), set()).add(task.as_py())
                        for doc, tf, length in zip(docs, tfs, lengths, strict=True):
                            own, positions = positions[:tf], positions[tf:]
                            assert own[0] < 0 <= min(own[1:], default=0)
                            out[field, term, win, doc] = (length, [-1 - own[0], *own[1:]])
        assert out == want and all(len(t) == 1 for t in of.values())
    assert list(K.parcels(iter([]), 4, 1, 1)) == list(K.parcels(iter([batch([(0, 0, "", "")])]), 4, 1, 1)) == []
