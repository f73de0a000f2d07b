import datetime as dt

from pyspark.sql import functions as F

from strandline.sources import stores
from strandline.sources.stores import open_index

DAY = dt.datetime(2024, 1, 1)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange " in line and "content" in plan]


def written(monkeypatch, store):
    """What the log of the documents is given to write."""
    frames, put = [], type(store.log("documents"))._put

    def seen(self, df, flag=None, dealt=False):
        frames.append((df, dealt))
        return put(self, df, flag, dealt)

    monkeypatch.setattr(type(store.log("documents")), "_put", seen)
    return frames


def test_a_commit_and_a_compaction_deal_texts_once(spark, tmp_path, monkeypatch):
    store = open_index(spark, f"index:{tmp_path}")
    frames = written(monkeypatch, store)
    ids = [f"{i:x}0000000-0000-0000-0000-{i + 1:012x}" for i in range(16)]
    docs = spark.createDataFrame([(i, "u", f"t{n}", "some words", DAY + dt.timedelta(n)) for n, i in enumerate(ids)], "link_id string, url string, title string, content string, indexed_at timestamp")
    store.put_documents(docs.union(docs.withColumn("title", F.lit("newer")).withColumn("indexed_at", F.lit(DAY + dt.timedelta(99)))))
    store.put_documents(docs.limit(0))
    store.put_documents(docs.where(F.col("link_id") < "2").withColumn("indexed_at", F.lit(DAY)))
    store.log("documents").compact(set(range(stores.DeltaTable(spark, str(tmp_path / "x"), stores.KINDS["documents"]).ranges)))
    assert [dealt for _, dealt in frames] == [True] * 4 and all(len(exchanges(df)) == 1 for df, _ in (frames[0], frames[3]))
    found = {r.link_id: r.title for r in store.read("documents").collect()}
    assert found == {i: "t%d" % n if i < "2" else "newer" for n, i in enumerate(ids)}
    # a replaced text, a new one, a score of a known and of an unknown document, all at once
    store.search_index()
    store.put_documents(docs.where(F.col("link_id") == ids[3]).withColumn("content", F.lit("rare")))
    store.put_scores(spark.createDataFrame([(ids[3], 0.5), (ids[4], 0.25), ("f" * 8 + ids[4][8:], 0.75)], "link_id string, score double"))
    stored = store.search_index()
    assert {r.link_id for r in stored.scores(["rare"]).collect()} == {ids[3]}
    assert {r.link_id: r.pagerank for r in stored.pageranks().collect()} == dict.fromkeys(ids, 0.0) | {ids[3]: 0.5, ids[4]: 0.25, "f" * 8 + ids[4][8:]: 0.75}
