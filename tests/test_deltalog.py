import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.errors import CommitConflict, StrandlineError, UnknownEdgeLinks
from strandline.functions import ids
from strandline.plans.services import CrawlService
from strandline.schemas import LINK
from strandline.shared import file_system
from strandline.sources import deltalog as D
from strandline.sources.stores import GRAPH_TABLES, KINDS, JdbcStore, open_graph, open_index

NOW = datetime(2024, 5, 1)


def key(i):
    return f"{i % 256:02x}{i:06x}-0000-0000-0000-000000000000"


def links(spark, numbers, day=1):
    return spark.createDataFrame([(key(i), f"http://x/{i}", datetime(2024, 1, 1) + timedelta(days=day - 1)) for i in numbers], LINK)


def found(df):
    return {r.id: (r.retrieved_at - datetime(2024, 1, 1)).days + 1 for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return lambda **options: D.DeltaTable(spark, f"file://{tmp_path}/t", KINDS["links"], **{"ranges": 4, "compact_at": 100, **options})


def test_commits_merge_by_key(spark, table):
    t = table()
    assert t.read().count() == 0 and t.append(links(spark, [])) == -1
    assert [t.append(links(spark, n, d)) for n, d in ((range(8), 2), (range(4, 12), 1), (range(6), 3))] == [0, 1, 2]
    want = {key(i): 3 if i < 6 else 2 if i < 8 else 1 for i in range(12)}
    assert found(t.read()) == want
    assert found(t.read(version=0)) == {key(i): 2 for i in range(8)}
    assert t.changes(0, 1).count() == 8 and {r._v for r in t.changes(0).collect()} == {1, 2}


def test_writers_at_once_keep_each_others_rows(spark, table):
    errors = []

    def write(k):
        try:
            for j in range(3):
                table().append(links(spark, [100 * k + j, 7], 1 + k))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t = table()
    assert not errors and t.versions() == list(range(12))
    assert found(t.read()) == {**{key(100 * k + j): 1 + k for k in range(4) for j in range(3)}, key(7): 4}


def test_an_id_range_opens_its_own_folders(spark, table):
    t = table()
    for n in (range(0, 256, 3), range(1, 256, 5)):
        t.append(links(spark, n))
    lo, hi = "40000000-0000-0000-0000-000000000000", "80000000-0000-0000-0000-000000000000"
    part = t.read(lo, hi)
    assert {r.id for r in part.collect()} == {i for i in found(t.read()) if lo <= i < hi}
    folders = {f.split("/r=")[1].split("/")[0] for f in part.inputFiles()}
    assert folders == {"1", "2"}  # hi itself begins the next range
    assert {f.split("/r=")[1].split("/")[0] for f in t.read(keys=[key(0)]).inputFiles()} == {"0"}


def test_an_aborted_write_leaves_nothing(spark, table):
    t = table()
    t.append(links(spark, range(3)))
    bad = links(spark, range(9)).withColumn("url", F.when(F.col("id") == key(5), F.raise_error(F.lit("lost on the way"))).otherwise(F.col("url")))
    for write in (t.append, t.replace):
        with pytest.raises(Exception, match="lost on the way"):
            write(bad)
    files, at = file_system(spark, f"{t.root}/data")
    assert len(t.versions()) == 1 and len(files.listStatus(at)) == 1 and len(found(t.read())) == 3


def test_compaction_beside_writers(spark, table):
    t = table()
    for k in range(3):
        t.append(links(spark, range(k, 40, 2), 1 + k))
    before = found(t.read())
    state = t.state()
    drafted = t._put(t.kind.merge(t._scan(state.parts, {0})))
    late = t.append(links(spark, [1, 200], 9))  # after the compaction read, before it commits
    t._commit_base(drafted, state.version, {0})
    assert found(t.read()) == {**before, key(1): 9, key(200): 9}
    assert t.read(version=late).count() == len(before) + 1
    # the range is read from the compaction and the late commit alone
    assert len({f.split("txn=")[1].split("/")[0] for f in t.read(hi="10000000").inputFiles()}) == 2
    with pytest.raises(CommitConflict):
        t._commit_base(t._put(links(spark, [0])), state.version, {0, 1})
    assert t.compact({0, 1, 2, 3}) is not None and found(t.read()) == {**before, key(1): 9, key(200): 9}
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # merged already


def test_replacement_keeps_later_commits(spark, table, monkeypatch):
    t = table()
    t.append(links(spark, range(5)))
    put = t._put

    def slow(df, flag=None):
        drafted = put(df, flag)
        table().append(links(spark, [50], 5))
        return drafted

    monkeypatch.setattr(t, "_put", slow)
    t.replace(t.read().where(F.col("id") < key(3)))
    assert found(t.read()) == {**{key(i): 1 for i in range(3)}, key(50): 5}


def test_long_logs(spark, table):
    """Whole states in between, compactions by themselves and removal of what no recent version reads."""
    t = table(compact_at=4)
    want = {}
    for k in range(30):
        n = random.Random(k).sample(range(60), 6)
        t.append(links(spark, n, 1 + k))
        want |= {key(i): 1 + k for i in n}
    assert found(t.read()) == want
    versions = t.versions()
    assert versions[-1] > 24 and versions[0] > 0 and max(len([p for p in t.state().parts if r in p.ranges]) for r in range(4)) < 5
    files, at = file_system(spark, f"{t.root}/data")
    assert len(files.listStatus(at)) < len(range(versions[-1]))
    assert set(found(t.read(version=versions[-1] - D.KEPT))) <= set(want)  # the oldest version kept can still be read
    assert t.changes(versions[-1] - D.KEPT).count() > 0
    with pytest.raises(StrandlineError, match="no longer"):
        t.changes(0)


PAGES = {f"http://site{i}.example.com/": "".join(f'<a href="http://site{j}.example.com/">x</a>' for j in range(12) if j != i and (i * j) % 3 == 1) + f'<a href="/own{i}">y</a>' for i in range(12)}


@pytest.fixture(params=["parquet", "jdbc"])
def graph(request, spark, tmp_path):
    if request.param == "parquet":
        return lambda: open_graph(spark, f"parquet:{tmp_path}/g")
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    make = lambda: JdbcStore(spark, GRAPH_TABLES, f"derby:{tmp_path}/db;create=true", partitions=2, options=options)
    try:
        make().transact(
            [
                "CREATE TABLE links (id VARCHAR(36) PRIMARY KEY, url VARCHAR(200) UNIQUE NOT NULL, retrieved_at TIMESTAMP NOT NULL)",
                "CREATE TABLE edges (id VARCHAR(36) PRIMARY KEY, src VARCHAR(36) NOT NULL REFERENCES links(id), dst VARCHAR(36) NOT NULL REFERENCES links(id), updated_at TIMESTAMP NOT NULL)",
            ]
        )
    except Exception as error:  # noqa: BLE001
        pytest.skip(f"no database here: {error}")
    return make


def test_passes_of_two_replicas_that_overlap(spark, tmp_path, graph):
    """The second replica's whole pass runs while the first one fetches; both passes' links, edges and documents stay."""
    docs = lambda: open_index(spark, f"parquet:{tmp_path}/d")
    pages = spark.createDataFrame(list(PAGES.items()), "url string, html string")
    graph().upsert_links(pages.select("url"))
    make = lambda i, fetch: CrawlService(graph(), docs(), fetch, timedelta(minutes=5), timedelta(days=7), partition=lambda: (i, 2), clock=lambda: NOW)
    counts = []

    def slowly(due):
        counts.append(make(1, lambda due: pages).run_once())
        graph().upsert_links(spark.createDataFrame([("http://submitted.example.com/",)], "url string"))
        return pages

    counts.append(make(0, slowly).run_once())
    assert sum(counts) == 12 and all(counts)
    urls = {r.id: r.url for r in graph().read("links").collect()}
    assert set(urls.values()) == {*PAGES, *(f"http://site{i}.example.com/own{i}" for i in range(12)), "http://submitted.example.com/"}
    edges = {(urls[r.src], urls[r.dst]) for r in graph().read("edges").collect()}
    own = {(f"http://site{i}.example.com/", f"http://site{i}.example.com/own{i}") for i in range(12)}
    assert edges == own | {(f"http://site{i}.example.com/", f"http://site{j}.example.com/") for i in range(12) for j in range(12) if i != j and (i * j) % 3 == 1}
    assert docs().read("documents").count() == 12
    # a later pass over pages that have lost their links takes the older edges away
    bare = pages.withColumn("html", F.lit('<a href="/own">y</a>'))
    later = CrawlService(graph(), docs(), lambda due: bare, timedelta(minutes=5), timedelta(days=7), clock=lambda: NOW + timedelta(days=8))
    assert later.run_once() == 12 and graph().read("edges").count() == 12


def test_edges_of_a_source_that_is_crawled_again(spark, tmp_path):
    store = open_graph(spark, f"parquet:{tmp_path}/g")
    a, b, c = (ids._uuid(i << 120) for i in (1, 2, 3))
    pairs = lambda *p: spark.createDataFrame(list(p), "src string, dst string")
    cut = lambda day: spark.createDataFrame([(a, datetime(2024, 1, day))], "src string, updated_before timestamp")
    store.upsert_edges(pairs((a, b), (a, c), (b, c)), datetime(2024, 1, 1))
    store.upsert_edges(pairs((a, c)), datetime(2024, 1, 3), cut(3))
    seen = lambda: {(r.src, r.dst, r.updated_at.day) for r in store.read("edges").collect()}
    assert seen() == {(a, c, 3), (b, c, 1)}
    store.log("edges").compact({0, 1, 2})
    store.upsert_edges(pairs((a, b)), datetime(2024, 1, 2))  # from a pass that began before the cut
    assert seen() == {(a, c, 3), (b, c, 1)}
    store.upsert_edges(pairs((a, b)), datetime(2024, 1, 4))
    assert seen() == {(a, b, 4), (a, c, 3), (b, c, 1)}


def test_edges_with_unknown_ends(spark, tmp_path):
    store = open_graph(spark, f"parquet:{tmp_path}/g")
    store.write("links", links(spark, [1, 2]))
    pairs = spark.createDataFrame([(key(1), key(2)), (key(1), key(3))], "src string, dst string")
    with pytest.raises(UnknownEdgeLinks):
        store.upsert_edges(pairs, NOW, unknown="error")
    assert store.read("edges").count() == 0
    store.upsert_edges(pairs, NOW, unknown="drop")
    assert [(r.src, r.dst) for r in store.read("edges").collect()] == [(key(1), key(2))]


def test_ids_of_another_store_stay(spark, tmp_path):
    store = open_graph(spark, f"parquet:{tmp_path}/g")
    store.write("links", links(spark, [1]))
    store.upsert_links(spark.createDataFrame([("http://x/1",), ("http://x/2",)], "url string").withColumn("retrieved_at", F.lit(datetime(2024, 1, 5))))
    assert {(r.id, r.url) for r in store.read("links").collect()} == {(key(1), "http://x/1"), (spark.sql("select 'http://x/2' u").select(ids.link_id(F.col("u"))).first()[0], "http://x/2")}


def test_documents_and_scores(spark, tmp_path):
    store = open_index(spark, f"parquet:{tmp_path}/d")
    text = lambda i, title, day: spark.createDataFrame([(key(i), "u", title, None, datetime(2024, 1, day))], "link_id string, url string, title string, content string, indexed_at timestamp")
    score = lambda i, s: spark.createDataFrame([(key(i), s)], "link_id string, score double")
    store.put_documents(text(1, "first", 5))
    store.put_scores(score(1, 0.5))
    store.put_documents(text(1, "second", 4))  # the later commit, whatever its time
    store.put_scores(score(2, 0.25))
    assert {(r.link_id, r.title, r.pagerank, r.indexed_at.year) for r in store.read("documents").collect()} == {(key(1), "second", 0.5, 2024), (key(2), "", 0.25, 1)}
    store.write("documents", store.read("documents").withColumn("indexed_at", F.lit(None).cast("timestamp")).withColumn("pagerank", F.lit(None).cast("double")))
    assert {(r.link_id, r.title, r.pagerank, r.indexed_at.year) for r in store.read("documents").collect()} == {(key(1), "second", 0.0, 1), (key(2), "", 0.0, 1)}
    store.reset()
    assert store.read("documents").count() == 0
