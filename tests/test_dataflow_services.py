from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.errors import NoPartitionData, StrandlineError
from strandline.functions import ids
from strandline.operators import crawl, graphstore
from strandline.plans import dataflow as D
from strandline.plans.services import CrawlService, RankService, ServiceGroup, fixed_partition, host_partition
from strandline.schemas import LINK
from strandline.sources.stores import open_graph, open_index

NOW = datetime(2024, 5, 1)


def test_flow_in_order(spark):
    out = []
    count = D.processors(*[lambda r: r for _ in range(10)]).process(spark.range(3).coalesce(1), D.collect_into(out))
    assert [r.id for r in out] == [0, 1, 2] and count == 3


def test_drop_and_discard(spark):
    assert D.processors(lambda r: None).process(spark.range(5), D.discard) == 0


def test_errors_reach_the_caller(spark):
    def fail(row):
        raise ValueError("stage 5 failed")

    with pytest.raises(Exception, match="stage 5 failed"):
        D.processors(*[lambda r: r] * 4, fail).process(spark.range(3), D.discard)
    bad_source = spark.range(3).select(F.raise_error(F.lit("source failed")).cast("long").alias("id"))
    with pytest.raises(Exception, match="source failed"):
        D.Pipeline().process(bad_source, D.discard)

    def sink(df):
        raise OSError("sink failed")

    with pytest.raises(OSError, match="sink failed"):
        D.Pipeline().process(spark.range(3), sink)


def test_pools_and_broadcast(spark):
    def bigger(row):
        return {"id": row["id"] + 100}

    assert {r.id for r in D.Pipeline(D.fixed_pool(D.rows(bigger), 3)).plan(spark.range(5)).collect()} == set(range(100, 105))
    assert D.Pipeline(D.dynamic_pool(D.rows(bigger), 2)).plan(spark.range(5)).count() == 5
    both = D.Pipeline(D.broadcast(D.rows(bigger), lambda df: df)).plan(spark.range(2))
    assert sorted(r.id for r in both.collect()) == [0, 1, 100, 101]
    for bad in (lambda: D.fixed_pool(D.rows(bigger), 0), lambda: D.dynamic_pool(D.rows(bigger), 0), D.broadcast):
        with pytest.raises(StrandlineError):
            bad()


PAGES = {"http://a.example.com/": '<title>A</title><a href="http://b.example.com/">b</a>', "http://b.example.com/": '<title>B</title><a href="http://a.example.com/">a</a>'}


def test_crawl_then_rank(spark, tmp_path):
    graph, docs = open_graph(spark, f"parquet:{tmp_path}/g"), open_index(spark, f"parquet:{tmp_path}/d")
    pages = spark.createDataFrame(list(PAGES.items()), "url string, html string")
    graph.write("links", graphstore.upsert_links(spark.createDataFrame([], LINK), spark.createDataFrame([(u,) for u in PAGES], "url string")))
    crawler = CrawlService(graph, docs, lambda due: pages, timedelta(minutes=5), timedelta(days=7), clock=lambda: NOW)
    assert crawler.run_once() == 2
    assert crawler.run_once() == 0  # nothing is due again
    ranker = RankService(graph, docs, timedelta(hours=1), clock=lambda: NOW + timedelta(hours=1))
    assert ranker.run_once() == 2
    found = {r.url: (r.title, round(r.pagerank, 6)) for r in docs.read("documents").collect()}
    assert found == {"http://a.example.com/": ("A", 0.5), "http://b.example.com/": ("B", 0.5)}
    assert RankService(graph, docs, timedelta(hours=1), partition=lambda: (1, 2)).run_once() == 0
    with pytest.raises(NoPartitionData):
        RankService(graph, docs, timedelta(hours=1), partition=lambda: None).run_once()
    mine = ids.partition_of(graph.read("links").first().id, 2)
    split = CrawlService(graph, docs, lambda due: pages, timedelta(minutes=5), timedelta(0, 1), partition=lambda: (mine, 2), clock=lambda: NOW + timedelta(days=30))
    assert 1 <= split.run_once() <= 2


def test_settings(spark):
    with pytest.raises(StrandlineError, match="graph"):
        CrawlService()
    with pytest.raises(StrandlineError, match="interval"):
        RankService(open_graph(spark, "in-memory:"), open_index(spark, "in-memory:"), timedelta(0))


def test_group_stops_at_the_first_error():
    class Fails:
        name, interval = "bad", timedelta(milliseconds=5)

        def run_once(self):
            raise ValueError("broken")

    class Waits:
        name, interval = "good", timedelta(milliseconds=5)

        def run_once(self):
            raise NoPartitionData

    with pytest.raises(ExceptionGroup) as caught:
        ServiceGroup(Fails(), Waits()).run()
    assert "bad: broken" in str(caught.value.exceptions[0])


def test_partition_of_a_replica():
    assert fixed_partition(1, 3)() == (1, 3)
    assert host_partition(lambda: 4, lambda: "crawler-2")() == (2, 4)

    def unknown():
        raise OSError("no such record")

    for count in (unknown, lambda: 2):
        with pytest.raises(NoPartitionData):
            host_partition(count, lambda: "crawler-2")()
    with pytest.raises(StrandlineError, match="number"):
        host_partition(lambda: 4, lambda: "laptop")()


def test_a_live_crawl_from_an_empty_store(spark, tmp_path):
    """Submitted links, never fetched before, of which private hosts and other files are not asked for at all."""
    asked = str(tmp_path / "asked")
    graph, docs = open_graph(spark, "in-memory:"), open_index(spark, "in-memory:")
    refused = ["http://10.0.0.1/admin", "http://localhost/secret", "http://169.254.169.254/latest", "http://a.example.com/pic.JPG", "http://inside.example.com/", "http://unknown.example.com/", "http://[::1]/"]
    graph.upsert_links(spark.createDataFrame([(u,) for u in [*PAGES, *refused]], "url string"))
    known = {"a.example.com": "9.9.9.9", "b.example.com": "9.9.9.8", "inside.example.com": "192.168.1.1", "localhost": "127.0.0.1"}
    pages = dict(PAGES)

    def get(url):
        with open(asked, "a") as f:
            f.write(url + "\n")
        return 200, "text/html", pages[url]

    def addresses(host):
        return [known[host]] if host in known else []

    crawler = CrawlService(graph, docs, lambda due: crawl.fetch_live(due, get, addresses).drop("id"), timedelta(minutes=5), timedelta(days=7), clock=lambda: NOW)
    assert crawler.run_once() == 2
    assert set(open(asked).read().split()) == set(PAGES)
    assert {r.title for r in docs.read("documents").collect()} == {"A", "B"}
    # with a table of hosts the links are judged before they reach the fetcher
    seen = []
    hosts = spark.createDataFrame(list(known.items()), "host string, ip string")
    frame = spark.createDataFrame(list(PAGES.items()), "url string, html string")
    other = open_graph(spark, "in-memory:")
    other.upsert_links(spark.createDataFrame([(u,) for u in [*PAGES, *refused]], "url string"))
    assert CrawlService(other, docs, lambda due: seen.extend(r.url for r in due.collect()) or frame, timedelta(minutes=5), timedelta(days=7), hosts=hosts, clock=lambda: NOW).run_once() == 2
    assert set(seen) == set(PAGES)


def test_static_plans_leave_the_session_alone(spark):
    import threading

    from strandline.shared import Tables

    key = "spark.sql.adaptive.enabled"
    spark.conf.set(key, "true")
    seen = []

    def steps():
        tables = Tables(spark)
        for _ in range(2):
            df = tables.put(spark.range(20).withColumnRenamed("id", "k"), "k")
            df = tables.put(df.groupBy("k").count(), "k", deal=False)
            seen.append((spark.conf.get(key), df.count()))
            tables.drop(df)

    threads = [threading.Thread(target=steps) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == [("true", 20)] * 4 and spark.conf.get(key) == "true"
