from datetime import datetime, timedelta

import pytest

from strandline.errors import NotFound, StrandlineError, UnknownEdgeLinks
from strandline.functions import ids
from strandline.operators import graphstore as G
from strandline.schemas import EDGE, LAST_ID, LINK, NIL_ID

NOW = datetime(2024, 3, 1, 12)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_upsert_keeps_id_and_newest_time(spark):
    links = frame(spark, [], LINK)
    url = "https://example.com"
    seen = []
    for hours in (10, 0, 10):
        links = G.upsert_links(links, frame(spark, [(NIL_ID, url, NOW - timedelta(hours=hours))], LINK))
        (row,) = links.collect()
        seen.append(row)
    assert len({r.id for r in seen}) == 1 and seen[0].id != NIL_ID
    assert [r.retrieved_at for r in seen] == [NOW - timedelta(hours=10), NOW, NOW]


def test_find_missing(spark):
    with pytest.raises(NotFound):
        G.require_link(frame(spark, [], LINK), NIL_ID)


def test_time_filter_is_strict(spark):
    links = frame(spark, [(f"0000000{i}-0000-0000-0000-000000000000", f"u{i}", NOW + timedelta(hours=i)) for i in range(3)], LINK)
    for i in range(3):
        assert G.links_scan(links, NIL_ID, LAST_ID, NOW + timedelta(hours=i)).count() == i


@pytest.mark.parametrize("n", [1, 10, 11])
def test_partitions_are_disjoint_and_complete(spark, n):
    links = G.upsert_links(frame(spark, [], LINK), frame(spark, [(f"u{i}",) for i in range(100)], "url string"))
    scans = [G.links_scan(links, *ids.partition_extent(i, n), NOW) for i in range(n)]
    parts = [{r.id for r in s.collect()} for s in scans]
    assert sum(map(len, parts)) == len(set().union(*parts)) == 100
    labelled = {r.id: r.partition for r in G.partition_links(links, n).collect()}
    assert all(labelled[i] == k for k, part in enumerate(parts) for i in part)


def test_scan_filters_reach_parquet(spark, tmp_path):
    frame(spark, [("a", "u", NOW)], LINK).write.parquet(str(tmp_path / "links"))
    plan = G.links_scan(spark.read.parquet(str(tmp_path / "links")), "0", "f", NOW)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,0)" in plan and "LessThan(id,f)" in plan


def test_edges(spark):
    links = G.upsert_links(frame(spark, [], LINK), frame(spark, [("a",), ("b",)], "url string"))
    a, b = (r.id for r in links.orderBy("url").collect())
    pair = frame(spark, [(a, b)], "src string, dst string")
    first = G.upsert_edges(frame(spark, [], EDGE), pair, links, NOW)
    again = G.upsert_edges(first, pair, links, NOW + timedelta(hours=1))
    (x,), (y,) = first.collect(), again.collect()
    assert x.id == y.id and y.updated_at > x.updated_at
    bad = frame(spark, [(a, NIL_ID)], "src string, dst string")
    assert G.upsert_edges(first, bad, links, NOW).count() == 1
    assert G.unknown_edges(bad, links).count() == 1
    with pytest.raises(UnknownEdgeLinks):
        G.upsert_edges(first, bad, links, NOW, unknown="error")


def test_edges_belong_to_their_source(spark):
    src = "80000000-0000-0000-0000-000000000001"
    edges = frame(spark, [(f"e{i}", src, ids._uuid(i << 120), NOW) for i in range(100)], EDGE)
    counts = [G.edges_scan(edges, *ids.partition_extent(i, 4), NOW + timedelta(1)).count() for i in range(4)]
    assert counts == [0, 0, 100, 0]


def test_stale_edges(spark):
    old = [(f"o{i}", "s", f"d{i}", NOW) for i in range(100)]
    new = [(f"n{i}", "s", f"x{i}", NOW + timedelta(hours=2)) for i in range(100)]
    edges = frame(spark, [*old, *new, ("k", "other", "d", NOW)], EDGE)
    left = {r.id for r in G.remove_stale_edges(edges, "s", NOW + timedelta(hours=1)).collect()}
    assert left == {f"n{i}" for i in range(100)} | {"k"}
    cut = frame(spark, [("s", NOW + timedelta(hours=1))], "src string, updated_before timestamp")
    assert {r.id for r in G.remove_stale_edges_many(edges, cut).collect()} == left


def test_cascade(spark):
    links = frame(spark, [("a", "a", NOW), ("b", "b", NOW)], LINK)
    edges = frame(spark, [("1", "a", "b", NOW), ("2", "b", "b", NOW)], EDGE)
    kept, left = G.remove_links(links, edges, frame(spark, [("a",)], "id string"))
    assert [r.id for r in kept.collect()] == ["b"] and [r.id for r in left.collect()] == ["2"]


def test_ranges():
    zero = "0000-0000-0000-000000000000"
    assert ids.partition_bounds(4) == [f"40000000-{zero}", f"80000000-{zero}", f"c0000000-{zero}", LAST_ID]
    five, ten = "5" * 32, "a" * 32
    assert [b.replace("-", "") for b in ids.partition_bounds(3)] == [five, ten, "f" * 32]
    assert len(ids.partition_bounds(1000)) == 1000
    for bad in (lambda: ids.partition_bounds(0), lambda: ids.partition_bounds(2, LAST_ID, NIL_ID), lambda: ids.partition_extent(4, 4), lambda: ids.partition_extent(-1, 4)):
        with pytest.raises(StrandlineError):
            bad()


def test_graph_update_replaces_edges(spark):
    links = G.upsert_links(frame(spark, [], LINK), frame(spark, [("http://a/",), ("http://gone/",)], "url string"))
    by = {r.url: r.id for r in links.collect()}
    edges = frame(spark, [("e", by["http://a/"], by["http://gone/"], NOW), ("f", by["http://gone/"], by["http://a/"], NOW)], EDGE)
    crawled = frame(spark, [(by["http://a/"], "http://a/", ["http://b/"], ["http://c/"])], "id string, url string, links array<string>, no_follow_links array<string>")
    new_links, new_edges = G.graph_update(links, edges, crawled, NOW + timedelta(hours=1))
    urls = {r.id: r.url for r in new_links.collect()}
    assert set(urls.values()) == {"http://a/", "http://gone/", "http://b/", "http://c/"}
    assert {(urls[r.src], urls[r.dst]) for r in new_edges.collect()} == {("http://a/", "http://b/"), ("http://gone/", "http://a/")}
