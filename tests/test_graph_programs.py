import random

import pytest
from pyspark.sql import functions as F

from strandline.errors import InvalidMessageDestination, NegativeCost, StrandlineError, UnknownEdgeSource
from strandline.plans.pagerank import pagerank
from strandline.plans.pregel import GraphBuilder, Pregel
from strandline.plans.shortest_path import path_to, shortest_paths


def graph(spark, ids, edges):
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "src string, dst string")


GRAPHS = [
    ("AB BC CA", {"A": 1 / 3, "B": 1 / 3, "C": 1 / 3}, 2),
    ("AB BC CA CB", {"A": 0.214862, "B": 0.397227, "C": 0.387911}, 14),
    ("AB BA BC CB", {"A": 0.256659, "B": 0.486682, "C": 0.256659}, 42),
    ("AB BC", {"A": 0.184443, "B": 0.341096, "C": 0.474462}, 12),
]


@pytest.mark.parametrize(("edges", "expected", "steps"), GRAPHS)
def test_pagerank(spark, edges, expected, steps):
    v, e = graph(spark, sorted(expected), [tuple(x) for x in edges.split()])
    history = []
    got = {r.id: r.rank for r in pagerank(v, e, history=history).collect()}
    assert got == pytest.approx(expected, abs=1e-5)
    assert history[-1][0] == steps and sum(got.values()) == pytest.approx(1)


def test_pagerank_edges(spark):
    assert [tuple(r) for r in pagerank(*graph(spark, ["A"], [])).collect()] == [("A", 1.0)]
    assert pagerank(*graph(spark, [], [])).count() == 0
    v, e = graph(spark, ["A", "B"], [("A", "A"), ("A", "B"), ("B", "A"), ("X", "A"), ("A", "X")])
    assert {r.id: r.rank for r in pagerank(v, e).collect()} == pytest.approx({"A": 0.5, "B": 0.5})
    for bad in ({"damping": -0.1}, {"damping": 1.1}, {"min_change": -1}, {"min_change": 1}):
        with pytest.raises(StrandlineError):
            pagerank(v, e, **bad)


def test_pagerank_random(spark):
    rng = random.Random(42)
    ids = [str(i) for i in range(40)]
    edges = [(a, rng.choice(ids)) for a in ids for _ in range(rng.randrange(4))]
    used = [(a, b) for a, b in edges if a != b]
    out = {a: sum(x == a for x, _ in used) for a in ids}
    rank = dict.fromkeys(ids, 1 / 40)
    for _ in range(5):
        lost = sum(rank[a] for a in ids if not out[a])
        rank = {b: 0.15 / 40 + 0.85 * (sum(rank[x] / out[x] for x, y in used if y == b) + lost / 40) for b in ids}
    assert {r.id: r.rank for r in pagerank(*graph(spark, ids, edges), max_steps=6).collect()} == pytest.approx(rank)


PAIRS = {(0, 1): 4, (0, 7): 8, (1, 2): 8, (1, 7): 11, (2, 3): 7, (2, 5): 4, (2, 8): 2, (3, 4): 9, (4, 5): 10, (5, 6): 2, (6, 7): 1, (6, 8): 6, (7, 8): 7}
EDGES = [(str(a), str(b), c) for (a, b), c in PAIRS.items()] + [(str(b), str(a), c) for (a, b), c in PAIRS.items()] + [("3", "5", 14), ("6", "3", 14)]
PATHS = {0: (0, "0"), 1: (4, "01"), 2: (12, "012"), 3: (19, "0123"), 4: (21, "07654"), 5: (11, "0765"), 6: (9, "076"), 7: (8, "07"), 8: (14, "0128")}


def test_shortest_paths(spark):
    v = spark.createDataFrame([(str(i),) for i in range(10)], "id string")
    e = spark.createDataFrame(EDGES, "src string, dst string, cost long")
    paths = shortest_paths(v, e, "0")
    got = {r.id: (r.cost, "".join(r.path or [])) for r in paths.collect()}
    assert got == {str(k): p for k, p in PATHS.items()} | {"9": (None, "")}
    assert path_to(paths, "4").first().path == ["0", "7", "6", "5", "4"]
    with pytest.raises(NegativeCost):
        shortest_paths(v, spark.createDataFrame([("0", "1", -1)], "src string, dst string, cost long"), "0")
    assert shortest_paths(v.limit(0), e, "0").count() == 0
    loop = spark.createDataFrame([("0", "1", 0), ("1", "0", 0), ("1", "2", 0), ("2", "1", 0)], "src string, dst string, cost long")
    assert {r.id: r.cost for r in shortest_paths(v, loop, "0").collect()}["2"] == 0


def vertices(spark, rows):
    return spark.createDataFrame(rows, "id string, value long")


def test_exchange_and_broadcast(spark):
    v = vertices(spark, [("a", 42), ("b", 42)])
    _, e = graph(spark, [], [("a", "b"), ("b", "a")])
    p = Pregel(lambda value, mail, s: (F.coalesce(mail, F.lit(0)).cast("long") if s else value, F.lit(False)), send=lambda value, edge, s: value)
    assert {r.value for r in p.run(v, e, steps=2).vertices.collect()} == {42}
    v = vertices(spark, [("0", 42), ("1", 0), ("2", 0), ("3", 0)])
    _, e = graph(spark, [], [("0", "1"), ("0", "2"), ("0", "3")])
    p = Pregel(lambda value, mail, s: (F.coalesce(mail, value).cast("long"), F.lit(False)), send=lambda value, edge, s: value)
    found = p.run(v, e)
    assert {r.value for r in found.vertices.collect()} == {42}
    assert [s.active for s in found.steps] == [4, 3]


def test_aggregators_and_hooks(spark):
    v = vertices(spark, [(str(i), i) for i in range(1000)])
    _, e = graph(spark, [], [])
    calls = []
    p = Pregel(lambda value, mail, s: (value, F.lit(True)), aggregators={"n": F.count_if("computed"), "sum": F.sum("value")}, presets={"n": 5}, pre_step=calls.append, post_step=calls.append, keep_running=lambda s: s.superstep < 1)
    found = p.run(v, e)
    assert [s.aggregates["n"] for s in found.steps] == [1005, 2005] and found.deltas("n") == [1005, 1000]
    assert calls[0] == 0 and calls[1].aggregates["sum"] == 499500 and len(found.steps) == 2
    reset = Pregel(lambda value, mail, s: (value, F.lit(True)), aggregators={"n": F.count_if("computed")}, accumulate=False).run(v, e, steps=2)
    assert [s.aggregates["n"] for s in reset.steps] == [1000, 1000]


def test_pregel_errors(spark):
    v = vertices(spark, [("a", 1)])
    for edge, error in ((("x", "a"), UnknownEdgeSource), (("a", "x"), InvalidMessageDestination)):
        with pytest.raises(error):
            Pregel(lambda value, mail, s: (value, F.lit(False))).run(v, graph(spark, [], [edge])[1])
    out = Pregel(lambda value, mail, s: (value, F.lit(False)), send=lambda value, edge, s: value, unknown_dst="drop").run(v, graph(spark, [], [("a", "x")])[1])
    assert len(out.steps) == 1
    with pytest.raises(StrandlineError):
        Pregel(None)
    with pytest.raises(StrandlineError):
        Pregel(lambda *a: a, unknown_dst="relay")
    failing = Pregel(lambda value, mail, s: (F.when(F.col("id") == "a", F.raise_error(F.lit("vertex a failed")).cast("long")).otherwise(value), F.lit(False)))
    with pytest.raises(Exception, match="vertex a failed"):
        failing.run(v, graph(spark, [], [])[1])


def test_graph_builder(spark):
    g = GraphBuilder().add_vertices(vertices(spark, [("a", 1), ("b", 9)])).add_edges(graph(spark, [], [("a", "b")])[1]).add_vertices(vertices(spark, [("b", 2)])).add_edges(graph(spark, [], [("a", "b")])[1])
    v, e = g.frames()
    assert {r.id: r.value for r in v.collect()} == {"a": 1, "b": 2}
    got = Pregel(lambda value, mail, s: (value if s == 0 else F.coalesce(mail, F.lit(0)).cast("long"), F.lit(False)), send=lambda value, edge, s: value).run(v, e, steps=2)
    assert {r.id: r.value for r in got.vertices.collect()} == {"a": 1, "b": 2}
    g.reset()
    with pytest.raises(StrandlineError):
        g.frames()


def test_superstep_shuffles_shares_only(spark, monkeypatch):
    """Edges and ranks are stored in buckets of what they are joined on, four supersteps are one job, and older ranks are gone."""
    from strandline import shared

    plans, made = [], []
    put = shared.Tables.put

    def spied(self, df, key, deal=True):
        if not deal:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        made.append(self)
        return put(self, df, key, deal)

    monkeypatch.setattr(shared.Tables, "put", spied)
    v, e = graph(spark, [str(i) for i in range(30)], [(str(i), str(i * 7 % 30)) for i in range(1, 30)])
    history = []
    ranks = pagerank(v, e, max_steps=5, history=history)
    shuffles = [line for line in plans[-1].splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert len(shuffles) == 4 and [step for step, _ in history] == [1, 2, 3, 4, 5]
    assert len(made[-1].paths) == 1
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1)
    before = len(plans)
    pagerank(v, e, max_steps=9)
    assert len(plans) - before == len(shuffles) + 2  # tables of the start, and two blocks instead of eight supersteps


def test_blocks_of_supersteps_end_anywhere(spark):
    """The ranks of every superstep, whatever block it lies in, against the formula."""
    rnd = random.Random(8)
    names = [str(i) for i in range(25)]
    pairs = [(rnd.choice(names), rnd.choice(names[:15])) for _ in range(60)]  # repeated edges, loops and dangling vertices
    v, e = graph(spark, names, pairs)
    kept = [(a, b) for a, b in pairs if a != b]
    out = {x: [b for a, b in kept if a == x] for x in names}
    rank = {x: 1 / 25 for x in names}
    for step in range(2, 8):
        lost = sum(r for x, r in rank.items() if not out[x])
        rank = {x: 0.15 / 25 + 0.85 * (lost / 25 + sum(rank[a] / len(out[a]) * out[a].count(x) for a in names if x in out[a])) for x in names}
        if step in (2, 4, 5, 7):
            got = {r.id: r.rank for r in pagerank(v, e, max_steps=step).collect()}
            assert got == pytest.approx(rank)


def test_paths_without_cost(spark):
    v = spark.createDataFrame([(x,) for x in "sabcd"], "id string")
    e = spark.createDataFrame([("s", "c", 2), ("c", "a", 0), ("a", "b", 0), ("b", "a", 0), ("b", "d", 0), ("a", "c", 0)], "src string, dst string, cost long")
    got = {r.id: (r.cost, "".join(r.path)) for r in shortest_paths(v, e, "s").collect()}
    assert got == {"s": (0, "s"), "c": (2, "sc"), "a": (2, "sca"), "b": (2, "scab"), "d": (2, "scabd")}
