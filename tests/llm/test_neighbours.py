import heapq

import numpy as np
import pytest

from strandline.llm import neighbours as A

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, leaf string, query_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=20):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            out[i] = sorted((-float((v * q).sum()), j) for j, v in good if j != i)[:k]
    return out


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    return [(i, (centres[rng.integers(12)] + 0.4 * rng.normal(size=8)).tolist()) for i in range(n)]


def recall(got, want):
    return np.mean([len({r.vec_id for r in got if r.query_id == q} & {j for _, j in best}) / len(best) for q, best in want.items()])


def test_recall_with_a_deep_tree(spark, monkeypatch):
    for name, value in (("LEAF_ROWS", 16), ("BLOCK_ROWS", 40), ("PROBES", 60), ("QUERY_ROWS", 5)):
        monkeypatch.setattr(A, name, value)
    rows = vectors(1500)
    got, want = A.search(frame(spark, rows)).collect(), brute(rows)
    assert len(got) == 20 * len(want) and recall(got, want) >= 0.9
    exact = {(i, j): -s for i, best in want.items() for s, j in best}
    for r in got:
        assert (r.query_id, r.vec_id) not in exact or r.score == pytest.approx(exact[r.query_id, r.vec_id], abs=1e-12)
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)


def test_ties_and_bad_rows(spark):
    rows = vectors(30) + [(100 + i, [1.0] * 8) for i in range(60)]
    rows += [(200, None), (220, []), (240, [0.0] * 8), (260, [float("nan")] * 8), (280, [1.0, None] * 4), (300, [float("inf")] + [1.0] * 7), (320, [1.0] * 4), (None, [1.0] * 8)]
    got = A.search(frame(spark, rows)).collect()
    want = brute(rows)
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(q, n + 1, j) for q, best in want.items() for n, (_, j) in enumerate(best)}


def test_few_and_empty(spark):
    rows = vectors(5)
    got = A.search(frame(spark, rows)).collect()
    assert len(got) == 4 and {r.query_id for r in got} == {0}
    assert A.search(frame(spark, rows[1:])).collect() == []
    assert A.search(frame(spark, rows).limit(0)).collect() == []
    assert len(A.search(frame(spark, [*rows, rows[0], rows[1]])).collect()) == 5


def test_given_queries(spark):
    rows = vectors(200)
    asked = spark.createDataFrame([(7, rows[7][1])], "vec_id long, embedding array<float>")
    got = A.search(frame(spark, rows), asked, k=3).collect()
    assert {r.query_id for r in got} == {7} and len(got) == 3 and all(r.vec_id != 7 for r in got)


def test_tree_visits_every_leaf_once():
    x = np.array([v for _, v in vectors(600)])
    tree = A.grow(x, 40)
    assert sorted(tree.visits(x[0], tree.leaves)) == list(range(tree.leaves)) and set(tree.file(x)) <= set(range(tree.leaves))
    same = A.grow(np.ones((50, 8)), 10)
    assert same.leaves == 1 and set(same.file(np.ones((5, 8)))) == {0}


def queue_order(tree, query):
    """Leaves as they come off a priority queue of branches."""
    found, queue = [], [(0.0, 0)]
    while queue:
        _, node = heapq.heappop(queue)
        if node < 0:
            found.append(-1 - node)
        else:
            for gain, child in zip((tree.centres[node] @ query).tolist(), tree.children[node], strict=True):
                heapq.heappush(queue, (-gain, child))
    return found


def test_turns_are_those_of_a_queue():
    x = np.array([v for _, v in vectors(900, seed=4)])
    tree = A.grow(x, 120, branches=3)
    turn = tree.ranks(x[:40])
    for i in range(40):
        assert np.argsort(turn[i]).tolist() == queue_order(tree, x[i])


def shuffled(spark):
    """Records written to exchanges, by stage."""
    gateway = spark.sparkContext._gateway
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}


def test_visits_do_not_copy_rows_or_queries(spark, monkeypatch):
    for name, value in (("LEAF_ROWS", 8), ("PROBES", 40)):
        monkeypatch.setattr(A, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(3000, 8)).tolist())]
    before = shuffled(spark)
    got, want = A.search(frame(spark, rows)).collect(), brute(rows)
    sent = {k: n for k, n in shuffled(spark).items() if k not in before}
    assert recall(got, want) >= 0.9
    # the frame's own repartition, the write of leaves, and lists of the best: no stage sends more than the rows or what the queries find
    assert max(sent.values()) <= 3000 and sum(sent.values()) < 4 * 3000


def test_leaves_in_parts_and_chunks_of_queries(spark, monkeypatch):
    for name, value in (("LEAF_ROWS", 16), ("BLOCK_ROWS", 17), ("QUERY_ROWS", 7), ("QUERY_TILE", 3), ("PENDING", 10), ("MAX_LEAVES", 4)):
        monkeypatch.setattr(A, name, value)
    rows = vectors(1200, seed=9)
    got, want = A.search(frame(spark, rows), target=1.1).collect(), brute(rows)  # a recall out of reach: all leaves
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(q, n + 1, j) for q, best in want.items() for n, (_, j) in enumerate(best)}


def test_many_equal_vectors_and_repeated_ids(spark, monkeypatch):
    for name, value in (("LEAF_ROWS", 40), ("BLOCK_ROWS", 90)):
        monkeypatch.setattr(A, name, value)
    rows = [(i, v) for i, v in vectors(300) if i % 7] + [(0, [3.0] * 8)] * 30 + [(i, [3.0] * 8) for i in range(1000, 1400)] + [(1, [3.0] * 8)] * 9
    got = A.search(frame(spark, rows), target=1.1).collect()
    values = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows]
    for q, vector in {i: v for i, v in values if i % 20 == 0}.items():
        best = sorted((-float((v * vector).sum()), j) for j, v in values if j != q)[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == [j for _, j in best] and [r.rank for r in mine] == list(range(1, 21))


def test_every_query_finds_k_however_small_its_leaves_are(spark, monkeypatch):
    monkeypatch.setattr(A, "LEAF_ROWS", 6)
    rng = np.random.default_rng(3)
    centres = 5 * rng.normal(size=(100, 8))
    rows = [(i, (centres[i // 6] + 0.01 * rng.normal(size=8)).tolist()) for i in range(600)]
    got = A.search(frame(spark, rows), target=0.02).collect()
    assert {q: sum(r.query_id == q for r in got) for q in range(0, 600, 20)} == dict.fromkeys(range(0, 600, 20), 20)
