import random

import numpy as np
import pyarrow as pa
import pytest

from strandline.plans import pagerank as PR
from strandline.plans import registry


@pytest.mark.parametrize("steps", [5, None])
def test_many_blocks_give_the_ranks_of_one(spark, monkeypatch, steps):
    monkeypatch.setattr(PR, "EDGES", 40)
    rng = random.Random(7)
    ids = list(range(60))
    edges = [(a, rng.choice(ids)) for a in ids for _ in range(rng.randrange(5))] + [(a, 3) for a in ids]  # a hub, dangling vertices, parallel edges
    used = [(a, b) for a, b in edges if a != b and a % 9]
    out = {a: sum(x == a for x, _ in used) for a in ids}
    rank, history, found = dict.fromkeys(ids, 1 / 60), [1.0], []
    while len(history) < steps if steps else history[-1] >= PR.MIN_CHANGE:
        lost = sum(rank[a] for a in ids if not out[a])
        new = {b: 0.15 / 60 + 0.85 * (sum(rank[x] / out[x] for x, y in used if y == b) + lost / 60) for b in ids}
        history.append(sum(abs(new[a] - rank[a]) for a in ids))
        rank = new
    v, e = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame([x for x in edges if x[0] % 9], "src long, dst long")
    got = PR.pagerank(v, e, max_steps=steps, history=found)
    assert {r.id: r.rank for r in got.collect()} == pytest.approx(rank)
    assert [c for _, c in found] == pytest.approx(history) and [s for s, _ in found] == list(range(1, len(history) + 1))


def test_messages_say_where_they_belong_in_few_bytes():
    for numbers, size in (([], 70), ([5], 70), ([0, 1, 2, 63, 69], 70), (list(range(0, 1000, 2)), 1000)):
        stored = PR._places(np.array(numbers, dtype=np.int64), size)
        assert len(stored) <= 1 + (size + 7) // 8 and PR._placed(pa.scalar(stored, pa.binary())).tolist() == numbers


def test_numbers_name_the_vertices(spark):
    rows = spark.createDataFrame([(14,), (15,)], "n long").select(registry.graph_name(registry.F.col("n")).alias("id"))
    assert [r.id for r in rows.collect()] == ["s7", "p7"]
