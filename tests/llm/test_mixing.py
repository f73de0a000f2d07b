import random
from collections import Counter, defaultdict

import pytest

from strandline.llm import mixing as M


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", "y", 1) for i, s, t in rows], "doc_id long, source string, text string, slot string, share string, block int").repartition(3)


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 3, "b": 2, "c": 1}, {"a": 50, **{f"s{i}": 1 for i in range(50)}}, {None: 7, "a": 5, "b": 1}])
def test_deviation_below_one_block(spark, shares):
    rows = M.period_slots(spark.createDataFrame(list(shares.items()), "source string, share long")).collect()
    period = sum(shares.values())
    assert sorted(r.slot for r in rows) == list(range(period)) and Counter(r.source for r in rows) == shares
    run = Counter()
    for r in sorted(rows, key=lambda r: r.slot):
        n, w = r.nth, shares[r.source]
        assert n * period // w <= r.slot < -(-(n + 1) * period // w)
        run[r.source] += 1
        assert all(abs(run[s] - (r.slot + 1) * w / period) < 1 for s, w in shares.items())


def corpus():
    rng = random.Random(1)
    rows = [(i, "hot", "x" * rng.randrange(200)) for i in range(400)]
    rows += [(1000 + i, rng.choice(["b", "c", None]), "y" * rng.randrange(200)) for i in range(200)]
    return [*rows, (2000, "b", None), (2001, "c", ""), (2002, "c", "z" * 5000), (5, "hot", "again"), (5, "hot", "again"), (None, "b", "q")]


def test_schedule(spark):
    rows = corpus()
    got = M.schedule(frame(spark, rows), block_chars=500, period=64).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.source, r.chars) for r in got) == Counter((i, s, len(t or "")) for i, s, t in rows)
    by = defaultdict(set)
    for r in got:
        assert r.released <= r.slot < r.due
        by[r.slot].add((r.source, r.block))
    assert all(len(x) == 1 for x in by.values())  # one block of one source in a slot
    held = Counter()
    for r in got:
        held[r.source, r.block] += r.chars
    assert all(n <= 500 + 5000 for n in held.values())


def test_mixed_keeps_every_row(spark):
    rows = corpus()
    docs = frame(spark, rows)
    out = M.mixed(docs, block_chars=500, period=64)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))
    order = [r.source for r in out.collect()]
    assert len(set(order[:60])) > 1


def test_given_shares_and_empty(spark):
    shares = spark.createDataFrame([("a", 3), ("b", 1)], "source string, share long")
    rows = [(i, "ab"[i % 2], "t" * 10) for i in range(80)]
    got = M.schedule(frame(spark, rows), shares, block_chars=10).collect()
    first = Counter(r.source for r in got if r.slot < 40)
    assert first == {"a": 30, "b": 10}
    assert M.schedule(frame(spark, rows).limit(0)).collect() == [] and M.mixed(frame(spark, rows).limit(0)).collect() == []


def test_more_sources_than_slots(spark):
    rows = spark.range(9).selectExpr("id as doc_id", "'some text' as text", "concat('s', id) as source")
    assert M.schedule(rows, period=16).count() == 9
    with pytest.raises(Exception, match="more sources"):
        M.schedule(rows, period=8).collect()
