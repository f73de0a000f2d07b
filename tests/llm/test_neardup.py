import random
import re
from collections import Counter

import numpy as np
import pytest

from strandline.llm import neardup as N


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    """(size, least id reachable) of every document, by comparing all pairs that share a shingle."""
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for d, s in sets.items():
        shared = Counter()
        for g in s:
            for o in lists.setdefault(g, []):
                shared[o] += 1
            lists[g].append(d)
        for o, i in shared.items():
            if 100 * i >= 85 * (len(s) + len(sets[o]) - i):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def edited(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [None, "", " \n", "one two", "One  TWO", "a b c d", "a b c d e", "a b c d e"]
    texts += [" ".join(fresh(rng.randrange(1, 120))) for _ in range(120)]
    passage = fresh(60)
    texts += [" ".join(fresh(30) + passage + fresh(30)) for _ in range(80)]  # a passage that many share
    texts += [" ".join(passage + fresh(rng.randrange(4))) for _ in range(40)]  # little else
    base = fresh(200)
    texts += [" ".join(edited(rng, base, rng.randrange(9))) for _ in range(150)]  # a large group of near copies
    chain = fresh(100)
    for _ in range(40):  # each a copy of the one before
        chain = edited(rng, chain, 1)
        texts.append(" ".join(chain))
    texts += [" ".join(base)] * 30 + [" ".join(fresh(5000))] * 2
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, documents, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.report(documents(rows)).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute(rows).items()}


def test_small_lists_force_every_path(spark, documents, monkeypatch):
    for name, value in (("SHORT", 2), ("ROUNDS", 1), ("PIVOTS", 2)):
        monkeypatch.setattr(N, name, value)
    rows = corpus(7)
    got = {r.doc_id: r.component_id for r in N.report(documents(rows)).collect()}
    assert got == {d: c for d, (_, c) in brute(rows).items()}


def test_link_between_classes_that_two_hubs_decided(spark, monkeypatch):
    monkeypatch.setattr(N, "PIVOTS", 1)  # one hub for each round
    size = {c: 1000 for c in range(40)} | {c: 1370 for c in range(40, 80)} | {90: 1100, 91: 1230}  # growing copies, each begins with the one before
    classes = []
    for c, n in size.items():
        items = np.sort(np.append(np.arange(n - 1) * 2**40, 2**60 + c))
        order = items[np.argsort(np.random.default_rng(1).random(3000)[items // 2**40 % 3000], kind="stable")]
        classes.append((c, n, 0 if c < 40 else 1, np.sort(order[:64]).tolist(), items.astype("<i8").tobytes()))
    frame = spark.createDataFrame(classes, "c long, n long, rare long, sketch array<long>, items binary")
    found = N._long_lists(frame.selectExpr("0L as v", "c", "n", "rare", "0L as pos"), frame.select("c", "sketch"), frame.select("c", "items"))
    links = {(r.a, r.b) for m in found for r in m.where("linked").collect()}
    assert (0, 90) in links and (40, 91) in links and (0, 40) not in links
    assert (90, 91) in links


def test_repeats_and_nulls(spark, documents):
    same = "a b c d e f g"
    rows = [(5, same), (5, same), (3, same.upper()), (None, same), (None, None), (9, "x"), (9, "y")]
    docs = documents(rows)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in N.report(docs).collect())
    assert got == [(0, 0, 0, True), (0, 3, 3, False), (3, 3, 3, True), (5, 3, 3, False), (5, 3, 3, False), (9, 1, 9, True), (9, 1, 9, True)]
    left = N.distinct_documents(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text) for r in left.where("text is not null").collect()) == [(3, same.upper()), (9, "x"), (9, "y")]
    twice = N.distinct_documents(documents([(1, same), (1, same), (1, same)]))
    assert twice.count() == 1
    assert N.report(docs.limit(0)).collect() == [] and N.distinct_documents(docs.limit(0)).collect() == []


def test_estimate():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 2**60, 64))
    b = np.sort(np.concatenate([a[:32], rng.integers(2**61, 2**62, 32)]))
    big = np.iinfo(np.int64).max
    short = np.concatenate([a[:3], np.full(61, big)])
    got = N.shared_part(np.stack([a, a, short]), np.stack([a, b, short]))
    assert got[0] == 1 and got[2] == 1 and got[1] == pytest.approx(0.5)
