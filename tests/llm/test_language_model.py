import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from strandline.llm import language_model as L


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s> end"]


def brute(rows, order):
    """The same model with dictionaries."""
    raw, uni = Counter(), Counter()
    runs = [(d, tokens(t)) for d, t in rows]
    pad = ["<s> begin"] * (order - 1)
    for d, w in runs:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            uni.update(w)
            p = pad + w
            raw.update(tuple(p[i : i + order]) for i in range(len(w)))
    levels = {order: raw}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {}
    for k, c in levels.items():
        n = Counter(min(x, 5) for x in c.values())
        cuts[k] = L.discounts(n[1], n[2], n[3], n[4])
    sums = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in levels}
    for k, c in levels.items():
        for g, x in c.items():
            s = sums[k][g[:-1]]
            s[0] += x
            s[min(x, 3)] += 1
    n, v = sum(uni.values()), len(uni)

    def probability(gram, k):
        if k == 0:
            return 1 / (v + 1)
        lower = probability(gram[1:], k - 1)
        s = sums[k].get(gram[:-1])
        if not s:
            return lower
        c = levels[k][gram]
        d = (0, *cuts[k])
        return (max(c - d[min(c, 3)], 0) + sum(a * b for a, b in zip(cuts[k], s[1:], strict=True)) * lower) / s[0]

    out = []
    for d, w in runs:
        p = pad + w
        own = sum(math.log10(probability(tuple(p[i : i + order]), order)) for i in range(len(w)))
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((d, len(w), sum(uni[x] > 0 for x in w), n, base, own))
    return sorted(out, key=repr)


def rows_of(n=120):
    import random

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "Été,", "A-B"]
    texts = [" ".join(rng.choice(vocabulary[: rng.randrange(5, 63)]) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [*enumerate(texts), (500, None), (501, ""), (502, "long words " * 40000), (3, texts[3]), (None, "w1 w2"), (10, "only-here w1")]


@pytest.mark.parametrize("order", [2, 3])
def test_against_dictionaries(spark, documents, order):
    rows = rows_of()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in L.report(documents(rows), order).collect()), key=repr)
    want = brute(rows, order)
    key = lambda r: (repr(r[0]), r[1], round(r[4], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)


def test_probabilities_sum_to_one(spark, documents):
    import numpy as np

    from strandline.llm import textkit as tk

    rows = [(i, t) for i, t in rows_of(30) if i is not None and i < 30]
    model = L.train(documents(rows).select("text"))
    every = sorted({w for _, t in rows for w in tokens(t)[:-1]})
    for before in (*every[:5], "unknown"):
        text = " ".join(f"{before} {w}" for w in [*every, "neverseen"])
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        columns, _ = L.token_columns(data, np.array([0, len(data)]), 2)
        p, _ = L.probabilities(model, columns)
        end = L.probabilities(model, [columns[1][:1], np.array([L.END])])[0][0]
        assert p[1:-1:2].sum() + end == pytest.approx(1)
    assert tk.CHUNK_BYTES > 0


def test_held_out_and_empty(spark, documents):
    docs = documents([(i, "x") for i in range(50)])
    got = {r.doc_id: r.held_out for r in L.report(docs).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(50)}
    assert L.report(docs.limit(0)).collect() == []
    alone = next(i for i in range(50) if got[i])
    (r,) = L.report(documents([(alone, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        L.train(docs.select("text"), 1)


def test_order_from_counts():
    assert L.discounts(0, 0, 0, 0) == (0.5, 1.0, 1.5)
    d1, d2, d3 = L.discounts(100, 40, 20, 10)
    assert 0 < d1 < 1 and d1 < d2 < 2 and d3 <= 3
