import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import divergence as D


def brute(rows, min_docs, top):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: {t: counts[lang, s][t] for t in kept} for la, s in groups if la == lang}
        own_p = {s: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()} for s, c in own.items()}
        total = {t: sum(c[t] for c in own.values()) for t in kept}
        q = {t: 1 + 10**9 * (n + 2) // (sum(total.values()) + 2 * len(kept)) for t, n in total.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, p in own_p.items():
            pairs = sorted((-sum(f(p[t], o[t]) for t in kept), other.encode(), other) for other, o in own_p.items() if other != s)
            lead = sorted((-f(p[t], q[t]), t.encode(), t) for t in kept if own[s][t] > 0 and p[t] > q[t])[:top]
            for part, items in (("pair", pairs), ("term", lead)):
                out.extend((lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(items))
    return sorted(out)


ROWS = (
    [("en", "a", "Plain words AND wörds, x1y don't")] * 3
    + [("en", "b", "and and plain\nÜber über")] * 2
    + [("en", "c", "123 ... "), ("en", None, None), ("en", "", "plain zeta"), (None, "a", "solo"), (None, "b", None), ("de", "only", "ein Wort " * 5000), ("de", "only", "ein wort"), ("xx", "p", "rare"), ("xx", "q", "other"), ("日", "ł", "日本 語 日本"), ("日", "é", "日本 語")]
    + [("en", "hot", f"hot w{'abcdefghij'[i % 10]} plain {'z' * (i % 7)}") for i in range(300)]
)
SCHEMA = "lang string, source string, text string, term string, n string, docs string, block string, value string, part string, rank string, width string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA).repartition(3)


def result(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_against_brute_force_and_sql(spark, monkeypatch):
    rows = frame(spark, ROWS)
    for min_docs, top, cells in ((2, 3, D.TILE), (1, 10, 16)):
        monkeypatch.setattr(D, "TILE", cells)
        want = brute(ROWS, min_docs, top)
        assert result(D.audit(rows, min_docs, top)) == want
        con = duckdb.connect()
        con.register("documents", pd.DataFrame(ROWS, columns=["lang", "source", "text"]))
        assert sorted(con.execute(D.oracle(min_docs, top)).fetchall()) == want


def test_no_kept_terms_and_empty(spark):
    got = result(D.audit(frame(spark, [("en", "a", "x"), ("en", "b", None), ("en", "c", "y")])))
    assert got == [("en", s, "pair", o, 0, k + 1) for s in "abc" for k, o in enumerate(x for x in "abc" if x != s)]
    assert D.audit(frame(spark, ROWS).limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9 * 10**14), min_size=1, max_size=5), st.integers(1, 10**8))
def test_probability_is_exact(counts, width):
    n, total = np.array(counts), sum(counts)
    assert D.probability(n, np.int64(total), width).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * width) for c in counts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB é1\n", max_size=12), max_size=6))
def test_terms(texts):
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    found, text = D.terms(np.frombuffer(data, np.uint8), offsets) if data else ([], [])
    want = [(i, w.lower()) for i, t in enumerate(texts) for w in re.findall("[A-Za-zé]+", t)]
    assert [(i, w.as_py().decode()) for i, w in zip(text, found, strict=True)] == want


def test_rows_of_pairs_some_at_a_time(monkeypatch):
    counts = pd.DataFrame({"source": ["a", "b", "a"], "term": ["x", "x", "y"], "n": [5, 1, 2]})
    totals = pd.DataFrame({"source": ["a", "b", "c"], "total": [7, 1, 0], "width": [2, 2, 2]})
    whole = list(D.tile(counts, totals))
    monkeypatch.setattr(D, "PAIR_CELLS", 1)
    assert list(D.tile(counts, totals)) == whole
