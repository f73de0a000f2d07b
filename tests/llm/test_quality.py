import random
import re
from collections import Counter

from strandline.llm import quality as Q


def brute(text):
    text = text or ""
    find = re.compile(r"[^\x20\x09-\x0D]+").findall
    w = find(text)
    lines = [x for x in text.split("\n") if find(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(5)}
    base = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered))
    return (*base, len(w) < 10 or 100 * len(covered) > 20 * len(w))


def texts():
    rng = random.Random(2)
    out = [None, "", "\n\n", "a\n", "a\na\n a\na", "x\r\nx\r\n", "é ü #|<> $", "one two three four five " * 3, "l " * 100000]
    for _ in range(150):
        out.append("".join(rng.choice(["ab", "Cé", "#", " ", "\n", "\t", "ab cd ef gh ij ", "\n\n"]) for _ in range(rng.randrange(120))))
    return out


def test_counts(spark, documents):
    rows = [*enumerate(texts()), (3, "a\n"), (None, "x y")]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.judge(documents(rows)).collect()), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=repr)


def test_adaptive_limits(spark, documents):
    rng = random.Random(1)
    plain = lambda: " ".join(f"word{rng.randrange(10**6)}" for _ in range(40))
    marked = lambda: " ".join(f"word{rng.randrange(10**6)} ###" for _ in range(20))
    rows = [(i, plain(), "en", "a") for i in range(80)] + [(100 + i, marked(), "en", "a") for i in range(4)]
    rows += [(200 + i, marked(), "xx", "code") for i in range(60)] + [(300, plain(), None, None), (301, plain(), "en", "tiny"), (302, marked(), "en", "tiny")]
    got = {r.doc_id: r.kept for r in Q.judge(documents(rows)).collect()}
    assert all(got[i] for i in range(80)) and not any(got[100 + i] for i in range(4))
    assert all(got[200 + i] for i in range(60))  # the usual style of its source
    assert got[300] and got[301] and not got[302]  # a small group is judged by its language


def test_third_of_a_source_is_junk(spark, documents):
    rng = random.Random(3)
    plain = lambda: " ".join(f"word{rng.randrange(10**6)}" for _ in range(40))
    marked = lambda: " ".join(f"word{rng.randrange(10**6)} ###" for _ in range(20))
    rows = [(i, marked() if i % 3 == 0 else plain(), "en", "hot") for i in range(150)]
    rows += [(1000 + i, plain(), "en", "b") for i in range(400)] + [(2000 + i, marked(), "xx", "code") for i in range(60)]
    got = {r.doc_id: r.kept for r in Q.judge(documents(rows)).collect()}
    assert all(got[i] == (i % 3 != 0) for i in range(150))  # its median is like that of all
    assert all(v for i, v in got.items() if i >= 1000)


def test_sketches_merge(spark, documents):
    docs = documents(list(enumerate(texts()[9:])))
    whole = {tuple(r) for r in Q.sketches(Q.metrics(docs)).collect()}
    halves = Q.sketches(Q.metrics(docs.where("doc_id % 2 = 0"))).union(Q.sketches(Q.metrics(docs.where("doc_id % 2 = 1"))))
    merged = {tuple(r) for r in halves.groupBy("lang", "source", "metric", "level").sum("n").collect()}
    assert whole == merged


def test_empty(spark, documents):
    assert Q.judge(documents([(1, "x")]).limit(0)).collect() == []
