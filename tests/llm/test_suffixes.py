import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import suffixes as S


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return sorted(out, key=repr)


def corpus(seed, unit):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage = fresh(2 * unit)
    rows = [fresh(rng.randrange(1, 6 * unit)) for _ in range(15)]
    rows += [fresh(unit) + passage + fresh(unit) for _ in range(8)]  # shared by many
    rows += [fresh(9) + passage[: unit + rng.randrange(unit)] + fresh(9) for _ in range(8)]
    rows += [rows[2]] * 3 + ["ab" * (3 * unit), "c" * (2 * unit), "c" * (unit - 1), "c" * unit]
    inner = fresh(unit + 7)
    rows += [inner + fresh(3) + inner, fresh(5) + inner[:unit]]  # twice in one text
    near = list(fresh(8 * unit))
    for _ in range(6):
        near[rng.randrange(len(near))] = "X"
        rows.append("".join(near))
    rows += [None, "", "short"]
    return list(enumerate(rows))


def found(spark, df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_production_length(spark, documents, seed):
    rows = corpus(seed, 400)
    assert found(spark, S.report(documents(rows))) == brute(rows, 400)


def test_heavy_buckets(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "HEAVY", 2)
    rows = corpus(3, 400)
    assert found(spark, S.report(documents(rows))) == brute(rows, 400)


@pytest.mark.parametrize(("length", "gram", "band"), [(20, 5, 4), (20, 10, 10), (8, 3, 1), (12, 1, 11)])
def test_other_lengths(spark, documents, monkeypatch, length, gram, band):
    monkeypatch.setattr(S, "GRAM", gram)
    rows = corpus(length, length)
    r, done = S.removals(documents(rows), length, gram, band)
    monkeypatch.setattr(S, "removals", lambda docs, n: (r, done))
    assert found(spark, S.report(documents(rows), length)) == brute(rows, length)


@pytest.mark.parametrize(("gram", "length"), [(1, 1), (1, 7), (3, 12), (4, 16), (5, 9)])
def test_refined_buckets(gram, length):
    rng = random.Random(length)
    text = bytes(rng.choice(b"ab") for _ in range(400))
    data = np.frombuffer(text, np.uint8)
    starts = np.array(sorted(rng.sample(range(400 - length), 300)))
    # q-grams named exactly, and by a name that unequal ones share, as when hashes meet
    for names in ([text[i : i + gram] for i in range(401 - gram)], [text[i : i + 1] for i in range(401 - gram)]):
        grams = np.unique(names, return_inverse=True)[1].astype(np.uint64)
        got = S.refined(grams, starts, gram, length)
        hit = S._confirmed(data, starts, got, np.zeros(300, np.int64), length)
        seen = Counter(text[i : i + length] for i in starts.tolist())
        assert hit.tolist() == [seen[text[i : i + length]] > 1 for i in starts.tolist()]


def test_passages_of_whole_words(spark, documents):
    fresh = lambda seed, n: " ".join(f"{random.Random(seed * 1000 + i).choice('abcdefgh')}{seed}x{i}" for i in range(n))
    long, short = fresh(1, 60), fresh(2, 45)
    rows = [(i, f"{fresh(10 + i, 20)} q{i}{long}{i}r {fresh(20 + i, 20)} {short} {fresh(30 + i, 5)}", None) for i in range(3)] + [(9, long), (9, long), (10, short), (10, short)]
    out = {r.doc_id: r.text for r in S.cut_texts(documents([r[:2] for r in rows]), 200, 50, 76, 51).collect()}
    inner = long.split(" ", 1)[1].rsplit(" ", 1)[0]
    for i, text, *_ in rows[:3]:
        assert out[i].split() == text.replace(inner, "").split()  # the words at either end are not the same everywhere
    assert out[9] == "" and out[10] == short


def test_cut_texts(spark, documents):
    fill = "".join(random.Random(5).choice("abcdefgh ") for _ in range(500))
    rows = [(1, "é" + fill + "ü tail"), (2, "è" + fill + "ö end"), (3, "alone"), (4, fill * 1), (4, fill * 1), (5, None)]
    docs = documents(rows)
    out = S.cut_texts(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = sorted((r.doc_id, r.text, r.n_chars) for r in out.where("text is not null").collect())
    # the second bytes of é and è, and the first ones of ü and ö, tell which characters are whole
    assert [g[0] for g in got] == [1, 2, 3, 4, 4] and got[2:] == [(3, "alone", 5), (4, "", 0), (4, "", 0)]
    assert got[0][1].endswith("tail") and fill not in got[0][1] and got[0][2] == len(got[0][1])
    assert out.where("doc_id = 5").first().text is None


def test_empty_and_bad_settings(spark, documents):
    empty = documents([(1, "x")]).limit(0)
    assert S.report(empty).collect() == [] and S.cut_texts(empty).collect() == []
    with pytest.raises(ValueError):
        S.removals(empty, 400, 390, 50)


def test_long_text(spark, documents):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij") for _ in range(1_500_000))
    rows = [(1, long), (2, long[700_000:700_900]), (3, "z" * 10)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.report(documents(rows)).collect()}
    assert got == {1: (900, 1), 2: (900, 1), 3: (0, 0)}
