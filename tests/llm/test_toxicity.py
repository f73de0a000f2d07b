import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import toxicity as T


def brute(scores):
    """All maximal segments by their definition (Ruzzo and Tompa): recursively the best, then left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: (round(x[0], 9), x[1]))
    _, _, i, j = best
    return brute(scores[:i]) + [(i, j - 1, sum(scores[i:j]))] + [(a + j, b + j, s) for a, b, s in brute(scores[j:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-4, 4).filter(bool), max_size=12))
def test_segments(values):
    # distinct sums, so that the segments are unique
    scores = [v + 0.001 * (i + 1) ** 1.7 for i, v in enumerate(values)]
    got = T.maximal_segments(scores, [0] * len(scores), 0.0)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(scores)]
    assert np.allclose([s for *_, s in got], [s for *_, s in brute(scores)])


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta epsilon zeta theta".split()) + rng.choice(["", "s", "x"]) for _ in range(rng.randrange(20, 90))]
        bad = int(rng.random() < 0.25)
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["Vilewort,", "gruntbag", f"sludgo{rng.choice('abcdefgh')}{rng.randrange(99)}"]) for _ in range(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, bad))
    return rows, labels


def test_held_out(spark, documents):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (9002, "word " * 300000), (9003, rows[0][1]), (9003, rows[0][1]), (None, "vilewort")]
    lab = spark.createDataFrame([*labels, (1, 1, None), (2, 1, 7), (None, 1, 1), (77777, 1, 1), labels[5]], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    model = T.fit(docs, lab)
    got = T.score(docs, model).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got) and len(got) == len(rows)
    none = {r.score for r in got if r.doc_id in (9000, 9001, 9002)}
    assert len(none) == 1 and none.pop() < 0.5
    text = dict(rows)
    for p in T.passages(docs, model).where("doc_id < 600").collect():
        assert text[p.doc_id].encode()[p.first_byte : p.end_byte]
    kept = {r.doc_id for r in T.clean_documents(docs, model).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}
    assert T.clean_documents(docs, model).columns == docs.columns


def test_bound_and_no_labels(spark, documents):
    rows, labels = corpus(200)
    docs = documents(rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert T._sample(docs, lab, 50).count() < 100
    model = T.fit(docs, lab.where("toxic = 0"))
    assert {r.score for r in T.score(docs, model).collect()} == {0.0}
    assert T.score(docs.limit(0), model).collect() == []
    assert T.fit(docs.limit(0), lab.limit(0)) is not None


def test_scan_is_linear():
    # every new segment starts lower than all before it, then higher: the worst cases of a search by steps
    for sign in (-1, 1):
        scores = [x for i in range(40_000) for x in (1.0 + sign * i * 1e-6, -1.5)]
        began = time.perf_counter()
        assert len(T.maximal_segments(scores, [0] * len(scores), 0.0)) == 40_000
        assert time.perf_counter() - began < 2


def test_score_against_its_definition(spark, documents):
    """Every text's score from a plain reading of words, all segments by recursion, chances and the curve."""
    import math
    import re

    rows, labels = corpus(300, seed=4)
    docs = documents(rows)
    model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = dict(zip(model.names.tolist(), model.scores.tolist(), strict=True))

    def word_score(word):
        data = np.frombuffer(word.encode(), np.uint8)
        one = T.Words(data, np.array([0, len(data)]))
        return next((held[x] for k in range(3) if (x := int(one.feature(k)[0])) in held), None)

    cache = {}
    for r in T.score(docs, model).collect():
        words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", dict(rows)[r.doc_id].lower())
        scores = [cache.setdefault(w, word_score(w)) for w in words]
        at = [i for i, s in enumerate(scores) if s]
        line = []
        for i in at:
            # neutral words as one negative number each time they stand between
            gap = i - (line[-1][0] if line else -1) - 1
            line.append((i, gap, scores[i]))
        flat = [x for _, gap, s in line for x in ([-T.NEUTRAL * gap] if gap else []) + [s]]
        total = 0.0
        for *_, s in brute(flat):
            p = max(1 - math.exp(-model.scale * len(words) * math.exp(-model.decay * s)), 1e-12)
            total -= math.log10(p) if p < T.SIGNIFICANT else 0
        want = 1 / (1 + math.exp(-(model.intercept + model.slope * min(total, T.MOST_EVIDENCE))))
        assert abs(r.score - want) < 1e-6, (r, want)


def test_copies_count_once(spark, documents):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, text) for i in range(30)] + [(30 + i, " ".join(f"other{i}x{j}" for j in range(30))) for i in range(20)]
    sample = spark.createDataFrame([(int(i < 30), t) for i, t in rows], "toxic int, text string")
    counts = T._word_counts(sample).collect()
    assert {(r.toxic, r.clean) for r in counts} == {(1, 0), (0, 1)}
