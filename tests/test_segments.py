import math
import random
from collections import Counter
from datetime import datetime

import pytest
import regex

from strandline.operators import search as S
from strandline.operators import segments as G
from strandline.operators.index import B, K1
from strandline.sources.deltalog import DeltaTable
from strandline.sources.stores import KINDS, open_index

TEXT = "link_id string, url string, title string, content string, indexed_at timestamp"
WORDS = [f"w{i}" for i in range(12)]


def key(i):
    return f"{(i + 1) * 2654435761 % 2**32:08x}-0000-0000-0000-{i:012d}"


class Model:
    """The same documents in memory, scored by the formula."""

    def __init__(self):
        self.text, self.rank = {}, {}

    def scores(self, terms):
        docs = {i: {f: Counter(regex.findall(r"[\p{L}\p{N}_]+", (t or "").lower())) for f, t in zip(("title", "content"), self.text.get(i, ("", "")), strict=True)} for i in self.text.keys() | self.rank.keys()}
        out = {}
        for f in ("title", "content"):
            average = max(sum(d[f].total() for d in docs.values()) / max(len(docs), 1), 1e-9)
            df = {t: sum(t in d[f] for d in docs.values()) for t in terms}
            for i, d in docs.items():
                hit = [t for t in terms if t in d[f]]
                if hit:
                    s = sum(math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d[f][t] * (K1 + 1) / (d[f][t] + K1 * (1 - B + B * d[f].total() / average)) for t in hit)
                    out[i] = max(out.get(i, 0), s)
        return out

    def order(self, terms, blend):
        found = [(i, s, self.rank.get(i, 0.0)) for i, s in self.scores(terms).items()]
        rank = {None: lambda s, r: r, "sum": lambda s, r: s + r, "multiply": lambda s, r: s * (s + r)}[blend]
        return [i for _, _, i in sorted((-round(rank(s, r), 9), -round(s, 9), i) for i, s, r in found)]


@pytest.fixture
def grown(spark, tmp_path):
    """A store after commits, replacements, scores and merges, with a model of it; windows of four documents."""
    rnd = random.Random(5)
    log, model = DeltaTable(spark, f"file://{tmp_path}/d", KINDS["documents"], ranges=2), Model()
    store = open_index(spark, f"index:{tmp_path}/s")
    store.logs["documents"] = log
    opened = lambda: G.SegmentedIndex(spark, f"file://{tmp_path}/i", log, fanout=3, window_bits=2)

    def put(numbers):
        rows = [(key(i), f"http://x/{i}", rnd.choice(["", "w1 w2", "W3"]), " ".join(rnd.choice(WORDS[: rnd.randint(1, 12)]) for _ in range(rnd.randint(0, 25))), datetime(2024, 1, 1)) for i in numbers]
        store.put_documents(spark.createDataFrame(rows, TEXT))
        model.text |= {r[0]: (r[2], r[3]) for r in rows}

    def score(ranks):
        store.put_scores(spark.createDataFrame([(key(i), float(r)) for i, r in ranks.items()], "link_id string, score double"))
        model.rank |= {key(i): float(r) for i, r in ranks.items()}

    return opened, put, score, model, rnd


def check(found, model, terms):
    want = model.scores(terms)
    got = {r.link_id: r.score for r in found.scores(terms).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_follows_the_documents(grown):
    opened, put, score, model, rnd = grown
    assert opened().refresh().top(["w1"], 5).hits == [] and opened().refresh().scores(["w1"]).count() == 0
    put(range(30))
    check(opened().refresh(), model, ["w1", "w3"])
    before = opened().entry
    put([29, 40])
    after = opened().refresh().entry
    assert set(before.segments) < set(after.segments)  # a commit writes its own segment
    (fresh,) = set(after.segments) - set(before.segments)
    assert after.segments[fresh][0] == 2 and after.sizes()[0] == 31
    check(opened(), model, ["w1", "w3", "absent"])
    score({i: rnd.randint(0, 5) for i in range(50)})  # also of unknown documents
    check(opened().refresh(), model, ["w1", "w3"])
    assert {r.link_id: r.pagerank for r in opened().pageranks().collect()} == {i: model.rank.get(i, 0.0) for i in model.text.keys() | model.rank.keys()}
    for k in range(6):
        put(rnd.sample(range(60), 7))
        opened().refresh()
    assert len(opened().entry.segments) < 6  # merged meanwhile
    check(opened(), model, ["w0", "w5"])
    assert opened().entry.sizes()[0] == len(model.text.keys() | model.rank.keys())
    for blend in (None, "sum", "multiply"):
        for terms in (["w0"], ["w5", "w1", "w11"]):
            want = model.order(terms, blend)
            for k in (5, 200):
                got = opened().top(terms, k, blend)
                assert [r.link_id for r in got.hits] == want[:k] and got.total == len(want)


def test_a_rebuilt_index_after_a_replacement(grown, spark):
    opened, put, score, model, _ = grown
    put(range(10))
    opened().refresh()
    log = opened().table
    log.replace(log.read().where("link_id <> '" + key(3) + "'"))
    del model.text[key(3)]
    check(opened().refresh(), model, ["w1"])
    assert len(opened().entry.segments) == 1


def test_reads_the_windows_that_can_hold_the_best(grown):
    opened, put, score, model, _ = grown
    put(range(240))
    score({i: i for i in range(240)})
    put([999])
    found = opened().refresh()
    some = found.top(["w0", "w1", "w2"], 3)
    assert some.windows > 40 and some.read <= G.PROBE and [r.link_id for r in some.hits] == model.order(["w0", "w1", "w2"], None)[:3]
    blended = found.top(["w0", "w1"], 3, "sum")
    assert blended.read < blended.windows and [r.link_id for r in blended.hits] == model.order(["w0", "w1"], "sum")[:3]


def test_batches_go_on_from_the_last_hit(grown):
    opened, put, score, model, rnd = grown
    put(range(90))
    score({i: i % 7 for i in range(90)})
    found = opened().refresh()
    for blend in (None, "multiply"):
        want = model.order(["w2"], blend)
        seen, last, read = [], None, []
        while page := found.top(["w2"], 20, blend, after=last and (last.rank_score, last.score, last.link_id)).hits:
            seen, last = seen + page, page[-1]
            if len(seen) == 20:  # a write meanwhile, with another version of the index
                put(rnd.sample(range(200), 5))
                opened().refresh()
                model_after = dict(model.text)
        assert [r.link_id for r in seen] == want
        assert model_after
        found = opened().refresh()
    late = found.top(["w2"], 10, after=(1.0, 0.0, "z"))
    assert late.windows < found.top(["w2"], 10).windows  # windows of the pages before are left out


def test_phrases(spark, tmp_path):
    store = open_index(spark, f"index:{tmp_path}/s")
    rows = [(key(i), "u", "blue green" if i == 7 else "", "red green blue" if i % 2 else "green red blue green", datetime(2024, 1, 1)) for i in range(20)]
    store.put_documents(spark.createDataFrame(rows, TEXT))
    stored = store.search_index()
    page = S.search(stored, S.Query.parse('"green blue"'), page_size=50).collect()
    assert {r.link_id for r in page} == {key(i) for i in range(20) if i % 2} and {r.total_count for r in page} == {10}
    assert S.search(stored, S.Query.parse('"blue green"')).count() == 10
    assert S.search(stored, S.Query.parse('"green"'), page_size=3).count() == 3 and S.search(stored, S.Query.parse('""')).count() == 0
    assert stored.phrase(["blue", "green"]).count() == 11


def test_two_writers_of_the_index(grown, monkeypatch):
    opened, put, score, model, _ = grown
    put(range(5))
    first, second = opened(), opened()
    rebuilt = first._rebuilt

    def slowly(latest):
        made = rebuilt(latest)
        second.refresh()
        return made

    monkeypatch.setattr(first, "_rebuilt", slowly)
    first.refresh()
    assert first.entry == second.entry and first.log.versions() == [0]
    check(first, model, ["w1"])


def test_old_files_go(grown, spark):
    opened, put, score, model, rnd = grown
    for k in range(6):
        put([k, 50 + k])
        score({k: k})
        opened().refresh()
    kept = {r for e in opened().log.versions() for r in G.Entry(**opened().log.read_entry(e)).segments}
    from strandline.shared import file_system

    files, at = file_system(spark, f"{opened().root}/docs")
    assert {s.getPath().getName()[4:] for s in files.listStatus(at)} == kept
    check(opened(), model, ["w1", "w2"])
