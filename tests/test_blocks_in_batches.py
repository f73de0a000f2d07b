import pyarrow as pa
from pyspark.sql import functions as F

from strandline.functions import blocks as K
from strandline.functions import text as X
from strandline.operators import segments as G
from strandline.schemas import DOCUMENT
from strandline.sources.stores import open_index

TEXTS = ["", " ", "Éa, b_1!", "x y\n  z ", "--", "a" * 5, "𝒳 ab 1.5 ퟿ .", "1 2 3"]


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], ["win", "doc", "title", "content"])


def opened(found):
    """{(field, term, win, doc): (length, positions)} of packed blocks, and how many blocks there are."""
    out, n = {}, 0
    for b in found:
        for field, term, win, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
            docs, lengths, flat, at = p[1 : 1 + p[0]], p[1 + p[0] : 1 + 2 * p[0]], p[1 + 2 * p[0] :], -1
            assert docs == sorted(docs)
            n += 1
            for x in flat:
                at += x < 0
                out.setdefault((field, term, win, docs[at]), (lengths[at], []))[1].append(-1 - x if x < 0 else x)
    return out, n


def expected(rows):
    out = {}
    for win, doc, *texts in rows:
        for field, text in zip(K.FIELDS, texts, strict=True):
            for i, t in enumerate(text.split()):
                out.setdefault((field, t, win, doc), (len(text.split()), []))[1].append(i)
    return out


def test_blocks_of_batches(monkeypatch):
    rows = [(i // 4, i % 4, "" if i % 3 else f"t{i} same", " ".join(f"w{(i * j) % 7}" for j in range(i % 9))) for i in range(50)]
    for size in (1, 3, 50):
        batches = [batch(rows[i : i + size]) for i in range(0, 50, size)]
        whole = opened(K.indexed(iter(batches)))
        assert whole[0] == expected(rows) and whole[1] == len({k[:3] for k in whole[0]})
        monkeypatch.setattr(K, "HELD", 120)  # some windows at a time
        assert opened(K.indexed(iter(batches))) == whole
        monkeypatch.setattr(K, "HELD", 30)  # windows in parts
        parts = opened(K.indexed(iter(batches)))
        assert parts[0] == whole[0] and parts[1] > whole[1]
        monkeypatch.undo()
    assert list(K.indexed(iter([]))) == [] and list(K.indexed(iter([batch([(0, 0, "", "")])]))) == []


def test_spaced_tokens_are_the_tokens(spark):
    found = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").select(X.spaced(F.col("t")).alias("s"), X.tokens(F.col("t")).alias("ts")).collect()
    assert [[t for t in r.s.split(" ") if t] for r in found] == [r.ts for r in found] and all(r.s == " ".join(r.ts) for r in found)


def test_a_segment_shuffles_no_text(spark, tmp_path, monkeypatch):
    """Blocks are made where the numbered documents are read; before, documents were shuffled by window once more."""
    plans, write = [], G.SegmentedIndex._write_blocks
    monkeypatch.setattr(G.SegmentedIndex, "_write_blocks", lambda self, seg, packed, n: (plans.append(packed._jdf.queryExecution().executedPlan().toString()), write(self, seg, packed, n)))
    store = open_index(spark, f"index:file://{tmp_path}/x")
    store.write("documents", spark.createDataFrame([(f"{i:04d}", "u", "head", f"red w{i} {TEXTS[i % 8]}", None, 0.0) for i in range(30)], DOCUMENT))
    assert store.search_index().top(["red"], 3, "multiply").total == 30
    assert plans and not any("Exchange" in p for p in plans)


def test_searches_of_windows_in_parts(spark, tmp_path):
    """The bounds hold when a term's block comes in parts."""
    docs = [(f"{i:04d}", "u", f"head w{i % 3}", " ".join(["red"] * (i % 5) + [f"w{i % 7}", "blue"] * (i % 3)), None, i / 40) for i in range(40)]
    store = open_index(spark, f"index:file://{tmp_path}/x")
    store.write("documents", spark.createDataFrame(docs, DOCUMENT))
    whole, parts = (G.SegmentedIndex(spark, f"file://{tmp_path}/{name}", store.logs["documents"], window_bits=4) for name in ("whole", "parts"))
    whole.refresh()
    made = parts._write_blocks

    def cut(seg, packed, n):
        each = packed.select("field", "term", "win", "p", F.explode(F.sequence(F.lit(1), F.get("p", F.lit(0)))).alias("k"))
        made(seg, each.select("field", "term", "win", one_document(F.col("p"), F.col("k")).alias("p")), n)

    parts._write_blocks = cut
    parts.refresh()
    assert parts.blocks(["red"]).where("n = 1").count() == parts.blocks(["red"]).count() == 32
    for blend in (None, "sum", "multiply"):
        for terms in (["red", "w2"], ["blue", "head"]):
            want, got = whole.top(terms, 7, blend), parts.top(terms, 7, blend)
            assert [r.link_id for r in want.hits] == [r.link_id for r in got.hits] and want.total == got.total


def one_document(p, k):
    """The packed block of the ``k``-th document (from 1) of a packed block."""
    n = F.get(p, F.lit(0))
    flat = F.slice(p, 2 + 2 * n, F.size(p))
    starts = F.filter(F.transform(flat, lambda _, i: i), lambda i: F.get(flat, i) < 0)
    end = F.coalesce(F.get(starts, k), F.size(flat))
    return F.concat(F.array(F.lit(1), F.get(p, k), F.get(p, n + k)), F.slice(flat, F.get(starts, k - 1) + 1, end - F.get(starts, k - 1)))
