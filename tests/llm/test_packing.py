import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import packing as P
from strandline.llm.queries import tokenizer_path

TEXTS = ["", None, "a", "Hello, world. It's  fine's\tnow\r\n", "été ÉTÉ straße ΑΣ İ x.y,z ..., a,'s", "日本語 １２３ abc123def", "w" * 300 + " x", "é ñ̃ <|endoftext|>", " \n "]


def check(rows, ids, size=4096):
    """Every id in one piece, gapless sequences, padding only where a power of two was out of reach."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, want in ids.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.asarray(want[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    pad = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        pad += 0 if at & (at - 1) == 0 else size - at
    return pad


def test_against_the_tokenizer(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = TEXTS + ["lorem ipsum dolor " * 9000] + [f"text number {i} with words" for i in range(200)]
    rows = [r.asDict() for r in P.pack(documents(list(enumerate(texts))), tokenizer_path()).collect()]
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    assert check(rows, ids) == 0


def test_repeats_nulls_and_empty(spark, documents):
    rows = P.pack(documents([(None, "a"), (1, "b c"), (1, "b c")]), tokenizer_path()).collect()
    assert sum(r.length for r in rows if r.doc_id is None) == 2 and sum(r.length for r in rows if r.doc_id == 1) == 6
    assert P.pack(documents([]).limit(0), tokenizer_path()).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.booleans()), max_size=40), st.integers(1, 6), st.integers(1, 16), st.integers(0, 5))
def test_limits(items, segments, loss_tokens, window):
    limits = P.Limits(tokens=16, segments=segments, loss_tokens=loss_tokens, window=window)
    out = []
    # no token, all tokens, or every third of an item bear loss
    masks = [np.arange(n) % (1 if i % 2 else 3) == 0 if loss else np.zeros(n, bool) for i, (n, loss) in enumerate(items)]
    packer = P.Packer(limits, 0, out.append)
    for i, (n, loss) in enumerate(items):
        packer.add(i, np.full(n, i, dtype="<u4").tobytes(), np.concatenate([[0], np.cumsum(masks[i])]))
    packer.finish()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    rows = [dict(zip(names, r, strict=True)) for r in out]
    check(rows, {i: [i] * n for i, (n, _) in enumerate(items)}, 16)
    held = defaultdict(lambda: [0, 0])
    for r in rows:
        held[r["sequence_id"]][0] += 1
        bearing = int(masks[r["doc_id"]][r["start"] : r["start"] + r["length"]].sum())
        assert bearing == r["loss_tokens"]
        held[r["sequence_id"]][1] += bearing
    assert all(n <= segments and bearing <= loss_tokens for n, bearing in held.values())


def test_encoder_generations(monkeypatch):
    monkeypatch.setattr(P, "_CACHE_WORDS", 5)
    e, plain = P.WordEncoder(tokenizer_path()), P.WordEncoder(tokenizer_path())
    text = " ".join(f"word{i % 17} other{chr(97 + i % 26)}" for i in range(300))
    assert e(text) == plain(text) and len(e) <= 5


@pytest.mark.parametrize("n", [1, 7, 4096, 4097, 9000])
def test_single(n):
    out = []
    packer = P.Packer(P.Limits(), 5, out.append)
    packer.add(1, bytes(4 * n), np.arange(n + 1))
    packer.finish()
    assert sum(r[2] for r in out) == n and min(r[5] for r in out) == 5


def test_conversations(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    talks = {c: [(k, "assistant" if k % 2 else "user", f"turn {k} of talk {c} " * (k % 7 + c % 5 + 1)) for k in range(c % 9 + 1)] for c in range(60)}
    talks[7].append((100, "assistant", "late word"))
    rows = [(c, *turn) for c, turns in talks.items() for turn in turns] + [(None, None, None, None), (99, 0, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    limits = P.Limits(tokens=256, segments=6, loss_tokens=100, window=16)
    got = [r.asDict() for r in P.pack_conversations(frame, tokenizer_path(), limits).collect()]
    sequences = defaultdict(lambda: [0, 0, 0])
    for r in got:
        for k, n in enumerate((r["length"], 1, r["loss_tokens"])):
            sequences[r["sequence_id"]][k] += n
    assert all(a <= 256 and b <= 6 and c <= 100 for a, b, c in sequences.values())
    ids = {c: sum(([*t.encode(x, add_special_tokens=False).ids, 2] for _, _, x in turns), []) for c, turns in talks.items() if c != 7}
    for c, want in ids.items():
        own = sorted((r for r in got if r["doc_id"] == c), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(want)
        assert all(r["ids_crc32"] == zlib.crc32(np.asarray(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
        assert sum(r["loss_tokens"] for r in own) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, role, x in talks[c] if role == "assistant")
    assert sum(r["length"] for r in got if r["doc_id"] is None) == sum(r["length"] for r in got if r["doc_id"] == 99) == 1
    assert P.pack_conversations(frame.limit(0), tokenizer_path()).collect() == []
