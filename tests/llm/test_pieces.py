import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import pieces as P
from strandline.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = ["", None, " ", "  ", "a", " a  b ", "▁a ▁", "\n\n a\r\n\tb", "a\x00b", "ﬁ Å é ｱ", "<s> </s> <0x0A> <unk>", "日本語テキスト 😀", "=" * 70, " " * 90, "ab" * 40_000, "x " * 30_000, " " * 30_000]


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_against_the_library():
    e = P.encoder(MODEL)
    for text in TEXTS:
        assert ids_of(e.encode(text)) == LIBRARY.encode(text or ""), text[:40]


def test_pieces_joined_at_random():
    e, rnd = P.encoder(MODEL), random.Random(3)
    names = list(e.pieces.ids)
    for _ in range(3000):
        text = "".join(rnd.choice([rnd.choice(names), rnd.choice("abc \n\t▁éß日😀\r"), " " * rnd.randint(0, 40), rnd.choice("=-_.a") * rnd.randint(0, 70)]) for _ in range(rnd.randint(0, 9)))
        assert ids_of(e.encode(text)) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids_of(P.encoder(MODEL).encode(text)) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=4), max_size=14, unique=True), st.permutations(range(14)), st.text("abcd", min_size=1, max_size=24))
def test_any_vocabulary(words, ranks, text):
    """Backtracking against the merges themselves, with pieces that no merge reaches, equal scores and unknown characters."""
    score = {w: -float(r // 2) for w, r in zip(words, ranks)}  # noqa: B905
    pieces = P.Pieces({c: i for i, c in enumerate([*"abc", *words])}, {**dict.fromkeys("abc", 0.0), **score}, list(range(100, 356)))
    assert pieces.split(text) == pieces.remerge(text)


def test_remembered_words_are_bounded():
    calls = []
    r = P.Remembered(lambda w: calls.append(w) or w.upper(), words=4, chars=5)
    for k in range(40):
        assert r[f"w{k % 11}"] == f"W{k % 11}" and len(r) <= 4
    assert r["longer than five"] and "longer than five" not in r


def test_report(spark, documents):
    rows = P.report(documents([*enumerate(TEXTS), (3, "  "), (None, "x y")]), MODEL).collect()
    assert len(rows) == len(TEXTS) + 2
    for text, row in [*((t, next(r for r in rows if r.doc_id == i)) for i, t in enumerate(TEXTS)), ("x y", next(r for r in rows if r.doc_id is None))]:
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert P.report(documents([]).limit(0), MODEL).collect() == []


def test_round_trip(spark, documents):
    texts = [(i, t) for i, t in enumerate(TEXTS) if t is not None and P.BLANK not in t]
    back = {r.doc_id: r.decoded for r in P.decode(P.encode(documents(texts), MODEL, ends=False), MODEL).collect()}
    assert back == dict(texts)


def test_models_of_other_kinds_are_refused(monkeypatch):
    class Other:
        def __init__(self, model_file):
            self.model = LIBRARY

        def __getattr__(self, name):
            return getattr(self.model, name)

        def normalize(self, text):
            return text.lower()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError):
        P.Encoder(MODEL)
