import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from strandline.llm import alignment as A
from strandline.llm.queries import tokenizer_path

PATHS = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
LIB_A = Tokenizer.from_file(PATHS[0])
LIB_A.encode_special_tokens = True
LIB_B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
TEXTS = [
    "", None, " ", "\n", "a", "  two  blanks ", "end \n", "a\r\nb\t c\x0bd\x85e\xa0f　g", "x  y", "don't I'll we've 'S", "<|endoftext|> <s> </s> <0x41>", "▁a", "good ▁", "日本語 テキスト 😀 é", "\x00\x1c\x1d \x1e", "ab" * 9000,
    "lorem ipsum dolor " * 700, " " * 500, "\n" * 300, "same", "same", "tab\t\n  next", "١٢٣ ½ Ⅷ x²", "a\n \n b",
]


def token_bytes():
    spell = A._byte_alphabet()
    a = {i: bytes(spell[c] for c in t) for t, i in LIB_A.get_vocab(with_added_tokens=False).items()}
    b = {i: bytes([int(LIB_B.id_to_piece(i)[3:5], 16)]) if LIB_B.is_byte(i) else LIB_B.id_to_piece(i).replace("▁", " ").encode() for i in range(LIB_B.get_piece_size())}
    return a, b


def brute(texts):
    """The contract, word for word, over (id, text)."""
    spell_a, spell_b = token_bytes()
    docs, pairs = [], Counter()
    for doc, text in texts:
        a = LIB_A.encode(" " + text, add_special_tokens=False).ids if text else []
        b = LIB_B.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(spell_a.get, a)) != whole or b"".join(map(spell_b.get, b)) != whole:
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(spell_a[i]) for i in a]).tolist(), np.cumsum([len(spell_b[i]) for i in b]).tolist()
        groups, links = [], []
        lo_a = lo_b = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            hi_a, hi_b = ends_a.index(end, lo_a) + 1, ends_b.index(end, lo_b) + 1
            groups.append(",".join(map(str, a[lo_a:hi_a])) + "|" + ",".join(map(str, b[lo_b:hi_b])))
            links.append((a[hi_a - 1], b[hi_b - 1]))
            lo_a, lo_b = hi_a, hi_b
        pairs.update(links)
        docs.append((doc, len(a), len(b), ";".join(groups), links))
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(
        (doc if doc is not None else -1, na, nb, text.count(";") + 1 if text else 0, len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
        for doc, na, nb, text, links in docs
    )


def found(rows):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)


def test_against_brute_force(spark, documents):
    texts = [*enumerate(TEXTS), (5, "  two  blanks "), (None, "no id"), (None, None)]
    assert found(A.report(documents(texts), *PATHS).collect()) == brute(texts)


def test_joined_by_a_shuffle(spark, documents, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_PAIRS", 0)
    texts = [(i, t) for i, t in enumerate(TEXTS[:15])]
    assert found(A.report(documents(texts), *PATHS).collect()) == brute(texts)


def test_empty_table(spark, documents):
    assert A.report(documents([]).limit(0), *PATHS).collect() == []


def test_words_by_themselves_equal_whole_texts():
    both, rnd = A.pair(*PATHS), random.Random(11)
    bits = [" ", " ", "\n", "  ", "\r\n", "\t", "\xa0", "\x1c", "​", "　", "a", "word", "don't", "'s", ",", "12", "é", "日", "😀", "<|endoftext|>", "_", "½", "́"]
    for _ in range(4000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12)))
        a, b = both.encode(text)
        assert np.frombuffer(a, both.kind).tolist() == LIB_A.encode(" " + text, add_special_tokens=False).ids, text
        assert np.frombuffer(b, both.kind).tolist() == LIB_B.encode(text), text


def test_spans_cut_anywhere(spark, documents):
    """Short spans, most of them inside of groups, give the same groups and links as one long one."""
    texts = [(i, t) for i, t in enumerate(TEXTS) if t and len(t) < 9000]
    frame = documents(texts)

    def joined(parts):
        out = {}
        for r in sorted(parts.collect(), key=lambda r: (r.doc, r.part)):
            text, links, n = out.get(r.doc_id, ("", [], 0))
            out[r.doc_id] = (text + r.groups, links + list(zip(r.link_end, r.link_a, r.link_b, strict=True)), n + r.n_a + r.n_b)
        return out

    whole = joined(A.align(frame, *PATHS))
    assert whole == joined(A.align(frame, *PATHS, span=3)) == joined(A.align(frame, *PATHS, span=64))
    assert len(A.align(frame, *PATHS, span=3).where("doc_id = 5").collect()) > 4


def test_pair_bound():
    both = A.pair(*PATHS)
    small = object.__new__(A.Pair)
    small.a_bytes, small.b_bytes = [b"a", b"ba", b"", b"c"], [b"a", b"cba", b"a", b"x"]
    assert small.pair_bound() == sum(bool(x and y) and (x.endswith(y) or y.endswith(x)) for x in small.a_bytes for y in small.b_bytes)
    assert both.pair_bound() <= A.BROADCAST_PAIRS
