"""Alignment of two tokenizers over the same text (operator 11).

Tokenizer A reads a blank and the text, tokenizer B (a merge-type model that puts
the blank first by itself) the text, so the tokens of both spell the same bytes.
Each token's end is an event at a byte offset.  Where ends of both fall on one
offset, a group of tokens ends, and the last token of A in it is linked with the
last one of B, as these are the two whose ranges end there.

The events of both are united, dealt out by document and sorted on offsets, and a
machine goes over them whose state is what lies between the last common end and
the present offset.  Events travel in runs: a row has the ids of the tokens of
one side that end in one span of ``SPAN`` bytes of a document (a token's length
follows from its id), so a row is small however long the text is, and a document
has as many rows as its length asks for.

Encoding: a run of other characters that follows a blank or line feed is encoded
by itself, wherever neither tokenizer can join the two sides: after a printable
ASCII character, letter, digit or mark of ``\\w``, before blanks and line feeds.
Words recur, so their ids are remembered, in two generations that bound the
memory.  Texts for which the bytes of either side differ from blank + text
(U+2581 in a text comes back as a blank) have no tokens.

Counts of id pairs: the tokens of a link end together, so one's bytes are a suffix
of the other's.  ``pair_bound`` counts all id pairs of the two vocabularies for which
that holds: a bound of the count table that no corpus exceeds, checked before the
table is broadcast; a larger one is joined by a shuffle.

Defined results: null and empty texts have no tokens, zeros and ''.  Repeated rows
and null ids are documents of their own.  Strings of special tokens are plain text.
Extra columns are left out.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import pieces
from .store import save

SPAN = 1 << 16
BROADCAST_PAIRS = 4_000_000  # 24 bytes each
EVENTS = "doc long, doc_id long, span int, side int, ids binary"
PARTS = "doc long, doc_id long, part int, n_a long, n_b long, groups string, link_end array<long>, link_a array<int>, link_b array<int>"
SUMMARY = "doc long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a_id:int,b_id:int,times:long>>"


def _byte_alphabet() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and the ids of words."""

    def __init__(self, a_path: str, b_path: str) -> None:
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = pieces.encoder(b_path)
        alphabet = _byte_alphabet()
        self.a_bytes = self._table({i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()})
        model, known = self.b.model, self.b.pieces
        self.b_bytes = self._table({i: p.replace(pieces.BLANK, " ").encode() for p, i in known.ids.items()} | {i: bytes([v]) for v, i in enumerate(known.byte_ids)})
        if model.piece_to_id(pieces.BLANK) not in known.ids.values():
            raise ValueError("the model has no piece for a blank")
        self.blank = model.piece_to_id(pieces.BLANK)
        self.kind = "<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4"
        self.a_len = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_len = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.cut = re.compile(r"[ \n]*[^ \n]+(?:(?<![!-~\w])[ \n]+[^ \n]*)*|[ \n]+").findall
        self.words = pieces.Remembered(self._word)

    @staticmethod
    def _table(by_id: dict[int, bytes]) -> list[bytes]:
        table = [b""] * (max(by_id) + 1)
        for i, t in by_id.items():
            table[i] = t
        return table

    def _word(self, word: str) -> tuple[bytes, bytes] | None:
        """ids of a word by both, or None if either spells other bytes."""
        a = self.a.encode(word, add_special_tokens=False).ids
        if word[0] == " ":
            b = self.b.model.encode(word[1:]) if len(word) > 1 else [self.blank]
        else:  # a line feed, which joins nothing, so the blank put first stands alone
            b = self.b.model.encode(word)[1:]
        spelt = word.encode("utf-8", "surrogatepass")
        if b"".join(map(self.a_bytes.__getitem__, a)) != spelt or b"".join(map(self.b_bytes.__getitem__, b)) != spelt:
            return None
        return np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Packed ids of A and of B; none where they spell other bytes than blank + text."""
        if not text:
            return b"", b""
        parts = list(map(self.words.__getitem__, self.cut(" " + text)))
        if None in parts:
            return b"", b""
        a, b = zip(*parts, strict=True)
        return b"".join(a), b"".join(b)

    def pair_bound(self) -> int:
        """Number of (A id, B id) of which one's bytes are a suffix of the other's."""
        a, b = Counter(t for t in self.a_bytes if t), Counter(t for t in self.b_bytes if t)
        ending = lambda t, first: (t[i:] for i in range(first, len(t)))
        return sum(n * sum(b[s] for s in ending(t, 0)) for t, n in a.items()) + sum(n * sum(a[s] for s in ending(t, 1)) for t, n in b.items())


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """The worker's pair of tokenizers; its words outlast the task."""
    key = (a_path, b_path)
    if key not in _PAIRS:
        _PAIRS[key] = Pair(a_path, b_path)
    return _PAIRS[key]


def _spans(ids: bytes, lengths: np.ndarray, kind: str, size: int) -> list[bytes]:
    """The ids by the span of ``size`` bytes in which their tokens end, the first span even if empty."""
    tokens = np.frombuffer(ids, kind)
    ends = np.cumsum(lengths[tokens])
    if not len(ends) or ends[-1] <= size:
        return [ids]
    at = np.searchsorted(ends, np.arange(size, ends[-1] + size, size), side="right")
    return [tokens[lo:hi].tobytes() for lo, hi in zip([0, *at[:-1]], at, strict=True)]


def events(documents: DataFrame, a_path: str, b_path: str, span: int = SPAN) -> DataFrame:
    """End events of both tokenizers over ``documents`` (doc_id, text), in runs; ``doc`` numbers the rows."""
    schema = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("span", pa.int32()), ("side", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        doc = TaskContext.get().partitionId() << 40
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for i, name in enumerate(names):
                for side, (ids, lengths) in enumerate(zip(both.encode(texts[i].as_py()), (both.a_len, both.b_len), strict=True)):
                    rows.extend((doc, name, k, side, part) for k, part in enumerate(_spans(ids, lengths, both.kind, span)) if part or not k)
                doc += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, EVENTS)


class Sweep:
    """The machine over the events of one document: tokens since the last common end, and its offset."""

    def __init__(self, both: Pair) -> None:
        self.a_len, self.b_len = both.a_len, both.b_len
        self.a_text, self.b_text = self._text(len(both.a_bytes), "|"), self._text(len(both.b_bytes), ";")
        self.none = np.empty(0, both.kind)
        self.start()

    @staticmethod
    def _text(n: int, last: str) -> np.ndarray:
        """How id i is written inside of a group (2i) and at the end of its side (2i + 1)."""
        return np.array([f"{i}{mark}".encode() for i in range(n) for mark in (",", last)])

    def start(self) -> None:
        self.a = self.b = self.none
        self.offset = 0

    def span(self, a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Groups that end in the next span, written out, and for each of them its end and the linked ids."""
        a, b = np.concatenate([self.a, a]), np.concatenate([self.b, b])
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        seen = np.zeros(max(a_end[-1] if len(a) else 0, b_end[-1] if len(b) else 0) + 1, dtype=bool)
        seen[a_end] = True
        b_last = seen[b_end]
        seen[:] = False
        seen[b_end[b_last]] = True
        a_last = seen[a_end]
        at_a, at_b = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        if not len(at_a):
            self.a, self.b = a, b
            return b"", at_a, self.none, self.none
        na, nb = at_a[-1], at_b[-1]
        ends, links_a, links_b = self.offset + a_end[at_a - 1], a[at_a - 1], b[at_b - 1]
        self.a, self.b, self.offset = a[na:], b[nb:], int(ends[-1])
        a_last, b_last = a_last[:na], b_last[:nb]
        # a token's place among those written: after its own side's, and the other side's of the groups before (and, for B, of its own)
        text = np.empty(na + nb, dtype=max(self.a_text.dtype, self.b_text.dtype, key=lambda t: t.itemsize))
        text[np.arange(na) + np.concatenate([[0], at_b])[np.cumsum(a_last) - a_last]] = self.a_text[2 * a[:na].astype(np.int64) + a_last]
        text[np.arange(nb) + at_a[np.cumsum(b_last) - b_last]] = self.b_text[2 * b[:nb].astype(np.int64) + b_last]
        return text.tobytes().translate(None, b"\0"), ends, links_a, links_b


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc, doc_id, span, ids of A, ids of B) of sorted events; a side without a row has none."""
    held = None
    for batch in batches:
        docs, names, spans, sides = (batch.column(i).to_pylist() for i in range(4))
        ids = batch.column(4)
        for i, key in enumerate(zip(docs, names, spans, strict=True)):
            data = ids[i].as_buffer().to_pybytes() if sides[i] == 0 else ids[i].as_buffer()
            if sides[i] == 0:
                if held:
                    yield *held, b""
                held = (*key, data)
            elif held and held[:3] == key:
                yield *held, data
                held = None
            else:
                if held:
                    yield *held, b""
                    held = None
                yield *key, b"", data
    if held:
        yield *held, b""


def sweep(runs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Groups and links of every span of every document, in order within each partition.

    ``groups`` writes the groups that end in the span as ``a1,a2|b1;a3|b2,b3;``; for
    each of them ``link_end``, ``link_a`` and ``link_b`` have its end and the linked ids.
    """
    names = [c.split()[0] for c in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        machine = Sweep(both)
        now, size, kept = None, 0, []

        def flush() -> pa.RecordBatch:
            docs, ids, parts, na, nb, text, ends, a, b = zip(*kept, strict=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(e) for e in ends])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), t)) for x, t in ((ends, pa.int64()), (a, pa.int32()), (b, pa.int32()))]
            plain = [pa.array(docs, pa.int64()), pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(plain + lists, names)

        for doc, name, k, a, b in _rows(batches):
            if doc != now:
                machine.start()
                now = doc
            a, b = np.frombuffer(a, both.kind), np.frombuffer(b, both.kind)
            text, ends, link_a, link_b = machine.span(a, b)
            kept.append((doc, name, k, len(a), len(b), text, ends, link_a, link_b))
            size += len(text) + 256
            if size > 1 << 21:
                yield flush()
                kept.clear()
                size = 0
        if kept:
            yield flush()

    return runs.repartition("doc").sortWithinPartitions("doc", "span", "side").mapInArrow(run, PARTS)


def align(documents: DataFrame, a_path: str, b_path: str, span: int = SPAN) -> DataFrame:
    """Groups and links of ``documents`` (doc_id, text), one row for each span of a document (see ``sweep``)."""
    return sweep(events(documents, a_path, b_path, span), a_path, b_path)


def summarise(parts: DataFrame) -> DataFrame:
    """One row for each document of ``align``'s result, in the order it came in: counts, digest of the groups, linked id pairs with their times."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None  # doc, doc_id, n_a, n_b, groups, digest, codes of links, their number

        def merged(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            return code, np.bincount(back, np.concatenate(times), len(code)).astype(np.int64)

        def close() -> None:
            doc, name, na, nb, ng, sha, codes, times = state
            done.append((doc, name, na, nb, ng, sha.hexdigest() if ng else "", *merged(codes, times)))

        def flush() -> pa.RecordBatch:
            doc, name, na, nb, ng, sha, codes, times = zip(*done, strict=True)
            code = np.concatenate(codes)
            cells = pa.StructArray.from_arrays([pa.array(code >> 32, pa.int32()), pa.array(code & 0xFFFFFFFF, pa.int32()), pa.array(np.concatenate(times), pa.int64())], ["a_id", "b_id", "times"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(c) for c in codes])]), pa.int32()), cells)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, name, na, nb, ng, ng)] + [pa.array(sha, pa.string()), lists], names)

        for batch in batches:
            docs, ids, na, nb = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            text = batch.column(5)
            offsets = batch.column(7).offsets.to_numpy()
            code = batch.column(7).values.to_numpy().astype(np.int64) << 32 | batch.column(8).values.to_numpy()
            for i, doc in enumerate(docs):
                if state is None or state[0] != doc:
                    if state:
                        close()
                    state = [doc, ids[i], 0, 0, 0, hashlib.sha256(), [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
                lo, hi = offsets[i], offsets[i + 1]
                if hi > lo:
                    # a part's last mark waits for the next part, as the document's last group has none
                    state[5].update((b";" if state[4] else b"") + bytes(text[i].as_buffer())[:-1])
                    fresh, back = np.unique(code[lo:hi], return_counts=True)
                    state[6].append(fresh)
                    state[7].append(back)
                    if len(state[6]) > 64:
                        state[6:] = [[x] for x in merged(*state[6:])]
                state[2], state[3], state[4] = state[2] + na[i], state[3] + nb[i], state[4] + int(hi - lo)
            if done:
                yield flush()
        if state:
            close()
            yield flush()

    return parts.mapInArrow(run, SUMMARY)


def pair_counts(summary: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): links of each id pair in the whole corpus, and whether no other A id has more with this B id."""
    counts = summary.select(F.inline("pairs")).groupBy("a_id", "b_id").agg(F.sum("times").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))


def report(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Counts of tokens, groups and links of each document, and how common its linked id pairs are."""
    summary = save(summarise(align(documents, a_path, b_path)), "alignment")
    counts = pair_counts(summary)
    if pair(a_path, b_path).pair_bound() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    links = summary.select("doc", F.inline("pairs")).join(counts, ["a_id", "b_id"])
    scored = links.groupBy("doc").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return summary.drop("pairs").join(scored, "doc", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
