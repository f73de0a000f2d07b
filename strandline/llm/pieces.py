"""SentencePiece encoding and decoding of whole texts (operator 13).

A merge-type model joins, again and again, the adjacent pair whose joined piece
has the highest score (the leftmost of equals).  That result is found here
without running the merges over the text: a sequence of pieces is the result
exactly if merging every two neighbours by themselves gives these two back.
(Take the first merge of the whole run that would cross a border between two
pieces; until then each piece grows as it does in the run over the two alone, so
that run would make the same merge.)  So the encoder

* finds the longest piece at every position with an Aho-Corasick automaton,
* goes forward by the longest piece that is compatible with the one before,
  where compatible means that re-merging the two leaves them as they are,
* takes shorter pieces when it is stuck and then goes back, noting in a bitfield
  the positions from which nothing led on.  As the result up to a position is
  unique, such a position never needs to be tried again, so the work is linear.

A character that is no piece stands for itself and is written as byte pieces.
No piece goes on with a blank after another character and none holds a line
feed (checked when a model is read), so texts are cut there and the ids of
words are remembered, in two generations that bound the memory.

Defined results: a null text is an empty one; an empty text has the begin and
end ids alone.  U+2581 counts as a blank, as in the library, so it comes back
as one.  Repeated rows are encoded each by itself, extra columns are left out,
and an empty table gives no rows.  Texts and words may be of any length.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import binary

BLANK = "▁"
_WORDS = 300_000
_WORD_CHARS = 48
_PAIRS = 500_000


class Remembered(dict):
    """Results of ``make`` by word, in two generations; long words aren't kept."""

    def __init__(self, make: Callable[[str], object], words: int = _WORDS, chars: int = _WORD_CHARS) -> None:
        super().__init__()
        self.make, self.words, self.chars, self.older = make, words, chars, {}

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= self.chars:
            if len(self) >= self.words:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Pieces:
    """The pieces of a merge-type model and their exact encoding of words."""

    def __init__(self, ids: dict[str, int], score: dict[str, float], byte_ids: list[int]) -> None:
        import ahocorasick

        self.ids, self.score, self.byte_ids = ids, score, byte_ids
        self.automaton = ahocorasick.Automaton()
        for piece in ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str | None] = {}

    def remerge(self, text: str) -> list[str]:
        """The model's own merges over a short text."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: str, piece: str) -> bool:
        """Whether merging the two leaves them as they are; before the first piece stands an empty one."""
        key = (before, piece)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.remerge(before + piece) == [p for p in key if p]
        return found

    def next_shorter(self, piece: str) -> str | None:
        """The longest piece that ``piece`` properly starts with, at last its first character."""
        if piece in self.shorter:
            return self.shorter[piece]
        found = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.ids), None)
        self.shorter[piece] = found
        return found

    def split(self, word: str) -> list[str]:
        """The word's pieces, by backtracking."""
        n = len(word)
        longest: list[str | None] = [None] * n
        for end, piece in self.automaton.iter(word):  # ends ascend, so the longest piece of a start is the last one seen
            longest[end - len(piece) + 1] = piece
        failed = bytearray((n >> 3) + 1)
        path: list[str] = [""]
        at, piece = 0, longest[0] or word[0]
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and self.compatible(path[-1], piece):
                path.append(piece)
                if end == n:
                    return path[1:]
                at, piece = end, longest[end] or word[end]
                continue
            while (less := self.next_shorter(piece)) is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = path.pop()
                at -= len(piece)
            piece = less

    def encode(self, word: str) -> bytes:
        """ids of a word (blanks written as U+2581), little-endian, 32 bits each."""
        out: list[int] = []
        for piece in self.split(word):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(out)}I", *out)


class Encoder:
    """Texts to ids and back with one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in every]
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        probe = "ﬁ Å  x "
        if model.normalize(probe) != BLANK + probe.replace(" ", BLANK) or not all(map(model.is_byte, byte_ids)):
            raise ValueError("the model must change blanks alone, put one first and fall back to bytes")
        if any("\n" in names[i] or re.search(f"[^{BLANK}]{BLANK}", names[i]) for i in plain):
            raise ValueError("the model's pieces cross words")
        self.pieces = Pieces({names[i]: i for i in plain}, {names[i]: model.get_score(i) for i in plain}, byte_ids)
        self.words = Remembered(self.pieces.encode)
        self.cut = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n").findall
        self.begin, self.end = struct.pack("<I", model.bos_id()), struct.pack("<I", model.eos_id())

    def encode(self, text: str) -> bytes:
        """ids without begin and end, packed."""
        if not text:
            return b""
        return b"".join(map(self.words.__getitem__, self.cut(BLANK + text.replace(" ", BLANK))))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; its words outlast the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(documents: DataFrame, model_path: str, ends: bool = True) -> DataFrame:
    """(doc_id, ids) of every row of ``documents`` (doc_id, text); ids are little-endian unsigned 32-bit, with begin and end if ``ends``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path)
        head, tail = (e.begin, e.end) if ends else (b"", b"")
        for batch in batches:
            texts = batch.column(1)
            ids = [head + e.encode(texts[i].as_py() or "") + tail for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the library's text of each row's ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path).model
        for batch in batches:
            ids = binary(batch.column(1))
            texts = [model.decode(np.frombuffer(ids[i].as_buffer(), "<u4").tolist()) if len(ids[i].as_buffer()) else "" for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def report(documents: DataFrame, model_path: str) -> DataFrame:
    """Number and digest of each document's ids, and digest of the text that they decode to."""
    both = decode(encode(documents, model_path), model_path)
    return both.select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
