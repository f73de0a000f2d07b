"""Packing into fixed-length sequences by vector bin packing (operator 3).

Items have a vector of sizes (tokens, segments, loss-bearing tokens) and every
sequence has a limit in each.  The dot-product heuristic fills one sequence at
a time: among the items of a bounded window that fit, it takes the one whose
vector, in units of the limits, has the largest dot product with the space
left.  When none fits, the best item is cut at the token limit, so a sequence
closes short only when its segments or loss-bearing tokens run out.  What
remains at the end of a partition is closed in lengths that are powers of two,
which need no padding.

Packing happens where the rows are: no shuffle, no group, and the memory of a
task is one Arrow batch plus the window.  A partition's sequences are numbered
from ``partition << 33``, so a retried task numbers them alike.

Loss-bearing tokens: of a plain document all but its first, which nothing
precedes; of a conversation those of the assistant's turns.  A conversation is
one item of at most ``TURNS`` turns, with its own count of them.

Special tokens that the tokenizer's file names count as such where a text holds
them as written there.

Defined results: a null or empty text is its end token alone.  Repeated rows
are packed each by itself.  Texts of any length are cut into full sequences
first.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
TURNS = 64
END_ID = 2
_CACHE_WORDS = 600_000
_CACHE_CHARS = 48
_LETTERS = "[a-zß-öø-ÿ]+"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096
    window: int = 256


class WordEncoder(dict):
    """ids of whole texts; a dict of encoded words in two generations, which bounds its memory.

    The tokenizer of ``word_bpe_49k.json`` never lets a token or a normalised
    character cross white space, so a text's ids are those of its runs between
    blanks and line feeds, one after the other; letters before a full stop or
    comma are a token run of their own, and A-Z count as a-z.  Runs are encoded
    once and remembered as little-endian 32-bit ids.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # those in runs were not written as the file has them
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {c: pack_ids([i]) for c, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        self.older: dict[str, bytes] = {}
        self.split = re.compile(f"{_LETTERS}(?=[.,])|[^ \n]+").findall
        self.plain = re.compile(_LETTERS).fullmatch
        # how the byte-level step writes the letters of plain words
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(ord("ß"), ord("ÿ") + 1)) if self.plain(c)}
        self.merge = self.tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if self.plain(word):  # one run of lower-case letters: the merges alone are left to do
                ids = pack_ids([t.id for t in self.merge(word if word.isascii() else word.translate(self.written))])
            else:
                ids = pack_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= _CACHE_CHARS:
            if len(self) >= _CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if self.cut and any(c in text for c in self.special):
            return b"".join(self.special.get(part) or self._plain(part) for part in self.cut(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        low = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
        return b"".join(map(self.__getitem__, self.split(low)))


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; its cache outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Packer:
    """The open sequence and the window of waiting items; ``emit`` gets each piece."""

    def __init__(self, limits: Limits, first_id: int, emit: Callable[[tuple], None]) -> None:
        self.limits, self.sequence, self.emit = limits, first_id, emit
        self.size = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
        self.items: list[list] = []  # [row, ids, start, how many of the tokens before each one bear loss]
        self.need = np.zeros((limits.window + 1, 3))
        self._open()

    def _open(self) -> None:
        self.left = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], dtype=np.int64)
        self.offset = 0

    def _close(self) -> None:
        if self.offset:
            self.sequence += 1
        self._open()

    def _loss(self, item: list, tokens: int) -> int:
        """Loss-bearing ones of the item's next tokens."""
        return int(item[3][item[2] + tokens] - item[3][item[2]])

    def _room(self, item: list) -> int:
        """How many of the item's next tokens the open sequence can take."""
        bearing = int(np.searchsorted(item[3], item[3][item[2]] + self.left[2], side="right")) - 1 - item[2]
        return min(int(self.left[0]), bearing)

    def _put(self, item: list, tokens: int) -> None:
        """Place the item's next ``tokens`` tokens in the open sequence."""
        row, ids, start, _ = item
        piece = ids[4 * start : 4 * (start + tokens)]
        loss = self._loss(item, tokens)
        self.emit((row, start, tokens, zlib.crc32(piece), len(ids) // 4, self.sequence, self.offset, loss))
        self.offset += tokens
        self.left -= (tokens, 1, loss)
        item[2] = start + tokens
        if not self.left[:2].all():
            self._close()

    def add(self, row: int | None, ids: bytes, bearing: np.ndarray) -> None:
        """An item and, for each of its tokens and the end, how many before it bear loss."""
        item = [row, ids, 0, bearing]
        full = self.limits.tokens
        while len(ids) // 4 - item[2] >= full and self.offset == 0 and self._loss(item, full) <= self.limits.loss_tokens:
            self._put(item, full)
        if len(ids) // 4 - item[2]:
            self._wait(item)
            while len(self.items) > self.limits.window:
                self._step()

    def _need(self, item: list) -> tuple[int, int, int]:
        tokens = len(item[1]) // 4 - item[2]
        return tokens, 1, self._loss(item, tokens)

    def _wait(self, item: list) -> None:
        self.need[len(self.items)] = self._need(item)
        self.items.append(item)

    def _step(self) -> None:
        """One placement by the dot-product heuristic."""
        need = self.need[: len(self.items)]
        fits = (need <= self.left).all(axis=1)
        gain = (need / self.size) @ (self.left / self.size)
        whole = bool(fits.any())
        best = int(np.argmax(np.where(fits, gain, -1.0) if whole else gain))
        item = self.items[best]
        tokens = min(len(item[1]) // 4 - item[2], self._room(item))
        if tokens == 0:  # loss-bearing room is gone and nothing that waits needs none
            self._close()
            return
        self._put(item, tokens)
        rest = len(item[1]) // 4 - item[2]
        if rest:
            self.need[best] = self._need(item)
        else:
            self.items[best] = self.items[-1]
            self.need[best] = self.need[len(self.items) - 1]
            self.items.pop()

    def finish(self) -> None:
        """Pack the window; then what doesn't fill a sequence goes to sequences as long as powers of two."""
        while self.items and sum(len(i[1]) // 4 - i[2] for i in self.items) + self.offset >= self.limits.tokens:
            self._step()
        waiting, self.items = self.items, []
        rest = sum(len(i[1]) // 4 - i[2] for i in waiting)
        if self.offset:  # the open sequence takes what brings it to a power of two, if that can be reached
            goal = 1 << (self.offset - 1).bit_length()
            if goal > self.offset + rest:
                goal = self.offset + rest
            rest -= self._fill(waiting, goal - self.offset)
            self._close()
        while rest:
            rest -= self._fill(waiting, 1 << (min(rest, self.limits.tokens).bit_length() - 1))
            self._close()

    def _fill(self, waiting: list[list], tokens: int) -> int:
        done = 0
        while done < tokens and waiting:
            item = waiting[-1]
            part = min(tokens - done, len(item[1]) // 4 - item[2], self._room(item))
            sequence = self.sequence
            if part == 0:
                self._close()
                break
            self._put(item, part)
            done += part
            if item[2] == len(item[1]) // 4:
                waiting.pop()
            if self.sequence != sequence:
                break
        return done


def _packed(items: DataFrame, tokenizer_path: str, limits: Limits, keep_words: bool, read) -> DataFrame:
    """Pieces of items; ``read(encode, batch)`` yields (id, ids, bearing) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path) if keep_words else WordEncoder(tokenizer_path)
        pieces: list[tuple] = []
        packer = Packer(limits, TaskContext.get().partitionId() << 33, pieces.append)
        schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*pieces, strict=True) if pieces else [[]] * len(schema))], schema=schema)
        for batch in batches:
            for item in read(encode, batch):
                packer.add(*item)
                if len(pieces) >= 1 << 16:
                    yield flush()
                    pieces.clear()
        packer.finish()
        if pieces:
            yield flush()

    return items.mapInArrow(run, PIECES)


def pack(documents: DataFrame, tokenizer_path: str, limits: Limits = Limits(), loss: str | None = None, keep_words: bool = True, order: list[str] | None = None) -> DataFrame:
    """Pieces of every document of ``documents`` (doc_id, text[, loss column: false where none of its tokens bears loss]).

    With ``order``, columns that sort the rows, tasks take consecutive ranges of
    the rows in that order and number their sequences along it.
    With ``keep_words`` a worker's encoded words outlast the task; without, it
    gives their memory back, for workers that go on to other stages.
    """
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def read(encode, batch):
        ids, texts, bearing = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        for i, doc in enumerate(ids):
            text = texts[i].as_py()
            tokens = (encode(text) if text else b"") + end
            counted = np.arange(-1, len(tokens) // 4) if bearing[i].as_py() is not False else np.zeros(len(tokens) // 4 + 1, np.int64)
            counted[0] = 0
            yield doc, tokens, counted

    if order:
        documents = documents.select("*", *[F.col(c).alias(f"_sl_order{i}") for i, c in enumerate(order)])
        keys = [f"_sl_order{i}" for i in range(len(order))]
        documents = documents.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.col(loss).cast("boolean") if loss else F.lit(True)).alias("loss"))
    return _packed(rows, tokenizer_path, limits, keep_words, read)


def pack_conversations(conversations: DataFrame, tokenizer_path: str, limits: Limits = Limits(segments=64, loss_tokens=2048)) -> DataFrame:
    """Pieces of conversations (conv_id, turn, role, text), ``doc_id`` being the conv_id.

    The turns of a conversation follow each other, each with its end token; only
    the assistant's bear loss.  Rows without an id or a turn are conversations
    of their own kind and sort first; repeated rows stay.
    """
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    part = F.expr(f"cast(turn as long) div {TURNS}")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    listed = conversations.groupBy(F.col("conv_id").cast("long").alias("doc_id"), part.alias("part")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def read(encode, batch):
        for doc, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            parts = [((encode(t["text"]) if t["text"] else b"") + end, t["role"] == "assistant") for t in turns.as_py()]
            bearing = np.repeat([b for _, b in parts], [len(ids) // 4 for ids, _ in parts])
            yield doc, b"".join(ids for ids, _ in parts), np.concatenate([[0], np.cumsum(bearing)])

    return _packed(listed.select("doc_id", "turns"), tokenizer_path, limits, True, read)
