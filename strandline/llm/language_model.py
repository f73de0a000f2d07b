"""Interpolated modified Kneser-Ney n-gram model (operator 7).

Counting runs in Spark: every task counts the n-grams of its texts, combines
equal ones before the shuffle and sends them as sorted arrays to buckets of
their context.  A bucket adds the counts, stores its share of the model as
sorted arrays of 64-bit hashes in the shared folder, and passes the distinct
n-grams, first word dropped, to the next lower order, whose counts are those of
left contexts.  Workers that score map the arrays into memory and look n-grams
up by binary search, so no worker holds the model in its heap.

The discounts D1, D2, D3+ of each order come from the counts of counts of all
training texts.  The lowest order is interpolated with a uniform share for each
of the V words and one more for every unknown word, so probabilities sum to 1.

Defined results: a null or empty text is its end token.  Contexts never cross
texts.  With no training text every token has probability 1 / (V + 1) = 1.
Repeated rows count as often as they occur; a null ``doc_id`` is held out in no
case.  Only ``doc_id`` and ``text`` are read; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .sharedfiles import mapped, put
from .store import fresh_path, save, shuffle_partitions

ORDER = 2
BEGIN = np.uint64(0x2545F4914F6CDD1D)
END = np.uint64(0x61C8864680B583EB)
_FLUSH = 1_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """What the driver keeps of a model: where its arrays are and a few sums."""

    folder: str
    order: int
    buckets: tuple[int, ...]  # by order, from 1
    tokens: int
    words: int
    discounts: tuple[tuple[float, float, float], ...]  # by order, from 1
    left_total: int  # of the lowest order's counts
    left_counts: tuple[int, int, int]  # words met after 1, 2, 3 or more contexts


def extend(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tk.mix(context * _FACTOR + word)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets hold consecutive ranges of hashes."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def context_keys(columns: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        key = extend(key, c)
    return key


def token_columns(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each token of the texts (words, then the end) its order-1 predecessors and itself; the texts' bounds in them."""
    data = tk.LOWER[data]
    starts, ends, bounds = tk.word_spans(data, offsets)
    words = tk.Hasher(data).spans(starts, ends)
    n = len(offsets) - 1
    tokens = np.insert(words, bounds[1:], END)
    bounds = bounds + np.arange(n + 1)
    text = tk.owners(bounds)
    columns = [tokens]
    at = np.arange(len(tokens)) - bounds[text]
    for back in range(1, order):
        before = np.full(len(tokens), BEGIN)
        before[back:] = tokens[: len(tokens) - back]
        before[at < back] = BEGIN
        columns.insert(0, before)
    return columns, bounds


def combined(columns: list[np.ndarray], *counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Equal n-grams added up, in ascending order."""
    if len(columns[0]) == 0:
        return columns, list(counts)
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in columns], [np.add.reduceat(x[order], first) for x in counts]


def _emit(columns: list[np.ndarray], counts: list[np.ndarray], buckets: int, out: list) -> None:
    bucket = bucket_of(context_keys(columns[:-1] or columns), buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[b] : cuts[b + 1]]
        out.append((int(b), b"".join(c[at].tobytes() for c in columns), *(x[at].astype(np.uint32).tobytes() for x in counts)))


_SENT = "b int, grams binary, seen binary, raw binary"


def _sent(rows: list) -> pa.RecordBatch:
    b, grams, seen, raw = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), *(pa.array(x, pa.binary()) for x in (grams, seen, raw))], ["b", "grams", "seen", "raw"])


def _counted(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    def run(batches):
        held: list[list[np.ndarray]] = []

        def flush():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            columns, (seen,) = combined(columns, np.ones(len(columns[0]), dtype=np.int64))
            held.clear()
            rows: list = []
            _emit(columns, [seen, seen], buckets, rows)
            return _sent(rows)

        for batch in batches:
            for _, _, data, offsets in tk.chunks(batch.column(0)):
                held.append(token_columns(data, offsets, order)[0])
                if sum(len(c[0]) for c in held) >= _FLUSH:
                    yield flush()
        if held:
            yield flush()

    return texts.select("text").mapInArrow(run, _SENT)


def _reduced(sent: DataFrame, order: int, lower_buckets: int, folder: str) -> DataFrame:
    """Store one order's arrays; return next lower order's n-grams, and at b = -1 the counts of counts."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("b")[0].as_py()
        parts = [np.frombuffer(x.as_py(), dtype=np.uint64).reshape(order, -1) for x in group.column("grams")]
        seen = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in group.column("seen")]).astype(np.int64)
        raw = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in group.column("raw")]).astype(np.int64)
        columns, (seen, raw) = combined(list(np.concatenate(parts, axis=1)), seen, raw)
        of = np.array([(seen == k).sum() for k in (1, 2, 3, 4)] + [(seen >= 3).sum(), seen.sum(), raw.sum(), len(seen)], dtype=np.int64)
        rows: list = [(-1, of.tobytes(), b"", b"")]
        if order == 1:
            put(folder, f"1-{bucket}.key", columns[0])
            put(folder, f"1-{bucket}.seen", seen)
            put(folder, f"1-{bucket}.raw", raw)
        else:
            context = context_keys(columns[:-1])
            key = extend(context, columns[-1])
            by = np.argsort(key, kind="stable")
            put(folder, f"{order}-{bucket}.key", key[by])
            put(folder, f"{order}-{bucket}.seen", seen[by].astype(np.uint32))
            by = np.argsort(context, kind="stable")
            context, c = context[by], seen[by]
            new = np.ones(len(context), dtype=bool)
            new[1:] = context[1:] != context[:-1]
            first = np.flatnonzero(new)
            put(folder, f"{order}-{bucket}.context", context[first])
            put(folder, f"{order}-{bucket}.sums", np.stack([np.add.reduceat(x, first) for x in (c, c == 1, c == 2, c >= 3)]).astype(np.int64))
            lower, (left, total) = combined(columns[1:], np.ones(len(seen), dtype=np.int64), raw)
            _emit(lower, [left, total], lower_buckets, rows)
        return pa.Table.from_batches([_sent(rows)])

    return sent.groupBy("b").applyInArrow(run, _SENT)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; usual values where the counts of counts are too few."""
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(float(min(max(d, 0.0), k)) for d, k in zip(found, (1, 2, 3), strict=True))


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """A model of the column ``text``."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = texts.sparkSession
    buckets = 2 * shuffle_partitions(spark)
    # each bucket sends to every bucket of the next order, so lower orders have far fewer
    counts = [4 * math.isqrt(buckets)] * (order - 1) + [buckets]
    folder = fresh_path(spark, "ngrams")
    sent = _counted(texts, order, buckets)
    found: dict[int, np.ndarray] = {}
    for level in range(order, 0, -1):
        done = save(_reduced(sent, level, counts[max(level - 2, 0)], folder), f"ngrams-{level}")
        rows = [np.frombuffer(r.grams, dtype=np.int64) for r in done.where("b = -1").select("grams").collect()]  # one for each bucket
        found[level] = np.sum(rows, axis=0) if rows else np.zeros(8, dtype=np.int64)
        sent = done.where("b >= 0")
    lowest = [int(x) for x in found[1]]
    return Model(folder, order, tuple(counts), lowest[6], lowest[7], tuple(discounts(*map(int, found[k][:4])) for k in range(1, order + 1)), lowest[5], (lowest[0], lowest[1], lowest[4]))


_OPEN: dict[str, tuple] = {}


class Reader:
    """Look-ups in the mapped arrays of one order."""

    def __init__(self, model: Model, level: int) -> None:
        self.model, self.level, self.arrays = model, level, {}

    def array(self, bucket: int, name: str, dtype: str):
        if (bucket, name) not in self.arrays:
            try:
                found = mapped(self.model.folder, f"{self.level}-{bucket}.{name}", dtype)
            except FileNotFoundError:  # a bucket without n-grams
                found = np.empty(0, dtype)
            self.arrays[bucket, name] = found
        return self.arrays[bucket, name]

    def find(self, key: np.ndarray, bucket: np.ndarray, keys: str, *values: tuple[str, str, int]) -> list[np.ndarray]:
        """For each key its values, zero where it is not held."""
        out = [np.zeros((width, len(key)), dtype=np.int64) for _, _, width in values]
        order = np.lexsort((key, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(self.model.buckets[self.level - 1] + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[b] : cuts[b + 1]]
            held = self.array(int(b), keys, "<u8")
            if len(held) == 0:
                continue
            place = np.searchsorted(held, key[at])
            place[place == len(held)] = 0
            known = held[place] == key[at]
            at, place = at[known], place[known]
            for target, (name, dtype, width) in zip(out, values, strict=True):
                target[:, at] = self.array(int(b), name, dtype).reshape(width, -1)[:, place]
        return out


def discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3)], 0.0)


def probabilities(model: Model, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: its probability, and its count in the training texts."""
    if model.folder not in _OPEN:
        _OPEN.clear()
        _OPEN[model.folder] = tuple(Reader(model, k) for k in range(1, model.order + 1))
    readers = _OPEN[model.folder]
    word = columns[-1]
    seen, raw = (x[0] for x in readers[0].find(word, bucket_of(extend(np.zeros(len(word), np.uint64), word), model.buckets[0]), "key", ("seen", "<i8", 1), ("raw", "<i8", 1)))
    d = model.discounts[0]
    uniform = 1.0 / (model.words + 1)
    if model.left_total:
        spare = float(np.dot(d, model.left_counts)) / model.left_total
        p = discounted(seen, d) / model.left_total + spare * uniform
    else:
        p = np.full(len(word), uniform)
    for level in range(2, model.order + 1):
        context = context_keys(columns[-level:-1])
        bucket = bucket_of(context, model.buckets[level - 1])
        count = readers[level - 1].find(extend(context, word), bucket, "key", ("seen", "<u4", 1))[0][0]
        total, one, two, more = readers[level - 1].find(context, bucket, "context", ("sums", "<i8", 4))[0]
        d = model.discounts[level - 1]
        known = total > 0
        share = np.maximum(total, 1)
        p = np.where(known, discounted(count, d) / share + (d[0] * one + d[1] * two + d[2] * more) / share * p, p)
    return p, raw


def score(documents: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""

    def run(batches):
        for batch in batches:
            parts = []
            for _, _, data, offsets in tk.chunks(batch.column(2)):
                columns, bounds = token_columns(data, offsets, model.order)
                p, c = probabilities(model, columns)
                base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
                parts.append((np.diff(bounds), np.add.reduceat((c > 0).astype(np.int64), bounds[:-1]), np.add.reduceat(base, bounds[:-1]), np.add.reduceat(np.log10(p), bounds[:-1])))
            n, known, base, own = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
            train_tokens = pa.array(np.full(len(n), model.tokens, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), train_tokens, pa.array(base), pa.array(own)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return documents.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def report(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """Score every document by a model of those that are not held out."""
    model = train(documents.where(~is_held_out()), order)
    return score(documents, model, is_held_out())
