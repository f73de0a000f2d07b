"""Toxicity by maximum-scoring segments (operator 4).

*Log-odds.*  From labelled documents, a word's rate in toxic against clean
documents is shrunk by a Dirichlet prior of ``PRIOR`` pseudo-documents whose
mean is the ratio of the word's five-byte prefix, in turn shrunk to that of its
four-byte prefix, in turn to one.  Words never seen are scored by their prefix,
which carries inflected forms; the rest cost ``NEUTRAL`` each.  A word or prefix
is scored if its rates differ significantly (a likelihood-ratio statistic of
``SIGNIFICANCE``, one chance in a million) and by a factor of ``LEAST_RATIO`` at
least; both bars are the same at every size, so a word that is kept on a small
table is kept on a larger one.  Copies are no evidence of their own: documents
with the same smallest shingle hash count once for each word.

*Segments.*  A linear scan keeps, as a list of disjoint candidates with the
running sums at their ends, every maximal segment: one that no longer or
shorter segment around it can better.  Each candidate points at the nearest
earlier one that starts lower, and no pointer is followed twice.

*Extreme values.*  The chance that neutral text of n words holds a segment of
score S is 1 - exp(-K n exp(-lambda S)).  Lambda solves E[exp(lambda s)] = 1 over
the word scores of clean training documents, K is fitted to their segments.  A
document's evidence is the sum of -log10 of these chances over its significant
segments; a logistic curve, fitted on the training documents, turns it into a
score from 0 to 1.

Training reads at most about ``MAX_LABELLED`` labelled documents (chosen by a
hash of the id), which bounds the scored words that are collected and sent to
the workers.  Scoring reads all texts whole.

Defined results: null and empty texts have no segments and get the curve's
value for no evidence; labels that are null, neither 0 nor 1, or without a
document are not used; repeated labels of a document count once each; without
usable labels of both kinds every score is 0.  Only ``doc_id`` and ``text``
feed a score; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import save

MAX_LABELLED = 40_000
PRIOR = 4.0
NEUTRAL = 0.10
LEAST_RATIO = 3.0
SIGNIFICANCE = 24.0
SIGNIFICANT = 0.05
THRESHOLD = 0.7
MOST_EVIDENCE = 30.0
PREFIXES = (4, 5)

#: bytes that end a word: ASCII other than letters and digits
_BREAK = np.ones(256, dtype=bool)
_BREAK[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _BREAK[_a:_b] = False


_MASK = (1 << 18) - 1


@dataclass(frozen=True)
class Model:
    names: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # ascending hashes of words and prefixes
    scores: np.ndarray = field(default_factory=lambda: np.empty(0))
    mask: np.ndarray = field(default_factory=lambda: np.zeros(_MASK + 1, dtype=bool))  # low bits of the names
    decay: float = 1.0  # lambda
    scale: float = 1.0  # K
    intercept: float = -math.inf
    slope: float = 0.0

    def word_scores(self, words: Words) -> np.ndarray:
        """Scores of words: the word's own, else its longer prefix's, else its shorter one's; zero for none."""
        out = np.zeros(len(words.starts))
        if len(self.names) == 0:
            return out
        # a word can only be known if its shortest prefix is, and few are
        last = words.feature(len(PREFIXES))
        todo = np.flatnonzero(self.mask[last & np.uint64(_MASK)])
        todo = todo[self._known(last[todo])[1]]
        for level in range(len(PREFIXES) + 1):
            place, known = self._known(words.feature(level, todo))
            out[todo[known]] = self.scores[place[known]]
            todo = todo[~known]
        return out

    def _known(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.names, names)
        place[place == len(self.names)] = 0
        return place, self.names[place] == names

    def chance(self, score: float, words: int) -> float:
        return -math.expm1(-self.scale * words * math.exp(-self.decay * score))

    def probability(self, evidence: float) -> float:
        if self.intercept == -math.inf:
            return 0.0
        return 1.0 / (1.0 + math.exp(min(700.0, max(-700.0, -(self.intercept + self.slope * evidence)))))


class Words:
    """Words of one chunk (letters and digits, A-Z lower-cased) and the hashes of themselves and their prefixes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        low = tk.LOWER[data]
        self.starts, self.ends, self.bounds = tk.word_spans(np.where(_BREAK[low], np.uint8(32), low), offsets)
        self.hasher = tk.Hasher(low)

    def feature(self, level: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the words (0), their longer (1) or shorter prefix (2); marked by level, as a prefix may be a word too."""
        starts, ends = (self.starts, self.ends) if at is None else (self.starts[at], self.ends[at])
        length = (1 << 40, *sorted(PREFIXES, reverse=True))[level]
        return tk.mix(self.hasher.spans(starts, np.minimum(ends, starts + length)) + np.uint64(length))


def maximal_segments(scores: list[float], gaps: list[int], neutral: float = NEUTRAL) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence of scored words, each preceded by so many neutral ones.

    Candidates are kept with the running sum before and after them.  A new one
    is joined to the last candidate that starts lower, if it ends higher; it
    swallows those between.  As all candidates between one and the ``lower`` one
    it points at start no lower than it, the search may skip them.
    """
    first: list[int] = []
    last: list[int] = []
    before: list[float] = []
    after: list[float] = []
    lower: list[int] = []
    total = 0.0
    for i, (s, gap) in enumerate(zip(scores, gaps, strict=True)):
        total -= neutral * gap
        if s <= 0:
            total += s
            continue
        begin, start = i, total
        total += s
        j = len(first) - 1
        while j >= 0 and before[j] >= start:
            j = lower[j]
        while j >= 0 and after[j] < total:
            begin, start = first[j], before[j]
            for kept in (first, last, before, after):
                del kept[j:]
            up = lower[j]
            del lower[j:]
            j = up
        for kept, value in ((first, begin), (last, i), (before, start), (after, total), (lower, j)):
            kept.append(value)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, before, after, strict=True)]


def _scan(model: Model, data: np.ndarray, offsets: np.ndarray):
    """For each text: index, words, the indexes of its scored words, and its maximal segments over them."""
    found = Words(data, offsets)
    starts, ends, bounds = found.starts, found.ends, found.bounds
    score = model.word_scores(found)
    hit = np.flatnonzero(score)
    cuts = np.searchsorted(hit, bounds)
    for t in range(len(offsets) - 1):
        at = hit[cuts[t] : cuts[t + 1]]
        words = int(bounds[t + 1] - bounds[t])
        if len(at) == 0:
            yield t, words, at, score[at], [], starts, ends
            continue
        gaps = np.diff(at, prepend=bounds[t] - 1) - 1
        yield t, words, at, score[at], maximal_segments(score[at].tolist(), gaps.tolist()), starts, ends


def evidence(model: Model, words: int, segments: list[tuple[int, int, float]]) -> float:
    total = 0.0
    for _, _, s in segments:
        p = max(model.chance(s, words), 1e-12)
        if p < SIGNIFICANT:
            total -= math.log10(p)
    return total


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(documents: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(toxic, text) of about ``limit`` labelled training documents at most."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out())
    rows = usable.count()
    if rows > limit:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * limit / rows))
    # bounded by the limit, so it can be broadcast and no text is shuffled
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(F.broadcast(usable), "doc_id").select("toxic", "text")


def _copies(found: Words) -> np.ndarray:
    """A name for each text that its near copies mostly share: the smallest hash of its five-word shingles, or of its words."""
    words = found.feature(0)
    name = np.full(len(found.bounds) - 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    shingle, text, _ = tk.windows(words, found.bounds, 5)
    np.minimum.at(name, text, shingle)
    short = np.diff(found.bounds) < 5
    text = tk.owners(found.bounds)
    few = short[text]
    np.minimum.at(name, text[few], words[few])
    return name


def _word_counts(sample: DataFrame) -> DataFrame:
    """(name, longer, shorter, toxic, clean): documents of either kind that hold a word, copies once, by the hashes of the word and its prefixes."""

    def run(batches):
        for batch in batches:
            toxic = np.asarray(batch.column(0)) == 1
            for lo, hi, data, offsets in tk.chunks(batch.column(1)):
                found = Words(data, offsets)
                features = [found.feature(k) for k in range(len(PREFIXES) + 1)]
                text = tk.owners(found.bounds)
                group = _copies(found)[text]
                bad = toxic[lo:hi][text]
                order = np.lexsort((bad, group, features[0]))
                columns = [features[0][order], group[order], bad[order]]
                new = np.ones(len(order), dtype=bool)
                new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
                at = order[new]
                yield pa.RecordBatch.from_arrays([*(pa.array(tk.signed(f[at])) for f in features), pa.array(tk.signed(group[at])), pa.array(bad[at])], ["name", "longer", "shorter", "copies", "bad"])

    once = sample.mapInArrow(run, "name long, longer long, shorter long, copies long, bad boolean").distinct()
    return once.groupBy("name", "longer", "shorter").agg(F.count_if("bad").alias("toxic"), F.count_if(~F.col("bad")).alias("clean"))


def _significance(t: str, c: str, toxic: int, clean: int) -> Column:
    """Twice the log-likelihood ratio of a share of toxic documents above that of all."""
    part = toxic / (toxic + clean)
    n = F.col(t) + F.col(c)
    term = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    return F.when(F.col(t) > n * part, 2 * (term(F.col(t), part) + term(F.col(c), 1 - part))).otherwise(0.0)


def _ratios(counts: DataFrame, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log-odds of the words and prefixes whose ratio stands out."""

    def shrunk(t: str, c: str, mean) -> Column:
        expected = F.col(c) * F.lit(toxic / clean)
        return (F.col(t) + PRIOR * mean) / (expected + PRIOR)

    def kept(ratio: str, t: str, c: str) -> Column:
        return (F.col(ratio) >= LEAST_RATIO) & (_significance(t, c, toxic, clean) >= SIGNIFICANCE)

    ratio, stands_out = counts, F.lit(False)
    for level, name in enumerate(("shorter", "longer")):
        sums = counts.groupBy(name).agg(F.sum("toxic").alias(f"t{level}"), F.sum("clean").alias(f"c{level}"))
        ratio = ratio.join(sums, name).withColumn(f"r_{name}", shrunk(f"t{level}", f"c{level}", F.lit(1.0) if level == 0 else F.col("r_shorter")))
        stands_out = stands_out | kept(f"r_{name}", f"t{level}", f"c{level}")
    ratio = ratio.withColumn("r_name", shrunk("toxic", "clean", F.col("r_longer")))
    # words of the bounded sample; each stands in several of its toxic documents, or shares its prefix with such
    rows = ratio.where(stands_out | kept("r_name", "toxic", "clean")).select("name", "longer", "shorter", "r_name", "r_longer", "r_shorter").toPandas()
    names, scores = [], []
    for level in ("shorter", "longer", "name"):
        names.append(rows[level].to_numpy(np.int64))
        scores.append(np.log(rows[f"r_{level}"].to_numpy(np.float64)))
    name, first = np.unique(np.concatenate(names).view(np.uint64), return_index=True)
    value = np.concatenate(scores)[first]
    # zero would mean an unknown word
    return name, np.where(value == 0, -1e-9, value)


def _histogram(sample: DataFrame, measure) -> dict[tuple[str, int, int], int]:
    """Counts of (kind, toxic, level) over the sample; ``measure`` gives the (kind, level, count) of one document."""

    def run(batches):
        for batch in batches:
            held: Counter = Counter()
            for lo, _, data, offsets in tk.chunks(batch.column(1)):
                for t, toxic, kinds in measure(data, offsets, batch.column(0)[lo : lo + len(offsets) - 1].to_pylist()):
                    for kind, level, n in kinds:
                        held[kind, toxic, level] += n
            rows = [(*k, n) for k, n in held.items()]
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], ["kind", "toxic", "level", "n"])

    counted = sample.mapInArrow(run, "kind string, toxic int, level long, n long").groupBy("kind", "toxic", "level").agg(F.sum("n").alias("n"))
    return {(r.kind, r.toxic, r.level): r.n for r in counted.collect()}  # scores in hundredths, at most some thousands of rows


def _levels(model: Model):
    """Of each document: its words, word scores and segment scores, in hundredths."""

    def measure(data, offsets, labels):
        for t, words, _, scores, segments, _, _ in _scan(model, data, offsets):
            at, n = np.unique(np.rint(scores * 100).astype(np.int64), return_counts=True)
            yield t, labels[t], [("words", 0, words), *(("score", a, b) for a, b in zip(at.tolist(), n.tolist(), strict=True)), *(("segment", round(s * 100), 1) for _, _, s in segments)]

    return measure


def _evidence_levels(model: Model):
    """Of each document: its evidence in tenths."""

    def measure(data, offsets, labels):
        for t, words, _, _, segments, _, _ in _scan(model, data, offsets):
            yield t, labels[t], [("evidence", round(min(evidence(model, words, segments), MOST_EVIDENCE) * 10), 1)]

    return measure


def _decay(scores: np.ndarray, counts: np.ndarray, neutral: int) -> float:
    """Lambda > 0 with mean exp(lambda s) = 1, where one more word has the highest score seen."""
    top = float(scores.max()) if len(scores) else 1.0
    n = counts.sum() + neutral + 1

    def excess(x: float) -> float:
        return ((counts * np.exp(x * scores)).sum() + math.exp(x * max(top, 1.0)) + neutral * math.exp(-x * NEUTRAL)) / n - 1.0

    low, high = 1e-6, 1e-6
    while high < 50 and excess(high) <= 0:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) <= 0 else (low, middle)
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over n observations each, with a weak ridge; Newton steps."""
    design = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n * (p - y)) + 1e-2 * w
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """A model from the labels of documents that are not held out."""
    sample = save(_sample(documents, labels, limit), "labelled")
    kinds = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not kinds.get(0) or not kinds.get(1):
        return Model()
    names, scores = _ratios(save(_word_counts(sample), "words"), kinds[1], kinds[0])
    mask = np.zeros(_MASK + 1, dtype=bool)
    mask[names & np.uint64(_MASK)] = True
    model = Model(names, scores, mask)
    seen = _histogram(sample, _levels(model))
    clean = lambda kind: np.array(sorted((level / 100, n) for (k, toxic, level), n in seen.items() if k == kind and toxic == 0)).reshape(-1, 2)
    words, value, segments = sum(n for (k, toxic, _), n in seen.items() if k == "words" and toxic == 0), clean("score"), clean("segment")
    decay = _decay(value[:, 0], value[:, 1], int(words - value[:, 1].sum()))
    # K: clean segments met, and one more, against those that exp(-lambda S) leads to expect
    floor = float(segments[0, 0]) if len(segments) else 1.0
    scale = (segments[:, 1].sum() + 1) / max(words * math.exp(-decay * floor), 1e-9)
    model = replace(model, decay=decay, scale=float(scale))
    levels = [(level / 10, toxic, n) for (_, toxic, level), n in _histogram(sample, _evidence_levels(model)).items()]
    intercept, slope = _logistic(*np.array(sorted(levels), dtype=np.float64).T)
    return replace(model, intercept=intercept, slope=slope)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches):
        for batch in batches:
            out = []
            for _, _, data, offsets in tk.chunks(batch.column(1)):
                out += [model.probability(min(evidence(model, words, segments), MOST_EVIDENCE)) for _, words, _, _, segments, _, _ in _scan(model, data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.float64()), pa.array([int(s >= THRESHOLD) for s in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), is_held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def passages(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, first_byte, end_byte, segment_score, chance of every significant segment."""
    schema = "doc_id long, first_byte long, end_byte long, segment_score double, chance double"

    def run(batches):
        for batch in batches:
            rows = []
            for lo, _, data, offsets in tk.chunks(batch.column(1)):
                for t, words, at, _, segments, starts, ends in _scan(model, data, offsets):
                    for a, b, s in segments:
                        if (p := model.chance(s, words)) < SIGNIFICANT:
                            rows.append((batch.column(0)[lo + t].as_py(), int(starts[at[a]] - offsets[t]), int(ends[at[b]] - offsets[t]), s, p))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def clean_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` whose score is below the threshold, rows as they were."""

    def run(batches):
        for batch in batches:
            bad = []
            for _, _, data, offsets in tk.chunks(batch.column("text")):
                bad += [model.probability(min(evidence(model, words, segments), MOST_EVIDENCE)) >= THRESHOLD for _, words, _, _, segments, _, _ in _scan(model, data, offsets)]
            yield batch.filter(pa.array([not b for b in bad], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
