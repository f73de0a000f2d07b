"""Quality rules with adaptive thresholds (operator 8).

Each document gets integer metrics in one vectorised pass.  For every
(language, source) and metric a fixed-resolution histogram is kept: a quantile
sketch that merges by adding counts, is the same for every partitioning, and
has at most ``LEVELS`` buckets.  A group too small to speak for itself uses the
merged sketch of its language, and failing that the merged sketch of all.  The
limit is ``q75 + max(margin, spread * (q75 - q25))`` in the sketch's own units,
so a clean group never loses a fixed share of its rows, and a group of noisy
but usual style is judged against itself.  Where more than a quarter of a group
is junk, its q75 is the junk's own level; so if the group's median lies within
the limit of the merged sketch of all, ``CAP`` times that limit bounds its own (this holds while less than a quarter
of all rows is junk).
Documents join their limits and the filter follows.

Defined results: a null or empty text has no words and fails the base rule.
Null language or source is a group of its own.  Repeated rows are judged alike.
Only ``doc_id``, ``text``, ``lang`` and ``source`` are read, whatever else the
table holds; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .store import save

LEVELS = 1001
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: metric: (margin, spread); per-mille of characters, words or lines
RULES = {"symbols": (40, 6), "capitals": (150, 6), "shouts": (150, 6), "dup_lines": (400, 6), "repeats": (200, 6)}
MIN_GROUP = 50
CAP = 2

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_SHOUT = np.zeros(256, dtype=bool)
_SHOUT[[ord(c) for c in "!?"]] = True

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts"]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text of one chunk."""
    n = len(offsets) - 1
    starts, ends, bounds = tk.word_spans(data, offsets)
    hasher = tk.Hasher(data)
    inside = ~tk.WHITE[data]
    out = {
        "n_words": np.diff(bounds),
        "word_chars": _per_text(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_capitals": _per_text(_CAPITAL[data], offsets),
        "n_shouts": _per_text(_SHOUT[data], offsets),
    }
    # lines: split at \n and at the texts' bounds; those with a word count
    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    line_end = np.concatenate([breaks, offsets[1:]])
    line_start.sort(kind="stable")
    line_end.sort(kind="stable")
    text = np.searchsorted(offsets, line_start, side="right") - 1
    # a break that is the last byte of a text opens an empty line there, which holds no word
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, text = line_start[worded], line_end[worded], text[worded]
    key = hasher.spans(line_start, line_end)
    order = np.lexsort((line_start, key, text))
    again = np.zeros(len(key), dtype=bool)
    again[1:] = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    out["n_lines"] = np.bincount(text, minlength=n)
    out["n_dup_lines"] = np.bincount(text[order][again], minlength=n)
    # five-word windows found twice or more in the same text
    word, owner, first = tk.windows(hasher.spans(starts, ends), bounds, 5)
    order = np.lexsort((word, owner))
    same = (word[order][1:] == word[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    many = np.zeros(len(word), dtype=bool)
    many[:-1] |= same
    many[1:] |= same
    cover = np.zeros(len(starts) + 6, dtype=np.int64)
    at = first[order][many]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    covered = np.cumsum(cover)[: len(starts)] > 0
    out["n_repeat_words"] = _per_text(covered, bounds)
    return out


def metrics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the integer counts of every document."""

    def run(batches):
        for batch in batches:
            parts = [measure(data, offsets) for _, _, data, offsets in tk.chunks(batch.column(1))]
            columns = [np.concatenate([p[c] for p in parts]) if parts else np.empty(0, np.int64) for c in _COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "lang", "source", *_COUNTS])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def _share(top: str, bottom: str) -> Column:
    """Per-mille as a sketch bucket."""
    return F.least(F.lit(LEVELS - 1), F.expr(f"(1000 * {top}) div greatest({bottom}, 1)")).cast("int")


#: metric: (numerator, denominator)
LEVEL = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "shouts": ("n_shouts", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


def sketches(measured: DataFrame) -> DataFrame:
    """Histogram sketch: lang, source, metric, level, n.  Adding ``n`` merges sketches."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _share(*LEVEL[m]).alias("level")) for m in RULES]))
    return measured.select("lang", "source", pairs.alias("x")).groupBy("lang", "source", "x.metric", "x.level").agg(F.count(F.lit(1)).alias("n"))


def quantile_limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Size, median and limit per group and metric; at most LEVELS rows meet in a group."""
    w = Window.partitionBy(*keys, "metric")
    merged = sketch.groupBy(*keys, "metric", "level").agg(F.sum("n").alias("n"))
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("level"))).withColumn("size", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("size") * q, F.col("level")))
    margin, spread = (F.create_map(*[F.lit(x) for m, r in RULES.items() for x in (m, r[i])]) for i in (0, 1))
    q = run.groupBy(*keys, "metric").agg(at(25).alias("q25"), at(50).alias("q50"), at(75).alias("q75"), F.max("size").alias("size"))
    limit = F.col("q75") + F.greatest(margin[F.col("metric")], spread[F.col("metric")] * (F.col("q75") - F.col("q25")))
    return q.select(*keys, "metric", "size", "q50", limit.alias("limit"))


def group_limits(measured: DataFrame) -> DataFrame:
    """One row per (lang, source) with a limit for each metric."""
    sketch = save(sketches(measured), "sketch")
    own = quantile_limits(sketch, ["lang", "source"])
    lang = quantile_limits(sketch, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), F.col("size").alias("l_size"), F.col("limit").alias("l_limit"))
    everything = quantile_limits(sketch.withColumn("all", F.lit(0)), ["all"]).select(F.col("metric").alias("a_metric"), F.col("limit").alias("a_limit"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")), "left").join(everything, F.col("metric") == F.col("a_metric"), "left")
    limit = F.when(F.col("size") >= MIN_GROUP, F.col("limit")).when(F.col("l_size") >= MIN_GROUP, F.col("l_limit")).otherwise(F.col("a_limit"))
    limit = F.when(F.col("q50") > F.col("a_limit"), limit).otherwise(F.least(limit, CAP * F.col("a_limit")))
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, limit)).alias(f"max_{m}") for m in RULES])


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept."""
    measured = save(metrics(documents), "metrics")
    limits = group_limits(measured).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[f"max_{m}" for m in RULES])
    within = F.lit(True)
    for m in RULES:
        within = within & (_share(*LEVEL[m]) <= F.col(f"max_{m}"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(True))).alias("kept"), "lang", "source"
    )


def oracle() -> str:
    """DuckDB SQL with the columns of :func:`judge`."""
    word = r"[^\x20\x09-\x0D]+"
    only = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
    levels = " UNION ALL ".join(f"SELECT doc_row, lang, source, '{m}' AS metric, least({LEVELS - 1}, (1000 * {a}) // greatest({b}, 1)) AS level FROM counts" for m, (a, b) in LEVEL.items())
    margins = ", ".join(f"('{m}', {margin}, {spread})" for m, (margin, spread) in RULES.items())

    def limits(name: str, keys: str) -> str:
        by = f"{keys}, metric" if keys else "metric"
        return f"""{name}_h AS (SELECT {by}, level, count(*) AS n FROM levels GROUP BY ALL),
        {name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY level) AS upto, sum(n) OVER (PARTITION BY {by}) AS size FROM {name}_h),
        {name} AS (SELECT {by}, max(size) AS size, min(level) FILTER (upto * 100 >= size * 75) AS q75, min(level) FILTER (upto * 100 >= size * 50) AS q50, min(level) FILTER (upto * 100 >= size * 25) AS q25 FROM {name}_c GROUP BY {by})"""

    bound = lambda t: f"{t}.q75 + greatest(r.margin, r.spread * ({t}.q75 - {t}.q25))"
    return rf"""
    WITH rules(metric, margin, spread) AS (VALUES {margins}),
    texts AS (SELECT row_number() OVER () AS doc_row, CAST(doc_id AS BIGINT) AS doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    split_up AS (SELECT *, regexp_extract_all(t, '{word}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM texts),
    grams AS (SELECT doc_row, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_row, ws, unnest(range(1, len(ws) - 3)) AS i FROM split_up WHERE len(ws) >= 5)),
    many AS (SELECT doc_row, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_row, g) AS n FROM grams) WHERE n > 1),
    repeats AS (SELECT doc_row, count(DISTINCT i + j) AS n FROM many, range(5) r(j) GROUP BY doc_row),
    counts AS (SELECT s.doc_row, doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
      {only('#*$%&|<>')} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines, {only('A-Z')} AS n_capitals, {only('!?')} AS n_shouts
      FROM split_up s LEFT JOIN repeats r ON s.doc_row = r.doc_row),
    levels AS ({levels}), {limits('own', 'lang, source')}, {limits('tongue', 'lang')}, {limits('every', '')},
    bounds AS (SELECT o.lang, o.source, o.metric, CASE WHEN o.size >= {MIN_GROUP} THEN {bound('o')} WHEN t.size >= {MIN_GROUP} THEN {bound('t')} ELSE {bound('e')} END AS near, {bound('e')} AS far, o.q50
      FROM own o JOIN tongue t ON o.lang IS NOT DISTINCT FROM t.lang AND o.metric = t.metric JOIN every e ON o.metric = e.metric JOIN rules r ON o.metric = r.metric),
    within AS (SELECT l.doc_row, bool_and(level <= CASE WHEN q50 > far THEN near ELSE least(near, {CAP} * far) END) AS ok FROM levels l JOIN bounds b ON l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source AND l.metric = b.metric GROUP BY l.doc_row),
    failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept, lang, source FROM failed JOIN within USING (doc_row)"""
