"""Audit of how the sources of a language differ in their terms (operator 12).

Terms are runs of letters A-Z (lower-cased) and characters beyond ASCII.  A
language keeps the terms that stand in at least ``min_docs`` of its documents.
Every (lang, source) group and every language as a whole gives each kept term
``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))``, and two groups differ in a
term by ``f = floor((p - q)**2 / (p + q))``, all in exact integers.

Counts are made per Arrow batch and combined before the shuffle, so a common
term is a few rows.  A language's kept terms are dealt by hash to blocks of about
``TILE`` cells (groups x terms), so that a block stays small however many terms
there are.  Each block is a dense int64 tile, group by term; broadcasting its rows
against each other gives the block's partial matrix of all pairs, some rows at a
time, which Spark sums over the blocks.  A heap for each group has a block's best
terms; Spark merges the heaps.

Numbers stay exact up to 9 * 10**15 term occurrences in a language.

Defined results: null text, lang and source are ''.  Repeated rows are documents
of their own.  Groups without terms take part with counts of zero; in a language
without kept terms every pair has value 0.  A language with one source has no
pairs.  Texts of any length count whole.  Extra columns are left out.  An empty
table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import save
from .textkit import LOWER, chunks

MIN_DOCS = 10
TOP = 10
TILE = 1 << 18
PAIR_CELLS = 1 << 20
LISTED_LANGS = 100_000
SCALE = 1_000_000_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True

COUNTS = "lang string, source string, term string, n long, docs long"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms of a chunk of texts, in order, and the text of each."""
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    letters = LOWER[data[inside]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())])
    return found, np.searchsorted(offsets, starts, side="right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a batch; a row with a null term names each group."""
    names = [c.split()[0] for c in COUNTS.split(", ")]
    for batch in batches:
        groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        kind = {g: i for i, g in enumerate(dict.fromkeys((x["lang"], x["source"]) for x in groups.to_pylist()))}
        of = np.array([kind[x["lang"], x["source"]] for x in groups.to_pylist()], dtype=np.int64)
        langs, sources = pa.array([g[0] for g in kind], pa.string()), pa.array([g[1] for g in kind], pa.string())
        nothing = pa.array([0] * len(kind), pa.int64())
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(kind), pa.string()), nothing, nothing], names)
        for lo, hi, data, offsets in chunks(batch.column(2), 1 << 22):
            found, text = terms(data, offsets)
            if not len(found):
                continue
            coded = found.dictionary_encode()
            word = np.asarray(coded.indices).astype(np.int64)
            width = len(coded.dictionary)
            code, first = np.unique(np.unique(text * width + word) % width + of[lo:hi][np.unique(text * width + word) // width] * width, return_counts=True)
            total = np.bincount(np.searchsorted(code, of[lo:hi][text] * width + word), minlength=len(code))
            group, term = pa.array(code // width), pa.array(code % width)
            yield pa.RecordBatch.from_arrays(
                [langs.take(group), sources.take(group), coded.dictionary.take(term).cast(pa.large_string()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(first, pa.int64())], names
            )


def count_terms(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of ``documents`` (lang, source, text); each group also has a row with a null term."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    return rows.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: np.ndarray, total: np.ndarray, width: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (total + 2 * width)), in three exact steps of a thousand."""
    under = total + 2 * width
    whole, rest = np.divmod(n + 2, under)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, under)
        whole = whole * 1000 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tile(counts: pd.DataFrame, totals: pd.DataFrame, top: int = TOP) -> Iterator[tuple]:
    """(source, item, value) of a block's pairs and (source, term, value) of its groups' best terms, with the part's name.

    ``counts`` has the (source, term, n) of one block of a language, ``totals`` the
    (source, total, width) of all its groups.
    """
    sources = totals["source"].to_numpy()
    width = int(totals["width"].iloc[0])
    place = {s: i for i, s in enumerate(sources)}
    term, words = pd.factorize(counts["term"])
    dense = np.zeros((len(sources), len(words)), dtype=np.int64)
    dense[counts["source"].map(place).to_numpy(dtype=np.int64), term] = counts["n"].to_numpy(dtype=np.int64)
    total = totals["total"].to_numpy(dtype=np.int64)
    p = probability(dense, total[:, None], width)
    step = max(1, PAIR_CELLS // p.size)
    for lo in range(0, len(p), step):
        sums = divergence(p[lo : lo + step, None, :], p[None, :, :]).sum(axis=2)
        for i, row in enumerate(sums.tolist()):
            yield from (("pair", sources[lo + i], other, v) for j, (other, v) in enumerate(zip(sources, row, strict=True)) if j != lo + i)
    q = probability(dense.sum(axis=0), total.sum(), width)
    for i, source in enumerate(sources):
        ahead = np.flatnonzero((dense[i] > 0) & (p[i] > q))
        values = divergence(p[i, ahead], q[ahead])
        best = heapq.nsmallest(top, zip((-values).tolist(), (words[j].encode() for j in ahead), strict=True))
        yield from (("term", source, word.decode(), -v) for v, word in best)


def _tiles(counts: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
    rows = list(tile(counts, totals)) if len(counts) else []
    lang = totals["lang"].iloc[0] if len(totals) else ""
    return pd.DataFrame([(lang, s, part, item, v) for part, s, item, v in rows], columns=["lang", "source", "part", "item", "value"])


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of all pairs of sources of each language, and of each group's leading terms."""
    counted = save(count_terms(documents), "terms")
    kept = counted.where("term is not null").withColumn("all", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("all") >= min_docs)
    kept = save(kept.select("lang", "source", "term", "n"), "kept")
    width = kept.groupBy("lang").agg(F.countDistinct("term").alias("width"))
    totals = counted.where("term is null").select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    sizes = totals.groupBy("lang").agg(F.count("*").alias("groups")).join(width, "lang", "left")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("width") * F.col("groups") / TILE)).cast("int")
    sizes = sizes.select("lang", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce(blocks, F.lit(1)).alias("blocks"))
    sizes = save(sizes, "sizes")
    if sizes.count() <= LISTED_LANGS:  # so that a language of very many rows stays where it is
        sizes = F.broadcast(sizes)
    totals = save(totals.join(sizes, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "width", "blocks"), "totals")
    dealt = kept.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n")
    spread = totals.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "width")
    tiles = dealt.groupBy("lang", "block").cogroup(spread.groupBy("lang", "block"))
    parts = save(tiles.applyInPandas(_tiles, "lang string, source string, part string, item string, value long"), "parts")
    own = totals.select("lang", "source")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    without = totals.where("width = 0").select("lang", "source")
    none = without.join(own.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(none).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    best = parts.where("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(columns).unionByName(best.select(columns))


def oracle(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    return rf"""
    WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    lists AS (SELECT d, lang, source, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS list FROM docs),
    words AS (SELECT d, lang, source, unnest(list) AS term FROM lists),
    kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {min_docs}),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
    width AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
    dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n,
                     1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * w.v)::HUGEINT AS p
              FROM groups g JOIN kept k USING (lang) JOIN width w USING (lang)
              LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
              LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
    whole AS (SELECT c.lang, c.term, 1 + ({SCALE}::HUGEINT * (sum(c.n)::HUGEINT + 2)) // (any_value(t.total)::HUGEINT + 2 * any_value(w.v)) AS q
              FROM counts c JOIN width w USING (lang) JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) t USING (lang) GROUP BY c.lang, c.term),
    others AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
             FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT o.lang, o.source, 'pair' AS part, o.item, coalesce(s.value, 0)::BIGINT AS value FROM others o LEFT JOIN sums s USING (lang, source, item)),
    ahead AS (SELECT d.lang, d.source, 'term' AS part, d.term AS item, (((d.p - q.q) * (d.p - q.q)) // (d.p + q.q))::BIGINT AS value
             FROM dense d JOIN whole q USING (lang, term) WHERE d.n > 0 AND d.p > q.q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM ahead))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}
    """
