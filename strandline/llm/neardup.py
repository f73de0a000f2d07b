"""Near-duplicate documents by bottom-k sketches (operator 6).

One hash function orders all five-word shingles; a document's sketch is its
``SKETCH`` smallest hashes.  Documents with equal shingle sets are one class
from the start, so exact copies are never paired.

* *Overlaps from inverted lists.*  The ``KEYS`` smallest values of every class
  form inverted lists.  For Jaccard 0.85 the chance that none of the first
  ``KEYS`` values of the union is shared is 0.15**KEYS (2e-13).
* *Short lists* (at most ``SHORT`` classes) give all their pairs.
* *Long lists* come from passages that many documents share and from large
  groups of near copies.  Their classes are listed again under all values of
  the sketch that few of them share; a class with a share of rare values of
  0.45 or more cannot have a link without one of these.  The others, made
  mostly of common shingles, are taken exactly: the shingles of their whole
  sets are ordered from rare to common, and a set is listed under its first
  ``n - ceil(0.85 n) + 1`` only, one of which any link must share.  Copies with
  many edits are thereby listed under their own edits, not under the common
  text.
* *Hubs.*  Lists that stay long hold near copies with few edits.  Each round,
  the class with the fewest rare shingles of every list is compared with the
  whole list, and classes it links are decided.  Undecided rests are paired in
  full after ``ROUNDS``.  Of two linked classes that different groups decided,
  each has a Jaccard of at least ``BETWEEN`` with the hub of the other (Jaccard
  distances add up), so hubs are compared with the other groups' classes in
  their lists once more, by bounds for ``BETWEEN``, and classes that reach it
  with their lists, so no link between groups is lost.
* *Union-sketch estimation* drops pairs that cannot reach the threshold (a
  shared part of the union's smallest values below ``ESTIMATE``; for Jaccard
  0.85 the chance of that is 8e-9, and for ``BETWEEN`` 1e-9 that it falls below
  ``EVIDENCE``).
* *Exact Jaccard* on whole sets of 64-bit shingle hashes decides.

Links become groups by :mod:`components`.  Defined results: null or empty
texts, and texts without words, have no shingles and no links; repeated rows
are one class; a null ``doc_id`` never names a component.  Extra columns are
not read by :func:`report` and are passed on by :func:`distinct_documents`; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .store import save

WIDTH = 5
SKETCH = 64
KEYS = 16
SHORT = 24
ESTIMATE = 0.55
BETWEEN = 0.70
EVIDENCE = 0.34
CROWDED = 0.60
ROUNDS = 3
PIVOTS = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, ascending, and the texts' bounds in them."""
    data = tk.LOWER[data]
    starts, ends, bounds = tk.word_spans(data, offsets)
    words = tk.Hasher(data).spans(starts, ends)
    value, text, _ = tk.windows(words, bounds, WIDTH)
    few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < WIDTH))
    if len(few):
        whole = np.zeros(len(few), dtype=np.uint64)
        for j in range(WIDTH - 1):
            has = bounds[few] + j < bounds[few + 1]
            whole[has] = tk.mix(whole[has] + words[bounds[few][has] + j] + np.uint64(j + 1))
        value, text = np.concatenate([value, whole]), np.concatenate([text, few])
    value = tk.signed(value)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[first], text[first]
    return value, np.searchsorted(text, np.arange(len(offsets)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sketches(documents: DataFrame) -> DataFrame:
    """rid, doc_id, th (text hash), n, s1, s2 (identity of the set), sketch."""

    def run(batches):
        base, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column(2)):
                value, bounds = shingle_sets(data, offsets)
                n = np.diff(bounds)
                u = value.view(np.uint64)
                take = np.minimum(n, SKETCH)
                ends = np.concatenate([[0], np.cumsum(take)])
                index = np.repeat(bounds[:-1] - ends[:-1], take) + np.arange(ends[-1])
                sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value[index]))
                rid = base + row + np.arange(hi - lo)
                row += hi - lo
                s1, s2 = _sums(tk.mix(u), bounds), _sums(tk.mix(u ^ np.uint64(0x5851F42D4C957F2D)), bounds)
                yield pa.RecordBatch.from_arrays([pa.array(rid), batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(n, pa.int64()), pa.array(tk.signed(s1)), pa.array(tk.signed(s2)), sketch], ["rid", "doc_id", "th", "n", "s1", "s2", "sketch"])

    texts = documents.select(F.col("doc_id").cast("long"), text_hash().alias("th"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "rid long, doc_id long, th long, n long, s1 long, s2 long, sketch array<long>")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _close(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * F.least(n, m) >= 85 * F.greatest(n, m)


def _list_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of each list (v, c, n); lists are short."""
    grouped = lists.groupBy("v").agg(F.sort_array(F.collect_set(F.struct("c", "n"))).alias("m"))
    left = grouped.select("m", F.posexplode("m").alias("i", "x"))
    later = left.select("x", F.explode(F.expr("filter(slice(m, i + 2, size(m)), y -> 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n))")).alias("y"))
    return later.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with the largest value."""
    values, offsets = np.asarray(column.flatten()), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    out = np.full((len(column), width), np.iinfo(np.int64).max)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(offsets[:-1], size)] = values
    return out


def shared_part(a: np.ndarray, b: np.ndarray, width: int = SKETCH) -> np.ndarray:
    """Part of the ``width`` smallest values of the union that both sketches hold."""
    merged = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = merged != np.iinfo(np.int64).max
    again = np.zeros(merged.shape, dtype=bool)
    again[:, 1:] = (merged[:, 1:] == merged[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)
    within = real & (rank <= width)
    return (again & within).sum(axis=1) / np.maximum((within & ~again).sum(axis=1), 1)


def _likely(pairs: DataFrame, reps: DataFrame, least: float = ESTIMATE) -> DataFrame:
    """Pairs that the union sketch doesn't rule out."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                part = shared_part(_matrix(batch.column(2), SKETCH), _matrix(batch.column(3), SKETCH))
                keep = pa.array(part >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    both = pairs.join(reps.select(F.col("c").alias("a"), F.col("sketch").alias("sa")), "a").join(reps.select(F.col("c").alias("b"), F.col("sketch").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, items): whole shingle sets of the classes in ``wanted`` (c, th)."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column(1)):
                value, bounds = shingle_sets(data, offsets)
                store = value.tobytes()
                blobs = [store[8 * s : 8 * e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(blobs, pa.binary())], ["c", "items"])

    texts = documents.select(text_hash().alias("th"), F.col("text").cast("string").alias("text"))
    keys = wanted.groupBy("th").agg(F.min("c").alias("c"))
    found = texts.join(keys.select("th").hint("shuffle_hash"), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    return found.join(keys, "th").select("c", "text").mapInArrow(run, "c long, items binary")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, linked, between: exact Jaccard at least 0.85, or at least BETWEEN."""

    def run(batches):
        for batch in batches:
            linked, between = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.int64), np.frombuffer(y.as_buffer(), dtype=np.int64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum()) if len(q) else 0
                union = len(p) + len(q) - both
                linked.append(100 * both >= 85 * union)
                between.append(100 * both >= round(100 * BETWEEN) * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(between, pa.bool_())], ["a", "b", "linked", "between"])

    joined = pairs.join(sets.select(F.col("c").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("c").alias("b"), F.col("items").alias("ib")), "b")
    return joined.select("a", "b", "ia", "ib").mapInArrow(run, "a long, b long, linked boolean, between boolean")


def _star(members: DataFrame, pivots: DataFrame, where: Column | None = None) -> DataFrame:
    """Pairs of every pivot (v, p, pn, ppos) with all of its list that can still reach the threshold.

    If v is the first shingle that two ordered sets share, their overlap is at
    most what follows it in either.
    """
    enough = 185 * F.least(F.col("n") - F.col("pos"), F.col("pn") - F.col("ppos")) >= 85 * (F.col("n") + F.col("pn"))
    met = members.join(pivots, "v").where((F.col("c") != F.col("p") if where is None else where) & _close(F.col("n"), F.col("pn")) & enough)
    return met.select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct()


def _long_lists(members: DataFrame, reps: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Measured pairs of the long lists (v, c, n, rare, pos), by rounds of central classes."""
    found: list[DataFrame] = []
    undone = members.select("v", "c", "n", "rare", "pos")
    hubs: list[DataFrame] = []
    turn = 0
    while not undone.isEmpty():
        if turn >= ROUNDS:
            pivots = undone.select("v", F.col("c").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("ppos"))
        elif turn == 0:
            pivots = undone.groupBy("v").agg(F.min_by(F.struct("c", "n", "pos"), F.struct("rare", "c")).alias("x")).select("v", F.col("x.c").alias("p"), F.col("x.n").alias("pn"), F.col("x.pos").alias("ppos"))
        else:
            size = undone.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("least"))
            chosen = F.expr(f"c = least or pmod(xxhash64(c, {turn}), greatest(1, size div {PIVOTS})) = 0")
            pivots = undone.join(size, "v").where(chosen).select("v", F.col("c").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("ppos"))
        pivots = save(pivots, "pivots")
        measured = save(_measured(_likely(_star(members, pivots), reps), sets), "measured")
        found.append(measured)
        if turn >= ROUNDS:
            break
        hubs.append(pivots)
        linked = measured.where("linked").select("a", "b")
        ends = linked.select(F.col("a").alias("c"), F.col("b").alias("p")).union(linked.select(F.col("b").alias("c"), F.col("a").alias("p")))
        decided = pivots.select("v", F.col("p").alias("c")).union(pivots.select("v", "p").join(ends, "p").select("v", "c"))
        undone = save(undone.join(decided.distinct(), ["v", "c"], "left_anti"), "undone")
        turn += 1
    if turn == 0:
        return found
    return found + _between_groups(members, hubs, found, reps, sets)


def _between_groups(members: DataFrame, hubs: list[DataFrame], found: list[DataFrame], reps: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Measured pairs of classes that hubs (v, p, pn, ppos) of different groups decided.

    The position filter of :func:`_star` doesn't hold for a hub and a class of
    another group, as v needn't be the first shingle that these two share.
    """
    links, every = found[0].where("linked").select("a", "b"), hubs[0]
    for m in found[1:]:
        links = links.union(m.where("linked").select("a", "b"))
    for h in hubs[1:]:
        every = every.union(h)
    roots = components(links)
    grouped = save(members.join(roots.select(F.col("id").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c")), "grouped")
    # a hub without links decided no class
    led = every.join(roots.select(F.col("id").alias("p"), F.col("root").alias("proot")), "p")
    near = 100 * F.least("n", "pn") >= round(100 * BETWEEN) * F.greatest("n", "pn")
    met = grouped.join(led, "v").where((F.col("root") != F.col("proot")) & near)
    pairs = save(met.select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct(), "between")
    if pairs.isEmpty():
        return []
    between = save(_measured(_likely(pairs, reps, EVIDENCE), sets), "measured").where("between")
    ends = between.select(F.col("a").alias("c")).union(between.select(F.col("b").alias("c"))).distinct()
    pivots = grouped.join(ends, "c").select("v", F.col("c").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("ppos"), F.col("root").alias("proot"))
    return [save(_measured(_likely(_star(grouped, save(pivots, "pivots"), F.col("root") != F.col("proot")), reps), sets), "measured")]


def _crowd_pairs(reps: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Measured pairs of classes made mostly of common shingles, by their rarest shingles."""

    def run(batches):
        for batch in batches:
            blobs = batch.column(1)
            size = np.array([len(x.as_buffer()) // 8 for x in blobs], dtype=np.int64)
            items = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in blobs]) if len(size) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(items)], ["c", "v"])

    items = sets.select("c", "items").mapInArrow(run, "c long, v long")
    counted = items.groupBy("v").agg(F.count(F.lit(1)).alias("df"))
    order = items.join(counted, "v").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("o"))
    first = order.select("c", F.size("o").cast("long").alias("n"), F.size(F.filter("o", lambda x: x["df"] <= SHORT)).alias("rare"), F.expr("slice(o, 1, size(o) - cast(ceil(size(o) * 85 / 100) as int) + 1)").alias("o"))
    listed = first.select("c", "n", "rare", F.posexplode("o").alias("pos", "x")).where("x.df > 1").select(F.col("x.v").alias("v"), "c", "n", "rare", F.col("pos").cast("long").alias("pos"))
    listed = save(listed, "prefixes")
    lists = save(listed.join(listed.groupBy("v").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "v"), "prefixes")
    pairs = _list_pairs(lists.where(F.col("size") <= SHORT))
    found = [save(_measured(_likely(pairs, reps), sets), "measured")]
    return found + _long_lists(lists.where(F.col("size") > SHORT).drop("size"), reps, sets)


def groups(documents: DataFrame) -> DataFrame:
    """rid, doc_id, th, n and root (a name for the group) of every document."""
    rows = save(sketches(documents), "sketches")
    some = rows.where("n > 0")
    classes = some.groupBy("s1", "s2", "n").agg(F.min("rid").alias("c"))
    members = save(rows.select("rid", "doc_id", "th", "n", "s1", "s2").join(classes.withColumnRenamed("n", "_n"), ["s1", "s2"], "left").where("_n is null or _n = n").select("rid", "doc_id", "th", "n", F.coalesce("c", "rid").alias("c")), "members")
    first = members.where("rid = c and n > 0").select("c", "th")
    reps = save(some.select(F.col("rid").alias("c"), "n", "sketch").join(first, "c"), "reps")
    keys = reps.select("c", "n", F.explode(F.slice("sketch", 1, KEYS)).alias("v"))
    lists = save(keys.join(keys.groupBy("v").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "v"), "lists")
    pairs = _list_pairs(lists.where(F.col("size") <= SHORT))
    long = lists.where(F.col("size") > SHORT)
    busy = not long.isEmpty()
    if busy:
        met = long.select("c").distinct()
        every = save(reps.join(met, "c").select("c", "n", F.size("sketch").alias("held"), F.explode("sketch").alias("v")), "values")
        spread = save(every.join(every.groupBy("v").agg(F.count(F.lit(1)).alias("size")), "v"), "values")
        pairs = pairs.union(_list_pairs(spread.where(f"size between 2 and {SHORT}"))).distinct()
        rare = spread.groupBy("c", "held").agg(F.count_if(F.col("size") <= SHORT).alias("rare"))
        crowd = save(rare.where(F.col("rare") < CROWDED * F.col("held")).select("c"), "crowd")
    likely = save(_likely(pairs, reps), "likely")
    wanted = likely.select(F.col("a").alias("c")).union(likely.select(F.col("b").alias("c")))
    if busy:
        wanted = wanted.union(crowd)
    sets = save(_sets(documents, reps.select("c", "th").join(wanted.distinct(), "c", "left_semi")), "sets")
    found = [save(_measured(likely, sets), "measured")]
    if busy:
        found += _crowd_pairs(save(reps.select("c", "n", "sketch").join(crowd, "c"), "crowd"), save(sets.join(crowd, "c"), "crowd"))
    links = found[0].where("linked").select("a", "b")
    for m in found[1:]:
        links = links.union(m.where("linked").select("a", "b"))
    roots = components(links)
    return members.join(roots.select(F.col("id").alias("c"), "root"), "c", "left").select("rid", "doc_id", "th", "n", F.coalesce("root", "c").alias("root"))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    grouped = save(groups(documents), "groups")
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group: the least doc_id's, and of repeated rows one."""
    grouped = save(groups(documents), "groups")
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "th")).alias("x")).select(F.col("x.doc_id").alias("_sl_doc"), F.col("x.th").alias("_sl_th"))
    keep = best.distinct()
    kept = documents.join(keep, documents["doc_id"].cast("long").eqNullSafe(F.col("_sl_doc")) & (text_hash() == F.col("_sl_th")), "left_semi")
    repeated = grouped.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("_sl_doc"), F.col("th").alias("_sl_th"))
    if repeated.isEmpty():
        return kept
    match = documents["doc_id"].cast("long").eqNullSafe(F.col("_sl_doc")) & (text_hash() == F.col("_sl_th"))
    once = kept.join(repeated, match, "left_anti")
    extra = kept.join(repeated, match, "left_semi").withColumn("_sl_key", text_hash()).dropDuplicates(["doc_id", "_sl_key"]).drop("_sl_key")
    return once.unionByName(extra)


def oracle() -> str:
    """DuckDB SQL with the columns of :func:`report`, for tables whose doc_ids are distinct."""
    return r"""
    WITH RECURSIVE texts AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    shingles AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
      SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM texts WHERE len(ws) >= 5)
      UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM texts WHERE len(ws) BETWEEN 1 AND 4)),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
    ties AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(a, b) AS (SELECT a, b FROM ties UNION SELECT reach.a, ties.b FROM reach JOIN ties ON reach.b = ties.a)
    SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, least(t.doc_id, coalesce(r.least_id, t.doc_id)) AS component_id, t.doc_id <= coalesce(r.least_id, t.doc_id) AS kept
    FROM texts t LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) r USING (doc_id)"""
