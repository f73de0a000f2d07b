"""PageRank with dangling mass spread over all vertices, as a product of blocks.

Vertices are dealt to blocks by a hash and numbered there.  The edges between two
blocks are a tile: the sources' numbers, ordered by target.  In a superstep every
block sums what it was sent, and sends each block one message: the sums over their
tile, where they belong (a bitmap, or numbers if few), and its own dangling mass.
Messages go to all blocks, so each knows the whole dangling mass, and a superstep
is one shuffle of about eight bytes for each (block, target) that meet.

``BLOCK`` supersteps are one job, fewer where the changes so far let the end be
expected sooner.  Tiles are stored in buckets of the block of their sources, of
which each holds one block of about ``EDGES`` edges; ranks are stored between
jobs, and those of the job before are removed.  A task holds the tiles of one
block: memory grows with the out-degree of a hub, four to twelve bytes an edge.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StrandlineError
from ..shared import Tables

DAMPING = 0.85
MIN_CHANGE = 0.001
BLOCK = 12  # supersteps of a job, at most
EDGES = 8_000_000  # of a block, and a quarter as many vertices
LEAST = 20_000  # edges that a block of their own is worth

TILE = "k long, kd long, sources binary, starts binary, places binary"
MAIL = pa.schema([("k", pa.int64()), ("src", pa.int64()), ("places", pa.binary()), ("sums", pa.binary()), ("lost", pa.float64()), ("changes", pa.list_(pa.float64()))])
MAIL_DDL = "k long, src long, places binary, sums binary, lost double, changes array<double>"


def _settings(damping: float, min_change: float) -> tuple[float, float]:
    if not 0 <= damping <= 1:
        raise StrandlineError("damping must lie in [0, 1]")
    if not 0 <= min_change < 1:
        raise StrandlineError("min_change must lie in [0, 1)")
    return damping or DAMPING, min_change or MIN_CHANGE


def usable_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between different, known vertices; parallel edges stay."""
    ids = vertices.select("id").distinct()
    plain = edges.where("src <> dst").select("src", "dst")
    return plain.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


def _keys(tables: Tables) -> list[int]:
    """A key for each bucket, which lies in that bucket."""
    size = 16 * tables.buckets
    while True:
        dealt = tables.spark.range(size).groupBy(F.pmod(F.hash("id"), F.lit(tables.buckets)).alias("b")).agg(F.min("id").alias("k"))
        keys = {r.b: r.k for r in dealt.collect()}  # one row for each bucket
        if len(keys) == tables.buckets:
            return [keys[b] for b in range(tables.buckets)]
        size *= 4


def _ints(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), dtype=np.int32)


def _doubles(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), dtype=np.float64)


def _places(numbers: np.ndarray, size: int) -> bytes:
    """Ascending numbers below ``size``: a bitmap after a 1, or the numbers after a 0, whichever is shorter."""
    if 32 * len(numbers) < size:
        return b"\0" + numbers.astype(np.int32).tobytes()
    has = np.zeros(size, dtype=bool)
    has[numbers] = True
    return b"\1" + np.packbits(has).tobytes()


def _placed(x: pa.Scalar) -> np.ndarray:
    stored = np.frombuffer(x.as_buffer(), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(stored[1:])) if stored[0] else stored[1:].copy().view(np.int32)


def _tiles(sizes: dict[int, int]) -> Callable:
    """The tiles of a block's edges (k, ps, kd, pd), and a row without ``kd`` that has its vertices' out-degrees."""

    def run(key, vertices: pa.Table, edges: pa.Table) -> pa.Table:
        k = key[0].as_py()
        ps, kd, pd = (edges.column(c).to_numpy() for c in ("ps", "kd", "pd"))
        rows = [(k, None, np.bincount(ps, minlength=sizes[k]).astype(np.int32).tobytes(), None, None)]
        order = np.lexsort((pd, kd))
        ps, kd, pd = ps[order].astype(np.int32), kd[order], pd[order]
        cuts = np.flatnonzero(np.diff(kd)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(kd)], strict=True):
            if lo < hi:
                starts = np.concatenate([[0], np.flatnonzero(np.diff(pd[lo:hi])) + 1]).astype(np.int32)
                to = int(kd[lo])
                rows.append((k, to, ps[lo:hi].tobytes(), starts.tobytes(), _places(pd[lo:hi][starts], sizes[to])))
        schema = pa.schema([("k", pa.int64()), ("kd", pa.int64()), ("sources", pa.binary()), ("starts", pa.binary()), ("places", pa.binary())])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _received(mail: pa.Table, base: float, damping: float, n: int) -> tuple[np.ndarray, list[float]]:
    """A block's ranks and its changes so far; what was stored is mail as well, alone."""
    ranks, changes, sent = None, [], []
    for src, places, sums, lost, change in zip(*(mail.column(c) for c in ("src", "places", "sums", "lost", "changes")), strict=True):
        if places.is_valid:
            sent.append((src.as_py(), places, sums, lost.as_py()))
        else:
            ranks, changes = _doubles(sums), change.as_py()
    if not sent:
        return ranks, changes
    given, lost = np.zeros(len(ranks)), 0.0
    for _, places, sums, mass in sorted(sent, key=lambda m: m[0]):
        given[_placed(places)] += _doubles(sums)
        lost += mass
    new = base + damping * (given + lost / n)
    return new, [*changes, float(np.abs(new - ranks).sum())]


def _own(k: int, ranks: np.ndarray, changes: list[float]) -> tuple:
    return k, k, None, ranks.tobytes(), 0.0, changes


def _mail(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MAIL, strict=True)], schema=MAIL)


def _sent(keys: list[int], base: float, damping: float, n: int) -> Callable:
    """A superstep of one block: from its mail, along its tiles, to the mail of all blocks."""

    def run(key, mail: pa.Table, tiles: pa.Table) -> pa.Table:
        k = key[0].as_py()
        ranks, changes = _received(mail, base, damping, n)
        parts = list(zip(*(tiles.column(c) for c in ("kd", "sources", "starts", "places")), strict=True))
        degree = next(_ints(sources) for kd, sources, _, _ in parts if not kd.is_valid)
        lost = float(ranks[degree == 0].sum())
        share = ranks / np.maximum(degree, 1)
        rows = [_own(k, ranks, changes)]
        met = set()
        for kd, sources, starts, places in parts:
            if kd.is_valid:
                met.add(kd.as_py())
                rows.append((kd.as_py(), k, places.as_py(), np.add.reduceat(share[_ints(sources)], _ints(starts)).tobytes(), lost, None))
        rows += [(kd, k, b"\0", b"", lost, None) for kd in keys if kd not in met]
        return _mail(rows)

    return run


def _expected(changes: list[float], min_change: float) -> int:
    """Supersteps until the change is small enough, if it goes on falling as it did."""
    if len(changes) < 3 or not 0 < changes[-1] < changes[-2]:
        return BLOCK
    return max(1, math.ceil(math.log(min_change / changes[-1]) / math.log(changes[-1] / changes[-2])))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = DAMPING, min_change: float = MIN_CHANGE, max_steps: int | None = None, history: list | None = None) -> DataFrame:
    """(id, rank) after the first superstep whose summed change is below ``min_change``, or after ``max_steps``.

    Superstep 1 sets every rank to 1/N.  ``history`` gets (superstep, change).
    """
    damping, min_change = _settings(damping, min_change)
    given = Tables(vertices.sparkSession)
    ids = given.put(vertices.select("id").distinct(), "id", deal=False)
    n = ids.count()
    if n == 0:
        return ids.select("id", F.lit(0.0).alias("rank"))
    plain = given.put(edges.where("src <> dst").select("src", "dst"), "src")
    size = plain.count() + 4 * n
    # few blocks for few edges, or else one for each core at least
    tables = Tables(vertices.sparkSession, buckets=max(min(given.spark.sparkContext.defaultParallelism, size // LEAST + 1), size // EDGES + 1))
    keys = _keys(tables)
    # numbers of the vertices: their block's key, and their place in the block
    dealt = ids.withColumn("k", F.get(F.array(*[F.lit(k).cast("long") for k in keys]), F.pmod(F.xxhash64("id"), F.lit(len(keys))).cast("int")))
    names = tables.put(dealt.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1), "k", deal=False)
    given.drop(ids)
    sizes = dict.fromkeys(keys, 0) | {r.k: r.n for r in names.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each block
    known = plain.join(names.select(F.col("id").alias("src"), "k", F.col("pos").alias("ps")), "src")
    ends = known.join(names.select(F.col("id").alias("dst"), F.col("k").alias("kd"), F.col("pos").alias("pd")), "dst").select("k", "ps", "kd", "pd")
    blocks = tables.spark.createDataFrame([(k,) for k in keys], "k long")
    tiles = tables.put(blocks.groupBy("k").cogroup(ends.groupBy("k")).applyInArrow(_tiles(sizes), TILE), "k")
    given.drop(plain)

    def start(rows):
        for batch in rows:
            yield from _mail([_own(k, np.full(sizes[k], 1.0 / n), []) for k in batch.column(0).to_pylist()]).to_batches() if batch.num_rows else []

    base = (1.0 - damping) / n
    step = _sent(keys, base, damping, n)

    def after(stored: DataFrame, steps: int) -> DataFrame:
        """What is stored for each block so many supersteps later."""
        mail = stored
        for _ in range(steps):
            mail = mail.groupBy("k").cogroup(tiles.groupBy("k")).applyInArrow(step, MAIL_DDL)
        end = lambda key, group: _mail([_own(key[0].as_py(), *_received(group, base, damping, n))])
        return tables.put(mail.groupBy("k").applyInArrow(end, MAIL_DDL), "k")

    stored = tables.put(blocks.mapInArrow(start, MAIL_DDL), "k")
    changes = [1.0]
    while max_steps is None or len(changes) < max_steps:
        size = min(BLOCK, _expected(changes, min_change)) if max_steps is None else min(BLOCK, max_steps - len(changes))
        before, stored = stored, after(stored, size)
        per = stored.select("k", F.slice("changes", len(changes), size).alias("c")).orderBy("k").collect()  # one row for each block
        new = [math.fsum(c) for c in zip(*(r.c for r in per), strict=True)]
        done = next((j for j, c in enumerate(new, 1) if c < min_change), None) if max_steps is None else None
        changes += new[:done]
        if done and done < size:  # the end came sooner than expected
            tables.drop(stored)
            stored = after(before, done)
        tables.drop(before)
        if done:
            break
    if history is not None:
        history += enumerate(changes, 1)
    tables.drop(tiles)
    kind = names.schema["id"].dataType.simpleString()

    def named(key, own: pa.Table, end: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        ranks = pa.array(_doubles(end.column("sums")[0])) if end.num_rows else pa.array([], pa.float64())
        return pa.table({"id": own.column("id"), "rank": ranks})

    return names.groupBy("k").cogroup(stored.groupBy("k")).applyInArrow(named, f"id {kind}, rank double").where("id is not null or rank is not null")
