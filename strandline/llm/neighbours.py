"""Approximate nearest neighbours by a hierarchical k-means tree (operator 9).

A tree of k-means splits is grown on a bounded sample (``MAX_SAMPLE`` vectors,
by a hash of the id) until leaves hold about ``LEAF_ROWS`` of all rows; it has
at most ``MAX_LEAVES`` leaves, and the tree alone is sent to the workers.  Every
row is filed in the leaf that it reaches by the nearest centre at each level.

A query goes through the tree best bin first, as a priority queue of the branches
not taken would, ranked by the inner product with their centre (:meth:`Tree.ranks`
finds the turn of every leaf without the queue).  How many leaves are visited
is calibrated: for ``PROBES`` queries the true neighbours are found by comparing
with all rows, and the visits are doubled, then narrowed, until the mean recall
reaches ``RECALL``.

Neither rows nor queries are copied for a visit.  Each leaf is written to the
shared folder as raw arrays, in parts of about two usual leaves or of a
``MAX_LEAVES``-th of all rows, if that is more.  Queries are dealt by the leaf that
they fall in; a task holds ``QUERY_ROWS`` of them at a time, maps one part after
another and compares ``BLOCK_ROWS`` rows with ``QUERY_TILE`` queries by a matrix
product.  So a task's memory depends on these constants, the tree and the length
of a vector (that of a task that writes, on one part), and rows and results are
all that is shuffled.  Visits widen in
rounds, from ``FIRST`` leaves by a factor of ``WIDER``, so that most rows are
measured against a score that is near a query's k-th best already; a query that
has not found ``k`` rows by then goes on.  The final
scores are summed in a fixed order, so equal vectors tie exactly, and ties go to
the smaller id; of the equal vectors of a batch only those that can still be
among a query's ``k`` are written.

Defined results: vectors that are null, empty, zero, of another than the
commonest length, or with null or non-finite components take no part, as rows
without an id.  Rows that share a query's id are not its neighbours.  With at
most ``k`` candidates all are returned.  Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sharedfiles import mapped, put
from .store import fresh_path, remove, save, shuffle_partitions

K = 20
MAX_SAMPLE = 20_000
MAX_LEAVES = 4096
LEAF_ROWS = 256
BLOCK_ROWS = 2048
QUERY_ROWS = 2048
QUERY_TILE = 256
PENDING = 50_000
BRANCHES = 8
PROBES = 200
RECALL = 0.95
FIRST = 2
WIDER = 8


@dataclass
class Tree:
    """Inner nodes: centres of their children and the children's numbers (leaves as -1 - leaf)."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaves: int

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector."""
        out = np.zeros(len(vectors), dtype=np.int64)
        if not self.centres:
            return out
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            c = self.centres[node]
            near = np.argmin((c * c).sum(axis=1) - 2 * vectors[rows] @ c.T, axis=1)
            for j, child in enumerate(self.children[node]):
                mine = rows[near == j]
                if len(mine) == 0:
                    continue
                if child < 0:
                    out[mine] = -1 - child
                else:
                    stack.append((child, mine))
        return out

    @cached_property
    def _paths(self) -> tuple[np.ndarray, np.ndarray]:
        """The centres of all branches, and each leaf's branches from the root on; a number beyond the last where its path has ended."""
        first = np.cumsum([0, *map(len, self.children)])
        paths: list[list[int]] = [[] for _ in range(self.leaves)]
        stack: list[tuple[int, list[int]]] = [(0, [])]
        while stack:
            node, above = stack.pop()
            for j, child in enumerate(self.children[node]):
                path = [*above, int(first[node]) + j]
                if child < 0:
                    paths[-1 - child] = path
                else:
                    stack.append((child, path))
        depth = max(map(len, paths))
        return np.concatenate(self.centres), np.array([p + [int(first[-1])] * (depth - len(p)) for p in paths])

    def ranks(self, queries: np.ndarray) -> np.ndarray:
        """The turn of each leaf (column), best bin first, for every query (row).

        A queue of branches gives out a leaf after another one if, from where
        their paths part, the smallest gain on its path is smaller: the order
        of the smallest gains of the paths, of those from the next branch on, ...
        """
        turn = np.zeros((len(queries), self.leaves), dtype=np.int32)
        if not self.centres:
            return turn
        centres, paths = self._paths
        for lo in range(0, len(queries), QUERY_TILE):
            gains = queries[lo : lo + QUERY_TILE] @ centres.T
            for i, gain in enumerate(gains, lo):
                least = np.minimum.accumulate(np.append(gain, np.inf)[paths.T[::-1]], axis=0)
                turn[i, np.lexsort(-least)] = np.arange(self.leaves)
        return turn

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order, up to ``most``."""
        return np.argsort(self.ranks(query[None])[0])[:most].tolist()


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)
        kept = [x[near == j].mean(axis=0) for j in range(len(centres)) if (near == j).any()]
        new = np.stack(kept)
        if new.shape == centres.shape and np.allclose(new, centres):
            break
        centres = new
    return centres


def grow(sample: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 7) -> Tree:
    """Split the largest node until there are about ``leaves``."""
    rng = np.random.default_rng(seed)
    tree = Tree([], [], 1)
    if leaves < 2 or len(np.unique(sample, axis=0)) < 2:
        return tree
    # open leaves: (-size, turn, rows, parent, position)
    queue: list[tuple[int, int, np.ndarray, int, int]] = [(-len(sample), 0, np.arange(len(sample)), -1, 0)]
    closed: list[tuple[int, int]] = []
    turn = 0
    while queue and len(queue) + len(closed) < leaves:
        _, _, rows, parent, position = heapq.heappop(queue)
        part = sample[rows]
        different = np.unique(part, axis=0)
        if len(different) < 2:
            closed.append((parent, position))
            continue
        centres = _kmeans(different, min(branches, len(different)), rng)
        if len(centres) < 2:
            closed.append((parent, position))
            continue
        node = len(tree.centres)
        tree.centres.append(centres)
        tree.children.append([0] * len(centres))
        if parent >= 0:
            tree.children[parent][position] = node
        near = np.argmin((centres * centres).sum(axis=1) - 2 * part @ centres.T, axis=1)
        for j in range(len(centres)):
            turn += 1
            heapq.heappush(queue, (-int((near == j).sum()), turn, rows[near == j], node, j))
    ends = closed + [(p, j) for _, _, _, p, j in queue]
    for leaf, (parent, position) in enumerate(ends):
        if parent >= 0:
            tree.children[parent][position] = -1 - leaf
    tree.leaves = max(len(ends), 1)
    return tree


def _usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (of floats if it was, else of doubles) of the rows that take part."""
    kind = "array<float>" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"))
    good = F.col("vec_id").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.where(good)
    size = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.where(F.size("vector") == (size[0].size if size else 0))


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix, in the type they are kept in."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


class _Nearest:
    """The k nearest rows so far of some queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.least = np.full(len(ids), -np.inf)  # the k-th best score, once there are k
        self.pending: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0
        self.best: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def meet(self, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: np.ndarray | int) -> None:
        """Compare the queries numbered ``asked`` with rows of doubles."""
        for lo in range(0, len(asked), QUERY_TILE):
            self._tile(asked[lo : lo + QUERY_TILE], ids, vectors, leaf)

    def _tile(self, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: np.ndarray | int) -> None:
        queries = self.queries[asked]
        rough = queries @ vectors.T
        order = np.argsort(ids, kind="stable")
        lower, upper = (np.searchsorted(ids, self.ids[asked], side=s, sorter=order) for s in ("left", "right"))
        for i in np.flatnonzero(upper > lower).tolist():  # rows of a query's own id
            rough[i, order[lower[i] : upper[i]]] = -np.inf
        least = self.least[asked]
        met = rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None]
        if np.count_nonzero(met) > 2 * self.k * len(asked) and len(ids) > self.k:
            least = np.maximum(least, np.partition(rough, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            met = rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None]
        met &= rough > -np.inf
        q, r = np.nonzero(met)
        step = max(1, 1_000_000 // max(vectors.shape[1], 1))
        for lo in range(0, len(q), step):  # near-equal rough scores are summed anew in a fixed order
            i, j = q[lo : lo + step], r[lo : lo + step]
            score = (vectors[j] * queries[i]).sum(axis=1)
            self.pending.append((asked[i], ids[j], leaf[j] if isinstance(leaf, np.ndarray) else np.full(len(j), leaf), score))
            self.waiting += len(i)
            if self.waiting > PENDING:
                self.settle()

    def settle(self) -> None:
        """Merge what waits into the best."""
        q, ids, leaf, score = (np.concatenate(x) for x in zip(self.best, *self.pending, strict=True))
        order = np.lexsort((ids, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.best = (q[kept], ids[order][kept], leaf[order][kept], score[order][kept])
        last = place == self.k - 1
        self.least[q[last]] = score[order][last]
        self.pending, self.waiting = [], 0

    def batch(self) -> pa.RecordBatch:
        """query_id, vec_id, leaf, score."""
        self.settle()
        q, ids, leaf, score = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(ids), pa.array(leaf, pa.int64()), pa.array(score)], ["query_id", "vec_id", "leaf", "score"])


_FOUND = "query_id long, vec_id long, leaf long, score double"


def _able(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among some query's k nearest as far as rows of equal vectors decide: those with fewer than k others before them.

    Of one id k rows do, and of the others 2k, as a query skips those of its own id.
    """
    names = np.ascontiguousarray(vectors + 0).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()  # + 0: no -0.0
    _, group = np.unique(names, return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    n = np.arange(len(g))
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
    kept = n - np.maximum.accumulate(np.where(new, n, 0)) < k
    order, g = order[kept], g[kept]
    return np.sort(order[np.arange(len(g)) - np.searchsorted(g, g) < 2 * k])


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from the tasks' best."""
    best = partial.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))), 1, k).alias("best"))
    listed = best.select("query_id", F.posexplode("best").alias("at", "x"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def exact(rows: DataFrame, probes: pd.DataFrame, tree: Tree, k: int = K) -> DataFrame:
    """query_id, vec_id, leaf, score of the probes' k best of each task's rows (vec_id, vector); the probes are few."""
    ids, vectors = probes["vec_id"].to_numpy(), np.stack(probes["vector"].to_numpy()).astype(np.float64)

    def run(batches):
        best = _Nearest(ids, vectors, k)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x, names = _vectors(part.column(1)).astype(np.float64), np.asarray(part.column(0))
                kept = _able(names, x, k)
                x = x[kept]
                best.meet(np.arange(len(ids)), names[kept], x, tree.file(x))
        yield best.batch()

    return rows.select("vec_id", "vector").mapInArrow(run, _FOUND)


def _calibrated(tree: Tree, rows: DataFrame, probes: pd.DataFrame, k: int, target: float) -> int:
    """Leaf visits with which the probes' mean recall reaches the target."""
    if tree.leaves == 1 or len(probes) == 0:
        return tree.leaves
    partial = exact(rows, probes, tree, k)
    best = partial.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "leaf"))), 1, k).alias("best"))
    truth = {r.query_id: [x.leaf for x in r.best] for r in best.collect()}  # PROBES rows of k
    turn = tree.ranks(np.stack(probes["vector"].to_numpy()).astype(np.float64))
    ranks = [turn[i, truth[qid]] for i, qid in enumerate(probes["vec_id"]) if truth.get(qid)]
    recall = lambda n: float(np.mean([(r < n).mean() for r in ranks])) if ranks else 1.0
    visits = 1
    while visits < tree.leaves and recall(visits) < target:
        visits *= 2
    low, high = visits // 2, min(visits, tree.leaves)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if recall(middle) >= target else (middle, high)
    return high


def _placed(rows: DataFrame, tree: Tree, k: int | None = None) -> DataFrame:
    """rows (vec_id, vector) with their leaf; with ``k`` only those that equal vectors leave able to be found."""
    kind = dict(rows.dtypes)["vector"]

    def run(batches):
        for batch in batches:
            x = _vectors(batch.column(1))
            if k is not None and batch.num_rows:
                kept = _able(np.asarray(batch.column(0)), x, k)
                batch, x = batch.take(pa.array(kept)), x[kept]
            leaf = tree.file(x.astype(np.float64)) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], ["vec_id", "vector", "leaf"])

    return rows.select("vec_id", "vector").mapInArrow(run, f"vec_id long, vector {kind}, leaf long")


def _written(rows: DataFrame, folder: str, tasks: int, k: int) -> DataFrame:
    """Writes the rows (vec_id, vector, leaf, part) of each part of a leaf to the folder, ids first; part and size of what was written."""

    def out(batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        leaf, part = (table.column(c)[0].as_py() for c in ("leaf", "part"))
        ids, x = np.asarray(table.column("vec_id")), _vectors(table.column("vector").combine_chunks())
        kept = _able(ids, x, k)
        put(folder, f"{leaf}-{part}", np.concatenate([ids[kept].astype(np.int64).view(np.uint8), np.ascontiguousarray(x[kept]).ravel().view(np.uint8)]))
        return pa.RecordBatch.from_arrays([pa.array([leaf]), pa.array([part], pa.int32()), pa.array([len(kept)])], ["leaf", "part", "size"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            leaf, part = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            cuts = [0, *(np.flatnonzero((leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(leaf)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and (held[0].column(2)[0].as_py(), held[0].column(3)[0].as_py()) != (leaf[lo], part[lo]):
                    yield out(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield out(held)

    dealt = rows.select("vec_id", "vector", "leaf", "part").repartition(tasks, "leaf", "part").sortWithinPartitions("leaf", "part", "vec_id")
    return dealt.mapInArrow(run, "leaf long, part int, size long")


def search(embeddings: DataFrame, queries: DataFrame | None = None, k: int = K, target: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by inner product of every query (vec_id, embedding).

    Without ``queries``, those are the rows whose vec_id is divisible by 20.
    """
    spark = embeddings.sparkSession
    rows = save(_usable(embeddings), "vectors")
    asked = rows.where("vec_id % 20 = 0") if queries is None else save(_usable(queries), "asked")
    total = rows.count()
    part = min(1.0, MAX_SAMPLE / max(total, 1))
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * part) + (part == 1.0)).select("vector").limit(2 * MAX_SAMPLE).toPandas()
    sample = np.stack(chosen["vector"].to_numpy()).astype(np.float64) if len(chosen) else np.empty((0, 1))
    leaves = int(min(MAX_LEAVES, max(1, total // LEAF_ROWS), max(1, len(sample) // 8)))
    tree = grow(sample, leaves)
    probes = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).toPandas()
    probes = probes.drop_duplicates("vec_id")
    visits = _calibrated(tree, rows, probes, k, target)

    # at most MAX_LEAVES parts more than leaves, however many rows there are
    part_rows = max(2 * LEAF_ROWS, -(-total // MAX_LEAVES))
    able = _placed(rows, tree, k)
    sizes = able.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).select("leaf", F.ceil(F.col("size") / part_rows).cast("int").alias("parts"))
    folder = fresh_path(spark, "leaves")
    tasks = max(shuffle_partitions(spark), -(-total // (16 * BLOCK_ROWS)))
    parted = able.join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id", "vector", F.lit(3)), F.col("parts")).cast("int"))
    parts: dict[int, list[tuple[int, int]]] = {}
    for r in _written(parted, folder, tasks, k).collect():
        parts.setdefault(r.leaf, []).append((r.part, r.size))
    floats = dict(rows.dtypes)["vector"] == "array<float>"

    def rows_of(leaf: int):
        """ids and vectors of a leaf, some at a time."""
        for number, size in parts.get(leaf, []):
            raw = mapped(folder, f"{leaf}-{number}", "u1")
            ids, x = raw[: 8 * size].view(np.int64), raw[8 * size :].view(np.float32 if floats else np.float64).reshape(size, -1)
            for lo in range(0, size, BLOCK_ROWS):
                yield np.array(ids[lo : lo + BLOCK_ROWS]), x[lo : lo + BLOCK_ROWS].astype(np.float64)

    def find(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERY_ROWS):
                some = batch.slice(lo, QUERY_ROWS)
                vectors = _vectors(some.column(1)).astype(np.float64)
                best, turn = _Nearest(np.asarray(some.column(0)), vectors, k), np.ascontiguousarray(tree.ranks(vectors).T)
                first, last = 0, min(FIRST, visits)
                asking = np.ones(len(vectors), dtype=bool)
                while first < last and asking.any():
                    for leaf in range(tree.leaves):
                        now = np.flatnonzero((turn[leaf] >= first) & (turn[leaf] < last) & asking)
                        if len(now):
                            for ids, x in rows_of(leaf):
                                best.meet(now, ids, x, leaf)
                    best.settle()
                    if last >= visits:  # beyond them only queries that have not found k yet
                        asking = best.least == -np.inf
                    first, last = last, min(last * WIDER, visits if last < visits else tree.leaves)
                yield best.batch()

    # near queries visit the same leaves; one row per id and vector
    distinct = asked.dropDuplicates(["vec_id", "vector"])
    tasks = max(shuffle_partitions(spark), -(-asked.count() // QUERY_ROWS))
    dealt = _placed(distinct, tree).repartitionByRange(tasks, "leaf", "vec_id")
    best = save(_ranked(dealt.select("vec_id", "vector").mapInArrow(find, _FOUND), k), "best")
    remove(spark, folder)
    return best
