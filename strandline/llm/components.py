"""Connected components by randomised contraction.

Every round, each vertex joins the neighbour (or itself) with the smallest
random rank of that round; edges are rewritten between the chosen
representatives and the graph shrinks by a constant factor in expectation.
All steps are joins and partially aggregated minima, so a hub of any degree is
combined before the shuffle.  The rounds' tables are Parquet in the shared
folder, and the labels are composed backwards at the end.  What is left once at
most ``SMALL`` edges remain, some megabytes, is finished by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save

MAX_ROUNDS = 200
SMALL = 200_000


def _finish(batches):
    """(id, to) of every vertex of at most SMALL edges: one vertex of its component."""
    parts = list(batches)
    if not parts:
        return
    edges = pa.Table.from_batches(parts)
    ends = pa.concat_arrays([edges.column(0).combine_chunks(), edges.column(1).combine_chunks()]).dictionary_encode()
    number, names = np.asarray(ends.indices), ends.dictionary
    x, y = number[: edges.num_rows], number[edges.num_rows :]
    root = np.arange(len(names))
    while True:
        new = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[root]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], ["id", "to"])


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(id, root) for every vertex with an edge; root is one vertex of its component, not the least.

    Null endpoints and loops are ignored; repeated edges count once.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    live = save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while (left := live.count()) > 0:
        if left <= small:
            kind = live.schema["a"].dataType.simpleString()
            steps.append(save(live.coalesce(1).mapInArrow(_finish, f"id {kind}, to {kind}"), "step"))
            break
        if len(steps) >= MAX_ROUNDS:
            raise RuntimeError("components: contraction did not finish")
        salt = F.lit(len(steps) + 1)
        both = live.select("a", "b").union(live.select(F.col("b"), F.col("a")))
        ranked = both.select("a", F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("v")).alias("near"), F.struct(F.xxhash64("a", salt).alias("h"), F.col("a").alias("v")).alias("own"))
        best = ranked.groupBy("a").agg(F.min(F.least("near", "own")).alias("best"))
        step = save(best.select(F.col("a").alias("id"), F.col("best.v").alias("to")), "step")
        steps.append(step)
        moved = live.join(step.select(F.col("id").alias("a"), F.col("to").alias("ra")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("rb")), "b").where("ra <> rb")
        live = save(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not steps:
        return live.select(F.col("a").alias("id"), F.col("b").alias("root"))
    labels = steps[-1].select("id", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = labels.select(F.col("id").alias("to"), "root")
        labels = save(step.join(later, "to", "left").select("id", F.coalesce("root", "to").alias("root")), "labels")
    return labels
