"""Single-source shortest paths with a frontier: only vertices whose distance fell send on.

The rounds carry costs alone.  Predecessors are read off the final costs, and
whole paths are put together by doubling, in as many joins as the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import NegativeCost
from ..shared import Tables


def _costs(tables: Tables, ids: DataFrame, known: DataFrame, source: str, max_steps: int | None) -> DataFrame:
    """(id, cost, fresh), null where there is no path."""
    here = F.col("id") == source
    state = tables.put(ids.select("id", F.when(here, F.lit(0)).cast("long").alias("cost"), here.alias("fresh")), "id", deal=False)
    step = 0
    while max_steps is None or step < max_steps:
        front = state.where("fresh").select(F.col("id").alias("src"), F.col("cost").alias("at"))
        offers = known.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("at") + F.col("cost")).alias("offer"))
        lower = F.coalesce(F.col("offer") < F.col("cost"), F.col("offer").isNotNull())
        seen = Observation()
        moved = state.join(offers, "id", "left").select("id", F.when(lower, F.col("offer")).otherwise(F.col("cost")).alias("cost"), lower.alias("fresh"))
        before, state = state, tables.put(moved.observe(seen, F.count_if("fresh").alias("fresh")), "id", deal=False)
        tables.drop(before)
        step += 1
        if not seen.get["fresh"]:
            break
    return state


def _predecessors(tables: Tables, state: DataFrame, known: DataFrame, source: str) -> DataFrame:
    """(id, cost, prev).  Edges that cost something come first, as no cycle of predecessors can hold one."""
    costs = state.select("id", "cost")
    tight = known.join(costs.select(F.col("id").alias("src"), F.col("cost").alias("at")), "src").join(costs.select(F.col("id").alias("dst"), F.col("cost").alias("end")), "dst").where((F.col("at") + F.col("cost") == F.col("end")) & (F.col("dst") != source)).select("src", "dst", "cost")
    tight = tables.put(tight, "dst")
    first = tight.where("cost > 0").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("prev"))
    found = tables.put(costs.join(first, "id", "left"), "id", deal=False)
    free = tight.where("cost = 0")
    if not free.isEmpty():  # along edges without cost, outwards from vertices that have a predecessor
        while True:
            rooted = found.where((F.col("id") == source) | F.col("prev").isNotNull()).select(F.col("id").alias("src"))
            more = free.join(rooted, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("more"))
            seen = Observation()
            new = F.col("prev").isNull() & F.col("more").isNotNull()
            before, found = found, tables.put(found.join(more, "id", "left").observe(seen, F.count_if(new).alias("new")).select("id", "cost", F.coalesce("prev", "more").alias("prev")), "id", deal=False)
            tables.drop(before)
            if not seen.get["new"]:
                break
    tables.drop(tight)
    return found


def _paths(tables: Tables, found: DataFrame) -> DataFrame:
    """(id, cost, prev, path)."""
    # seg: the path from the vertex after ``up`` to id
    walk = tables.put(found.where("cost is not null").select("id", F.col("prev").alias("up"), F.array("id").alias("seg")), "id", deal=False)
    while not walk.where("up is not null").isEmpty():
        above = walk.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("seg").alias("before"))
        before, walk = walk, tables.put(walk.join(above, "up", "left").select("id", F.col("next").alias("up"), F.concat(F.coalesce("before", F.expr("cast(array() as array<string>)")), "seg").alias("seg")), "id")
        tables.drop(before)
    return found.join(walk.select("id", F.col("seg").alias("path")), "id", "left")


def shortest_paths(vertices: DataFrame, edges: DataFrame, source: str, max_steps: int | None = None) -> DataFrame:
    """(id, cost, prev, path): cheapest paths from ``source``; nulls where there is none.

    Of equally cheap predecessors the smallest id over an edge that costs
    something stands.  Edges with unknown ends are ignored; a negative cost is
    an error.  With ``max_steps`` paths have so many edges at most.
    """
    if not edges.where("cost < 0").isEmpty():
        raise NegativeCost("edge costs must not be negative")
    tables = Tables(vertices.sparkSession, edges.count())
    ids = tables.put(vertices.select("id").distinct(), "id")
    best = edges.groupBy("src", "dst").agg(F.min("cost").cast("long").alias("cost"))
    known = tables.put(best.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "src")
    state = _costs(tables, ids, known, source, max_steps)
    found = _predecessors(tables, state, known, source)
    tables.drop(known)
    return _paths(tables, found)


def path_to(paths: DataFrame, target: str) -> DataFrame:
    """cost and path to one vertex; nulls if it cannot be reached."""
    return paths.where(F.col("id") == target).select("id", "cost", "path")
