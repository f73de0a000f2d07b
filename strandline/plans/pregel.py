"""A Pregel-style engine: supersteps of column expressions over vertex and edge tables.

Vertices have ``id``, ``value`` and ``active``; edges ``src``, ``dst`` and any
further columns.  In every superstep the vertices that are active or have a
message compute; what they send is combined by an aggregate before the shuffle
and arrives in the next superstep.  Delivery is a join on the vertex id, so a
message reaches any partition and no relay is needed.

State is written after each superstep in buckets of the id, edges once in
buckets of their source, so a superstep shuffles its messages only, and lost
executors lose nothing.  Aggregators and the count of active vertices are
computed in the same job; what the superstep before wrote is removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import InvalidMessageDestination, StrandlineError, UnknownEdgeSource
from ..shared import Tables


class GraphBuilder:
    """Vertices and edges added a frame at a time: the last value of a vertex wins, edges are a bag."""

    def __init__(self) -> None:
        self.vertices: list[DataFrame] = []
        self.edges: list[DataFrame] = []

    def add_vertices(self, vertices: DataFrame) -> GraphBuilder:
        """(id, value); a known id gets the new value.  Within one frame the greatest value of an id counts."""
        self.vertices.append(vertices.select("id", "value"))
        return self

    def add_edges(self, edges: DataFrame) -> GraphBuilder:
        """(src, dst and further columns); parallel edges stay."""
        self.edges.append(edges)
        return self

    def frames(self) -> tuple[DataFrame, DataFrame]:
        if not self.vertices:
            raise StrandlineError("a graph needs vertices")
        turns = [v.withColumn("turn", F.lit(i)) for i, v in enumerate(self.vertices)]
        last = reduce(DataFrame.union, turns).groupBy("id").agg(F.max(F.struct("turn", "value")).alias("last")).select("id", F.col("last.value").alias("value"))
        if not self.edges:
            return last, last.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
        return last, reduce(DataFrame.unionByName, self.edges)

    def reset(self) -> None:
        self.vertices.clear()
        self.edges.clear()


@dataclass
class Step:
    """What hooks and stop conditions see of a superstep."""

    superstep: int
    active: int
    aggregates: dict[str, float | int | None] = field(default_factory=dict)


@dataclass
class Result:
    vertices: DataFrame
    steps: list[Step]

    def deltas(self, name: str) -> list[float | int]:
        """An aggregator's change from each superstep to the next."""
        values = [s.aggregates.get(name) or 0 for s in self.steps]
        return [b - a for a, b in zip([0, *values], values, strict=False)]


class Pregel:
    """A vertex program.

    ``compute(value, message, superstep) -> (value, active)`` gives columns for
    vertices that compute; ``message`` is null without mail.
    ``send(value, edge, superstep) -> message`` runs for each out-edge of a vertex
    that computed; a null message is not sent.
    ``combine(message)`` is the aggregate of a vertex's mail; it must not depend
    on order.
    ``aggregators`` map names to aggregate columns over the vertices that
    computed.  They start from ``presets``; with ``accumulate`` they keep adding.
    """

    def __init__(
        self,
        compute: Callable[[Column, Column, int], tuple[Column, Column]],
        send: Callable[[Column, Callable[[str], Column], int], Column] | None = None,
        combine: Callable[[Column], Column] = F.sum,
        aggregators: dict[str, Column] | None = None,
        presets: dict[str, float | int] | None = None,
        accumulate: bool = True,
        unknown_dst: str = "error",
        pre_step: Callable[[int], None] | None = None,
        post_step: Callable[[Step], None] | None = None,
        keep_running: Callable[[Step], bool] | None = None,
    ) -> None:
        if compute is None:
            raise StrandlineError("a compute function is needed")
        if unknown_dst not in ("error", "drop"):
            raise StrandlineError("unknown_dst must be 'error' or 'drop'")
        self.compute, self.send, self.combine = compute, send, combine
        self.aggregators, self.presets, self.accumulate = aggregators or {}, presets or {}, accumulate
        self.unknown_dst, self.pre_step, self.post_step, self.keep_running = unknown_dst, pre_step, post_step, keep_running

    def _checked(self, vertices: DataFrame, edges: DataFrame) -> DataFrame:
        ids = vertices.select("id")
        if not edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").isEmpty():
            raise UnknownEdgeSource("an edge starts at an unknown vertex")
        known = ids.withColumnRenamed("id", "dst")
        if self.unknown_dst == "drop":
            return edges.join(known, "dst", "left_semi")
        if not edges.join(known, "dst", "left_anti").isEmpty():
            raise InvalidMessageDestination("an edge ends at an unknown vertex")
        return edges

    def run(self, vertices: DataFrame, edges: DataFrame, steps: int | None = None, start_active: bool = True) -> Result:
        """Run so many supersteps, or with ``steps=None`` until nothing is active and no mail waits, or ``keep_running`` says no."""
        tables = Tables(vertices.sparkSession)
        state = tables.put(vertices.select("id", "value", F.lit(start_active).alias("active"), F.lit(None).cast("boolean").alias("computed")), "id")
        edges = tables.put(self._checked(state, edges), "src")
        inbox: DataFrame | None = None
        totals = dict(self.presets)
        done: list[Step] = []
        while steps is None or len(done) < steps:
            turn = len(done)
            if self.pre_step:
                self.pre_step(turn)
            met = state.join(inbox, "id", "left") if inbox is not None else state.withColumn("message", F.lit(None).cast("double"))
            runs = F.col("active") | F.col("message").isNotNull()
            value, active = self.compute(F.col("value"), F.col("message"), turn)
            new = met.select("id", F.when(runs, value).otherwise(F.col("value")).alias("value"), F.when(runs, active).otherwise(F.lit(False)).alias("active"), runs.alias("computed"))
            seen = Observation()
            counts = [F.count_if("computed").alias("_active"), F.count_if("active").alias("_next"), *[c.alias(n) for n, c in self.aggregators.items()]]
            before, state = state, tables.put(new.observe(seen, *counts), "id", deal=False)
            got = seen.get
            tables.drop(before)
            tables.drop(inbox)
            for name in self.aggregators:
                now = got.get(name) or 0
                totals[name] = totals.get(name, 0) + now if self.accumulate else now
            step = Step(turn, got["_active"], dict(totals))
            done.append(step)
            if self.post_step:
                self.post_step(step)
            mail = 0
            if self.send and (steps is None or len(done) < steps):
                sent = edges.join(state.where("computed").select(F.col("id").alias("src"), "value"), "src")
                message = self.send(F.col("value"), F.col, turn)
                post = Observation()
                combined = sent.select(F.col("dst").alias("id"), message.alias("m")).where("m is not null").groupBy("id").agg(self.combine(F.col("m")).alias("message"))
                inbox = tables.put(combined.observe(post, F.count(F.lit(1)).alias("mail")), "id", deal=False)
                mail = post.get["mail"]
            if self.keep_running and not self.keep_running(step):
                break
            if steps is None and not got["_next"] and not mail:
                break
        tables.drop(edges)
        tables.drop(inbox)
        return Result(state.select("id", "value", "active"), done)
