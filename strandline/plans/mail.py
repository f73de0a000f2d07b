"""Vertex programs that read every message: supersteps without a combiner.

Where :class:`Pregel` combines a vertex's mail by an aggregate, a program here gets
the messages one after the other, in ascending order, from a sort inside the
partitions: nothing gathers them, so a hub that gets a third of all mail takes
disk for its sort and the memory of one Arrow batch.  The program may stop
reading at any message.

Vertices lie in buckets of their id and messages are dealt out in the same
buckets, so a superstep shuffles the messages alone.  As in :class:`Pregel`, a
vertex computes if it is active or has mail, mail arrives in the next superstep,
and tables of older supersteps are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from ..errors import StrandlineError
from ..shared import Tables
from .pregel import Pregel, Result, Step


class _Letters:
    """Rows (id, value, active, message) of sorted Arrow batches, a vertex at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        self.next = next(self.rows, None)

    def of(self, name: Any) -> Iterator[Any]:
        """Messages of the vertex whose first row is next."""
        while self.next is not None and self.next[0] == name:
            message = self.next[3]
            self.next = next(self.rows, None)
            if message is not None:
                yield message


class MailProgram:
    """``compute(value, messages, superstep) -> (value, active)`` in Python, ``messages`` an iterator in ascending order.

    ``send(value, edge, superstep) -> message`` gives columns, as in :class:`Pregel`;
    a null message is not sent.  ``count=True`` calls ``compute(value, messages,
    superstep, n)`` with the number of messages, for programs that look for a
    place among them.
    """

    def __init__(self, compute: Callable, send: Callable[[Column, Callable[[str], Column], int], Column], unknown_dst: str = "error", count: bool = False) -> None:
        if compute is None:
            raise StrandlineError("a compute function is needed")
        self.compute, self.send, self.count = compute, send, count
        self.checker = Pregel(lambda value, mail, step: (value, F.lit(False)), unknown_dst=unknown_dst)

    def _computed(self, rows: DataFrame, turn: int) -> DataFrame:
        """(id, value, active, computed) of sorted rows (id, value, active, message, n)."""
        schema = StructType([*(rows.schema[c] for c in ("id", "value")), StructField("active", BooleanType()), StructField("computed", BooleanType())])
        kinds = list(to_arrow_schema(schema).types)
        compute, count = self.compute, self.count

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            letters, done = _Letters(batches), []

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], schema.fieldNames())
                done.clear()
                return out

            while letters.next is not None:
                name, value, active, message, n = letters.next
                mail = letters.of(name)
                if active or message is not None:
                    value, active = compute(value, mail, turn, n) if count else compute(value, mail, turn)
                    done.append((name, value, active, True))
                else:
                    done.append((name, value, False, False))
                for _ in mail:  # what the program left unread
                    pass
                if len(done) >= 1 << 14:
                    yield flush()
            if done:
                yield flush()

        return rows.mapInArrow(run, schema)

    def run(self, vertices: DataFrame, edges: DataFrame, steps: int | None = None, start_active: bool = True) -> Result:
        """Run so many supersteps, or with ``steps=None`` until nothing is active and no mail waits."""
        tables = Tables(vertices.sparkSession)
        state = tables.put(vertices.select("id", "value", F.lit(start_active).alias("active"), F.lit(None).cast("boolean").alias("computed")), "id")
        edges = tables.put(self.checker._checked(state, edges), "src")
        inbox: DataFrame | None = None
        done: list[Step] = []
        while steps is None or len(done) < steps:
            turn = len(done)
            met = state.select("id", "value", "active")
            if inbox is None:
                met = met.withColumn("message", F.lit(None).cast("double"))
            else:
                met = met.join(inbox, "id", "left")
            if inbox is not None and self.count:
                met = met.join(inbox.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            else:
                met = met.withColumn("n", F.lit(0).cast("long"))
            seen = Observation()
            new = self._computed(met.sortWithinPartitions("id", "message"), turn).observe(seen, F.count_if("computed").alias("ran"), F.count_if("active").alias("next"))
            before, state = state, tables.put(new, "id", deal=False)
            tables.drop(before)
            tables.drop(inbox)
            done.append(Step(turn, seen.get["ran"]))
            mail = 0
            inbox = None
            if steps is None or len(done) < steps:
                sent = edges.join(state.where("computed").select(F.col("id").alias("src"), "value"), "src")
                post = Observation()
                letters = sent.select(F.col("dst").alias("id"), self.send(F.col("value"), F.col, turn).alias("message")).where("message is not null")
                inbox = tables.put(letters.observe(post, F.count(F.lit(1)).alias("mail")), "id")
                mail = post.get["mail"]
            if steps is None and not seen.get["next"] and not mail:
                break
        tables.drop(edges)
        tables.drop(inbox)
        return Result(state.select("id", "value", "active"), done)
