"""Staged dataflows: source, stages, sink.

A stage turns a frame into a frame, so a flow is one lineage and Spark
pipelines it.  A row processor, which returns a row or ``None`` to drop it, runs
in Arrow batches inside ``mapInPandas``; its parallelism is the number of
partitions.  The first error ends the job and is raised to the caller.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import StrandlineError
from ..operators.crawl import broadcast_union

Stage = Callable[[DataFrame], DataFrame]
Processor = Callable[[dict], dict | None]


def rows(process: Processor, schema: StructType | str | None = None) -> Stage:
    """A stage of a row function, in the order of the rows of each partition."""

    def stage(df: DataFrame) -> DataFrame:
        out = schema if schema is not None else df.schema
        names = out.fieldNames() if isinstance(out, StructType) else [c.split()[0] for c in out.split(",")]

        def run(batches):
            for batch in batches:
                kept = [r for r in map(process, batch.to_dict("records")) if r is not None]
                yield pd.DataFrame(kept, columns=names)

        return df.mapInPandas(run, out)

    return stage


def fixed_pool(stage: Stage, workers: int) -> Stage:
    """A stage dealt over so many partitions, without order."""
    if workers < 1:
        raise StrandlineError("at least one worker is needed")
    return lambda df: stage(df.repartition(workers))


def dynamic_pool(stage: Stage, most: int) -> Stage:
    """A stage over at most so many partitions; the cluster decides how many run at a time."""
    if most < 1:
        raise StrandlineError("at least one worker is needed")
    return lambda df: stage(df.coalesce(most))


def broadcast(*stages: Stage) -> Stage:
    """Every row to every stage; outputs as one bag."""
    if not stages:
        raise StrandlineError("at least one branch is needed")
    return lambda df: broadcast_union(df, stages)


class Pipeline:
    """Stages in a row."""

    def __init__(self, *stages: Stage) -> None:
        self.stages = stages

    def plan(self, source: DataFrame) -> DataFrame:
        for stage in self.stages:
            source = source.transform(stage)
        return source

    def process(self, source: DataFrame, sink: Callable[[DataFrame], None]) -> int:
        """Run the flow into ``sink``, one action; the number of rows that reached it."""
        seen = Observation()
        sink(self.plan(source).observe(seen, F.count(F.lit(1)).alias("rows")))
        return seen.get["rows"]


def discard(df: DataFrame) -> None:
    """A sink that keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def collect_into(target: list) -> Callable[[DataFrame], None]:
    """A sink into a list, for small results and tests."""
    return lambda df: target.extend(df.collect())


def processors(*functions: Processor) -> Pipeline:
    return Pipeline(*[rows(f) for f in functions])
