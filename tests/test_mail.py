import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandline.errors import InvalidMessageDestination, StrandlineError
from strandline.plans.mail import MailProgram


def test_every_message_in_order(spark):
    rnd = random.Random(2)
    names = [f"v{i}" for i in range(40)]
    edges = [(rnd.choice(names), rnd.choice(names[:30])) for _ in range(300)] + [(n, "v0") for n in names] * 3  # repeated messages, a hub, vertices without mail
    values = {n: float(rnd.randint(0, 9)) for n in names}
    v = spark.createDataFrame(list(values.items()), "id string, value double")
    e = spark.createDataFrame(edges, "src string, dst string")

    def program(value, messages, step, n):
        if step == 0:
            return value, False
        got = list(messages)
        assert got == sorted(got) and len(got) == n
        return statistics.median(got), False

    got = {r.id: r.value for r in MailProgram(program, lambda value, edge, step: value, count=True).run(v, e, steps=2).vertices.collect()}
    for n in names:
        mail = [values[a] for a, b in edges if b == n]
        assert got[n] == (statistics.median(mail) if mail else values[n])


def test_runs_until_quiet(spark):
    """A value goes down a chain; a vertex without mail sleeps, and unread messages do no harm."""
    names = [str(i) for i in range(6)]
    v = spark.createDataFrame([(n, 1 if n == "0" else 0) for n in names], "id string, value long")
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(5)] * 2, "src string, dst string")

    def program(value, messages, step):
        return (max(value, next(messages, 0)), False)

    result = MailProgram(program, lambda value, edge, step: F.when(value > 0, value + 1)).run(v, e)
    assert {r.id: r.value for r in result.vertices.collect()} == {n: i + 1 for i, n in enumerate(names)}
    assert [s.active for s in result.steps] == [6, 1, 1, 1, 1, 1]


def test_a_hub_is_streamed(spark):
    """One vertex gets every message; the program sees them through an iterator of batches."""
    n = 200_000
    v = spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("value"))
    e = spark.range(n).select(F.col("id").cast("string").alias("src"), F.lit("7").alias("dst"))

    def program(value, messages, step, count):
        return (next(itertools.islice(messages, count // 2, None)) if count else value), False

    found = MailProgram(program, lambda value, edge, step: value, count=True).run(v, e, steps=2).vertices
    assert found.where("id = '7'").first().value == n // 2 and found.count() == n


def test_unknown_targets_and_settings(spark):
    v, e = spark.createDataFrame([("a", 1)], "id string, value long"), spark.createDataFrame([("a", "b")], "src string, dst string")
    program = lambda value, messages, step: (value, False)
    with pytest.raises(InvalidMessageDestination):
        MailProgram(program, lambda value, edge, step: value).run(v, e, steps=1)
    assert MailProgram(program, lambda value, edge, step: value, unknown_dst="drop").run(v, e).vertices.count() == 1
    with pytest.raises(StrandlineError):
        MailProgram(None, None)
