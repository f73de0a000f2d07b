"""Mixing sources to target weights by Pfair scheduling (operator 5, native).

Each source's documents form blocks of ``BLOCK_CHARS`` characters.  A source of
weight ``w = share / period`` releases its i-th block (from 0) at slot
``floor(i / w)`` with deadline ``ceil((i + 1) / w)``; in every slot the released
block with the earliest deadline runs.  As the weights sum to one, every block
meets its deadline, and up to any slot each source has run within one block of
its target.

Windows repeat after ``period`` slots, so one period is scheduled, by a fold
over its slots inside the SQL engine, and block i of a source takes the slot of
block ``i mod share`` in period ``i div share``.  The period has about ``PERIOD``
slots however large the data are; every source has one slot at least, and more
sources than slots are an error, since no schedule of that period could hold
them (a longer ``period`` can).  When a source has run out, its slots stay
empty and the others keep their proportions.

Blocks come from exact running lengths: documents are ordered by the MD5 of
their id within their source, lengths are added up in ``BUCKETS`` ranges of that
hash, and ranges start where the sums of those before end.  No window spans a
source, so a source with a third of all rows is spread like the rest.

Defined results: a null or empty text has no length and shares its
predecessor's block; repeated rows are scheduled each by itself; null sources
are one source of their own, and null ids sort first.  Texts longer than a
block leave the slots they pass empty.  Other columns are not read by
:func:`schedule`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import save

BLOCK_CHARS = 65536
PERIOD = 1024
BUCKETS = 4096


def tempered_shares(sizes: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, share): target weights in proportion to the square root of the sources' lengths, as whole slots of a period."""
    rooted = sizes.withColumn("root", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("chars").cast("double"))).cast("long")))
    total = rooted.agg(F.sum("root")).scalar()
    many = F.raise_error(F.lit(f"mixing: more sources than the {period} slots of a period")).cast("long")
    sources = rooted.agg(F.count(F.lit(1))).scalar()
    given = rooted.withColumn("total", total).withColumn("sources", sources)
    return given.select("source", F.when(F.col("sources") > period, many).otherwise(F.expr(f"greatest(1L, ({period} * root) div total)")).alias("share"))


def period_slots(shares: DataFrame) -> DataFrame:
    """(source, nth, slot, period): earliest deadline first over one period."""
    listed = shares.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNotNull().alias("named"), "source", "share"))).alias("s"), F.sum("share").alias("period")).where("period > 0")
    # the state holds every source's count of blocks run and the source of each slot
    step = """
        aggregate(
          sequence(0L, period - 1L),
          named_struct('done', transform(s, x -> 0L), 'ran', cast(array() as array<int>)),
          (z, t) -> transform(array(array_min(filter(
              transform(s, (x, i) -> if((z.done[i] * period) div x.share <= t and z.done[i] < x.share,
                  named_struct('due', ((z.done[i] + 1) * period + x.share - 1) div x.share, 'i', i), null)),
              y -> y is not null))),
            p -> named_struct('done', transform(z.done, (d, i) -> if(i = p.i, d + 1L, d)), 'ran', concat(z.ran, array(p.i))))[0]
        ).ran"""
    ran = listed.select("s", "period", F.expr(step).alias("ran")).select("s", "period", F.posexplode("ran").alias("slot", "i"))
    nth = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    return ran.select(F.col("s")[F.col("i")]["source"].alias("source"), F.col("s")[F.col("i")]["share"].alias("share"), nth.cast("long").alias("nth"), F.col("slot").cast("long").alias("slot"), "period")


def _blocks(documents: DataFrame, block_chars: int) -> tuple[DataFrame, DataFrame]:
    """(rows with md, chars and their block's number in the source; sources with their chars)."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("chars")
    ).withColumn("md", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = save(rows.withColumn("range", F.expr(f"cast(conv(substr(md, 1, 3), 16, 10) as int) * {BUCKETS} div 4096")), "lengths")
    sums = rows.groupBy("source", "range").agg(F.sum("chars").alias("held"))
    ahead = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("source").alias("_s"), F.col("range").alias("_r"), ahead.alias("ahead"))
    inside = Window.partitionBy("source", "range").orderBy(F.col("md"), F.col("doc_id").asc_nulls_first(), "chars").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    numbered = placed.select("doc_id", "source", "chars", "md", F.expr(f"(ahead + before) div {block_chars}").alias("block"))
    return numbered, sums.groupBy("source").agg(F.sum("held").alias("chars"))


def schedule(documents: DataFrame, shares: DataFrame | None = None, block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """doc_id, source, chars, block, released, due and slot of every document.

    ``shares`` (source, share: slots of a period) are the target weights;
    without them they are tempered by length.
    """
    numbered, sizes = _blocks(documents, block_chars)
    slots = period_slots(shares if shares is not None else tempered_shares(sizes, period)).withColumnRenamed("source", "_s")
    met = numbered.join(slots.withColumnRenamed("slot", "at"), F.col("source").eqNullSafe(F.col("_s")) & (F.pmod("block", "share") == F.col("nth")))
    return met.select(
        "doc_id", "source", "chars", "block", F.expr("(block * period) div share").alias("released"), F.expr("((block + 1) * period + share - 1) div share").alias("due"), F.expr("(block div share) * period + at").alias("slot")
    )


def mixed(documents: DataFrame, **options) -> DataFrame:
    """``documents``, every row once, in the order of the schedule: written out, its files follow the slots."""
    plan = schedule(documents, **options).select(F.col("doc_id").alias("_sl_id"), F.col("source").alias("_sl_source"), F.col("chars").alias("_sl_chars"), "slot")
    plan = plan.groupBy("_sl_id", "_sl_source", "_sl_chars").agg(F.min("slot").alias("_sl_slot"))
    chars = F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    placed = documents.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col("_sl_id")) & F.col("source").cast("string").eqNullSafe(F.col("_sl_source")) & (chars == F.col("_sl_chars")), "left")
    spread = placed.repartitionByRange(F.col("_sl_slot"), F.col("_sl_id"))
    return spread.sortWithinPartitions("_sl_slot", "_sl_id").select(*[F.col(f"`{c}`") for c in documents.columns])


def oracle(table: str = "documents") -> str:
    """DuckDB SQL with the columns of :func:`schedule`."""
    return f"""
    WITH RECURSIVE rows_ AS (
      SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(length(text), 0) AS BIGINT) AS chars,
             md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS md FROM {table}),
    numbered AS (
      SELECT doc_id, source, chars,
             CAST(coalesce(sum(chars) OVER (PARTITION BY source ORDER BY md, doc_id NULLS FIRST, chars
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {BLOCK_CHARS} AS block FROM rows_),
    roots AS (SELECT source, greatest(1, CAST(floor(sqrt(CAST(sum(chars) AS DOUBLE))) AS BIGINT)) AS root FROM rows_ GROUP BY source),
    shares AS (SELECT source, greatest(1, ({PERIOD} * root) // CAST(sum(root) OVER () AS BIGINT)) AS share FROM roots),
    listed AS (SELECT source, share, row_number() OVER (ORDER BY source NULLS FIRST) AS i, CAST(sum(share) OVER () AS BIGINT) AS period FROM shares),
    run(t, done, pick) AS (
      SELECT CAST(-1 AS BIGINT), (SELECT list(CAST(0 AS BIGINT) ORDER BY i) FROM listed), CAST(NULL AS BIGINT)
      UNION ALL
      SELECT t + 1, list_transform(done, lambda d, j: CASE WHEN j = p THEN d + 1 ELSE d END), p FROM (
        SELECT r.t, r.done, (SELECT arg_min(l.i, ((r.done[l.i] + 1) * l.period + l.share - 1) // l.share * 100000 + l.i) FROM listed l
            WHERE (r.done[l.i] * l.period) // l.share <= r.t + 1 AND r.done[l.i] < l.share) AS p
        FROM run r WHERE r.t + 1 < (SELECT max(period) FROM listed))),
    slots AS (SELECT l.source, l.share, l.period, run.t AS at, row_number() OVER (PARTITION BY l.i ORDER BY run.t) - 1 AS nth FROM run JOIN listed l ON run.pick = l.i)
    SELECT n.doc_id, n.source, n.chars, n.block, (n.block * s.period) // s.share AS released,
           ((n.block + 1) * s.period + s.share - 1) // s.share AS due, (n.block // s.share) * s.period + s.at AS slot
    FROM numbered n JOIN slots s ON n.source IS NOT DISTINCT FROM s.source AND n.block % s.share = s.nth"""
