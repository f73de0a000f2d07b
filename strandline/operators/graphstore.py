"""The link graph: scans, upserts and removals over link and edge tables.

Every operation is a function of DataFrames and an explicit ``now``; nothing
reads the clock.  Scans are plain comparisons, which reach the Parquet readers
as pushed filters.  Upserts are one union and one partially aggregated group,
so a key with very many rows is combined before the shuffle.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotFound, UnknownEdgeLinks
from ..functions import ids
from ..schemas import never


def _time(value: datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def links_scan(links: DataFrame, lo: str, hi: str, retrieved_before) -> DataFrame:
    """Links with lo <= id < hi, last retrieved before a time; a link never retrieved always qualifies."""
    return links.where((F.col("id") >= lo) & (F.col("id") < hi) & (F.col("retrieved_at") < _time(retrieved_before)))


def edges_scan(edges: DataFrame, lo: str, hi: str, updated_before) -> DataFrame:
    """Edges whose source lies in [lo, hi), updated before a time."""
    return edges.where((F.col("src") >= lo) & (F.col("src") < hi) & (F.col("updated_at") < _time(updated_before)))


def stale_links(links: DataFrame, now, threshold: str = "7 days") -> DataFrame:
    """Links not retrieved within the threshold before ``now``."""
    return links.where(F.col("retrieved_at") < _time(now) - F.expr(f"INTERVAL {threshold}"))


def find_link(links: DataFrame, link_id: str) -> DataFrame:
    """The link of an id, as a frame of at most one row."""
    return links.where(F.col("id") == link_id).limit(1)


def require_link(links: DataFrame, link_id: str):
    """The link of an id as a row; NotFound if there is none."""
    found = find_link(links, link_id).collect()
    if not found:
        raise NotFound(f"link {link_id}")
    return found[0]


def upsert_links(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or touch by URL: a known URL keeps its id, the latest retrieval wins.

    ``incoming`` has url and, if known, retrieved_at; ids that it brings are ignored.
    """
    when = F.coalesce(F.col("retrieved_at").cast("timestamp"), never()) if "retrieved_at" in incoming.columns else never()
    new = incoming.select(F.lit(None).cast("string").alias("id"), "url", when.alias("retrieved_at"))
    both = links.select("id", "url", "retrieved_at").unionByName(new)
    merged = both.groupBy("url").agg(F.min("id").alias("id"), F.max("retrieved_at").alias("retrieved_at"))
    return merged.select(F.coalesce("id", ids.link_id(F.col("url"))).alias("id"), "url", "retrieved_at")


def known_edges(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges both of whose ends are links."""
    known = links.select(F.col("id"))
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def unknown_edges(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges with an end that is no link."""
    known = links.select(F.col("id").alias("_id"), F.lit(True).alias("_known")).distinct()
    src = known.select(F.col("_id").alias("src"), F.col("_known").alias("_s"))
    dst = known.select(F.col("_id").alias("dst"), F.col("_known").alias("_d"))
    return edges.join(src, "src", "left").join(dst, "dst", "left").where("_s is null or _d is null").select(*edges.columns)


def upsert_edges(edges: DataFrame, incoming: DataFrame, links: DataFrame, now, unknown: str = "drop") -> DataFrame:
    """Insert or touch by (src, dst) at ``now``; edges with unknown ends are dropped, or raise with ``unknown='error'``."""
    if unknown == "error" and not unknown_edges(incoming, links).isEmpty():
        raise UnknownEdgeLinks("an edge names an unknown link")
    new = known_edges(incoming.select("src", "dst"), links).select(F.lit(None).cast("string").alias("id"), "src", "dst", _time(now).alias("updated_at"))
    merged = edges.select("id", "src", "dst", "updated_at").unionByName(new).groupBy("src", "dst").agg(F.min("id").alias("id"), F.max("updated_at").alias("updated_at"))
    return merged.select(F.coalesce("id", ids.edge_id(F.col("src"), F.col("dst"))).alias("id"), "src", "dst", "updated_at")


def remove_stale_edges(edges: DataFrame, src: str, before) -> DataFrame:
    """Without one source's edges updated before a time."""
    return edges.where(~((F.col("src") == src) & (F.col("updated_at") < _time(before))))


def remove_stale_edges_many(edges: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The same for many sources: ``cutoffs`` has src and updated_before."""
    cut = cutoffs.groupBy("src").agg(F.max("updated_before").alias("_before"))
    return edges.join(cut, "src", "left").where(F.col("_before").isNull() | (F.col("updated_at") >= F.col("_before"))).select(*edges.columns)


def remove_links(links: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links without those of ``gone`` (id), and edges without theirs."""
    left = links.join(gone.select("id"), "id", "left_anti")
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return left, kept.select(*edges.columns)


def partition_links(links: DataFrame, n: int) -> DataFrame:
    """Links with the number of their range of ``n``."""
    return links.withColumn("partition", ids.partition_index(F.col("id"), n))


def pass_changes(crawled: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What crawled pages (id, url, links, no_follow_links) change in the graph at ``now``.

    (targets, touched, followed, cutoffs): links to add (url), links retrieved (url,
    retrieved_at), new or kept edges (src, url), and sources whose older edges go
    (src, updated_before).
    """
    targets = crawled.select(F.explode(F.concat("links", "no_follow_links")).alias("url"))
    followed = crawled.select(F.col("id").alias("src"), F.explode("links").alias("url"))
    cutoffs = crawled.select(F.col("id").alias("src"), _time(now).alias("updated_before"))
    return targets, crawled.select("url", _time(now).alias("retrieved_at")), followed, cutoffs


def graph_update(links: DataFrame, edges: DataFrame, crawled: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Merge crawled pages (id, url, links, no_follow_links) into the graph at ``now``.

    Sources are touched, all targets become links, followed targets become
    edges, and a crawled page's edge set is replaced: edges of it that this pass
    did not touch go.
    """
    touched = crawled.select("url", _time(now).alias("retrieved_at"))
    followed = crawled.select("url", F.explode("links").alias("to"))
    targets = followed.select(F.col("to").alias("url")).union(crawled.select(F.explode("no_follow_links").alias("url"))).select("url", never().alias("retrieved_at"))
    new_links = upsert_links(links, touched.unionByName(targets))
    named = new_links.select("id", "url")
    pairs = followed.join(named.select(F.col("id").alias("src"), "url"), "url").select("src", F.col("to").alias("url")).join(named.select(F.col("id").alias("dst"), "url"), "url").select("src", "dst")
    new = pairs.select(F.lit(None).cast("string").alias("id"), "src", "dst", _time(now).alias("updated_at"))
    merged = edges.select("id", "src", "dst", "updated_at").unionByName(new).groupBy("src", "dst").agg(F.min("id").alias("id"), F.max("updated_at").alias("updated_at"))
    merged = merged.select(F.coalesce("id", ids.edge_id(F.col("src"), F.col("dst"))).alias("id"), "src", "dst", "updated_at")
    sources = touched.join(named, "url").select(F.col("id").alias("src"), F.col("retrieved_at").alias("updated_before"))
    return new_links, remove_stale_edges_many(merged, sources)
