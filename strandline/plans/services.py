"""The periodic passes as services: crawl and rank over stores, with checked settings.

A service is a plain object with one method for one pass; a group runs passes at
their intervals until told to stop, and ends all at the first error.  Time comes
from a function that the caller gives.
"""

from __future__ import annotations

import re
import socket
import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NoPartitionData, StrandlineError
from ..functions.ids import partition_extent
from ..operators import crawl, graphstore
from ..shared import Tables
from ..sources.stores import Store
from .pagerank import pagerank


def _required(**settings) -> None:
    missing = [name for name, value in settings.items() if value is None or (isinstance(value, timedelta) and value <= timedelta(0))]
    if missing:
        raise StrandlineError("missing or not positive: " + ", ".join(missing))


def fixed_partition(index: int, of: int) -> Callable[[], tuple[int, int]]:
    """The same partition in every pass."""
    return lambda: (index, of)


def host_partition(count: Callable[[], int], host: Callable[[], str] = socket.gethostname) -> Callable[[], tuple[int, int]]:
    """The partition that the number at the end of this host's name gives (``crawler-3``), of ``count()`` replicas.

    ``count`` asks the cluster, such as for the number of service records; if
    that fails or counts too few, the pass is put off.
    """

    def detect() -> tuple[int, int]:
        number = re.search(r"-([0-9]+)$", host())
        if number is None:
            raise StrandlineError(f"the host's name {host()!r} does not end in a number")
        try:
            replicas = count()
        except OSError as error:
            raise NoPartitionData("the number of partitions is not known yet") from error
        if replicas <= int(number[1]):
            raise NoPartitionData(f"{replicas} replicas are known, and this is number {number[1]}")
        return int(number[1]), replicas

    return detect


@dataclass
class CrawlService:
    """Fetches links not retrieved for ``reindex_after`` in this replica's id range, and updates graph and index."""

    graph: Store | None = None
    documents: Store | None = None
    fetch: Callable[[DataFrame], DataFrame] | None = None
    interval: timedelta | None = None
    reindex_after: timedelta | None = None
    partition: Callable[[], tuple[int, int] | None] = lambda: (0, 1)
    hosts: DataFrame | None = None
    clock: Callable[[], datetime] = datetime.now
    name: str = "crawler"

    def __post_init__(self) -> None:
        _required(graph=self.graph, documents=self.documents, fetch=self.fetch, interval=self.interval, reindex_after=self.reindex_after)

    def run_once(self) -> int:
        """One pass; the number of pages crawled.  Without partition data the pass is put off."""
        found = self.partition()
        if found is None:
            raise NoPartitionData("the number of partitions is not known yet")
        lo, hi = partition_extent(*found)
        now = F.lit(self.clock())
        links = self.graph.read("links", lo, hi)
        due = crawl.requestable(graphstore.links_scan(links, lo, hi, F.lit(self.clock() - self.reindex_after)), self.hosts)
        # fetched once, so that links, edges and documents of a pass agree even if an executor is lost
        tables = Tables(links.sparkSession)
        crawled = tables.put(crawl.crawl_pages(due, self.fetch(due), self.hosts), "id")
        try:
            count = crawled.count()
            if count:
                # only changes are written, so passes that overlap keep each other's; the pages count as retrieved at the end
                targets, touched, followed, cutoffs = graphstore.pass_changes(crawled, now)
                self.graph.upsert_links(targets)
                self.graph.upsert_edges(self.graph.link_ids(followed).select("src", F.col("id").alias("dst")), now, cutoffs)
                self.documents.put_documents(crawled.select(F.col("id").alias("link_id"), "url", "title", F.col("text").alias("content"), now.alias("indexed_at")))
                self.graph.upsert_links(touched)
            return count
        finally:
            tables.drop(crawled)


@dataclass
class RankService:
    """Ranks the whole graph and stores the scores; only the first partition's replica does."""

    graph: Store | None = None
    documents: Store | None = None
    interval: timedelta | None = None
    partition: Callable[[], tuple[int, int] | None] = lambda: (0, 1)
    clock: Callable[[], datetime] = datetime.now
    name: str = "ranker"

    def __post_init__(self) -> None:
        _required(graph=self.graph, documents=self.documents, interval=self.interval)

    def run_once(self) -> int:
        """One pass; the number of links ranked."""
        found = self.partition()
        if found is None:
            raise NoPartitionData("the number of partitions is not known yet")
        if found[0] != 0:
            return 0
        start = F.lit(self.clock())
        links = self.graph.read("links").where(F.col("retrieved_at") < start).select("id")
        edges = self.graph.read("edges").where(F.col("updated_at") < start).select("src", "dst")
        ranks = pagerank(links, edges)
        self.documents.put_scores(ranks.select(F.col("id").alias("link_id"), F.col("rank").alias("score")))
        return ranks.count()


class ServiceGroup:
    """Runs services at their intervals, each pass after one interval; the first error stops all."""

    def __init__(self, *services) -> None:
        self.services, self.stopping, self.errors = services, threading.Event(), []

    def _loop(self, service) -> None:
        while not self.stopping.wait(service.interval.total_seconds()):
            try:
                service.run_once()
            except NoPartitionData:
                continue
            except Exception as error:  # noqa: BLE001 - reported to the caller of run()
                self.errors.append(StrandlineError(f"{service.name}: {error}"))
                self.stopping.set()

    def stop(self) -> None:
        self.stopping.set()

    def run(self) -> None:
        """Block until stopped; raise what went wrong."""
        threads = [threading.Thread(target=self._loop, args=(s,), daemon=True) for s in self.services]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        if self.errors:
            raise ExceptionGroup("services failed", self.errors)
