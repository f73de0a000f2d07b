"""``python -m strandline``: crawler, ranker and front end over one link graph and one text index."""

from __future__ import annotations

import argparse
import re
import socket
from datetime import timedelta

from .errors import StrandlineError

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def duration(text: str) -> timedelta:
    """``90s``, ``5m``, ``1h30m``, ``7d``."""
    if not re.fullmatch(r"(?:\d+[smhd])+", text):
        raise argparse.ArgumentTypeError(f"{text!r} is no duration")
    return timedelta(seconds=sum(int(n) * _UNITS[u] for n, u in re.findall(r"(\d+)([smhd])", text)))


def partition(mode: str):
    """``single``, or ``dns=<name>`` of a headless service whose replicas have numbered host names."""
    from .plans.services import fixed_partition, host_partition

    if mode == "single":
        return fixed_partition(0, 1)
    if mode.startswith("dns="):
        return host_partition(lambda: len({a[4][0] for a in socket.getaddrinfo(mode[4:], None)}))
    raise StrandlineError(f"unsupported partition detection {mode!r}")


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__)
    p.add_argument("--frontend-listen-addr", default=":8080")
    p.add_argument("--frontend-results-per-page", type=int, default=10)
    p.add_argument("--frontend-max-summary-length", type=int, default=256)
    p.add_argument("--crawler-update-interval", type=duration, default=duration("5m"))
    p.add_argument("--crawler-reindex-threshold", type=duration, default=duration("7d"))
    p.add_argument("--ranker-update-interval", type=duration, default=duration("1h"))
    p.add_argument("--link-graph-uri", default="in-memory:")
    p.add_argument("--text-indexer-uri", required=True, help="index:<folder>")
    p.add_argument("--partition-detection-mode", default="single")
    return p.parse_args(args)


def services(spark, options: argparse.Namespace) -> list:
    from urllib.error import URLError
    from urllib.request import HTTPRedirectHandler, build_opener

    from .operators import crawl
    from .plans.frontend import Frontend
    from .plans.services import CrawlService, RankService
    from .sources.stores import IndexStore, open_graph, open_index

    graph, documents = open_graph(spark, options.link_graph_uri), open_index(spark, options.text_indexer_uri)
    if not isinstance(documents, IndexStore):
        raise StrandlineError("the front end searches an index:<folder>")

    def addresses(name: str) -> set[str]:
        return {a[4][0] for a in socket.getaddrinfo(name, None)}

    class Checked(HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            if crawl.refused(newurl, addresses):
                raise URLError(f"redirected to {newurl}")
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    def get(url: str) -> tuple[int, str, str]:
        with build_opener(Checked).open(url, timeout=30) as got:
            return got.status, got.headers.get("Content-Type", ""), got.read().decode("utf-8", "replace")

    where = partition(options.partition_detection_mode)
    host, _, port = options.frontend_listen_addr.rpartition(":")
    return [
        Frontend(graph, documents, options.frontend_results_per_page, options.frontend_max_summary_length, (host or "0.0.0.0", int(port))),
        CrawlService(graph, documents, lambda due: crawl.fetch_live(due, get, addresses).drop("id"), options.crawler_update_interval, options.crawler_reindex_threshold, where),
        RankService(graph, documents, options.ranker_update_interval, where),
    ]


def main() -> None:
    from pyspark.sql import SparkSession

    from .plans.services import ServiceGroup
    from .ship import ship

    options = arguments()
    spark = SparkSession.builder.appName("strandline").getOrCreate()
    ship(spark)
    ServiceGroup(*services(spark, options)).run()


if __name__ == "__main__":
    main()
