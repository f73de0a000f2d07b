"""The crawl dataflow: fetch, filter, extract links and text, fan out.

A pass is one lineage of column expressions; branches share it and are joined
by a bag union.  Fetching over the network is an optional ``mapInArrow`` with a
function of the caller's; by default pages come from a table.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StrandlineError
from ..functions import html as H
from ..functions import network as N
from .networks import match


def fetched(links: DataFrame, pages: DataFrame, fetch: str | None = None) -> DataFrame:
    """Links (id, url, retrieved_at) with their pages (url, html[, status, content_type]); links without a page drop out.

    ``fetch`` names a column of both that tells fetches of one URL apart; without it
    every page of a link's URL is a row.
    """
    on = ["url", *([fetch] if fetch else [])]
    return links.select("id", *on, "retrieved_at").join(pages, on)


LIVE = "id string, url string, status int, content_type string, html string"
_EXCLUDED = re.compile(H.EXCLUDED.replace("(?id)", "(?i)").replace("$", r"\Z"))


def refused(url: str, addresses: Callable[[str], Iterable[str]], blocks: tuple[str, ...] = N.PRIVATE_BLOCKS) -> bool:
    """Whether a URL must not be requested: no http(s), an excluded ending, or a host that has a private address or none.

    ``addresses(host)`` gives the addresses of a name; if it fails, the host counts as private.
    """
    try:
        parts = urlsplit(url)
        host = parts.hostname
        if parts.scheme.lower() not in ("http", "https") or not host or _EXCLUDED.search(url):
            return True
        try:
            found = [ipaddress.ip_address(host)]
        except ValueError:
            found = [ipaddress.ip_address(a.split("%")[0]) for a in addresses(host)]
    except (ValueError, OSError):
        return True
    nets = [ipaddress.ip_network(b, strict=False) for b in blocks]
    found = [getattr(a, "ipv4_mapped", None) or a for a in found]
    return not found or any(a in net for a in found for net in nets if net.version == a.version)


def fetch_live(links: DataFrame, get: Callable[[str], tuple[int, str, str]], addresses: Callable[[str], Iterable[str]] | None = None) -> DataFrame:
    """Pages (id, url, status, content_type, html) fetched by ``get(url) -> (status, content_type, html)``; a failure drops the row.

    With ``addresses`` (see :func:`refused`) no refused URL is requested; ``get``
    has to ask :func:`refused` again before it follows a redirect.
    """
    names = [c.split()[0] for c in LIVE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if addresses is not None and refused(url, addresses):
                    continue
                try:
                    rows.append((i, url, *get(url)))
                except Exception:  # noqa: BLE001 - whatever the client raises, the link is dropped for this pass
                    continue
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return links.select("id", "url").mapInArrow(run, LIVE)


def requestable(links: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Links that may be requested at all, judged before any request: ending, and address if ``hosts`` or the URL gives one.

    Without ``hosts``, a named host is left to the fetcher, which resolves it.
    """
    kept = crawlable(links)
    if hosts is not None:
        return public_only(kept, hosts)
    literal = N.host_ip(H.hostname(F.col("url")))
    return kept.where(H.scheme(F.col("url")).isin("http", "https") & (literal.isNull() | ~N.blocked(literal)))


def crawlable(links: DataFrame) -> DataFrame:
    return links.where(H.crawlable(F.col("url")))


def public_only(links: DataFrame, hosts: DataFrame | None = None, networks: DataFrame | None = None, **options) -> DataFrame:
    """Links whose host has a public address; an unknown one counts as private.

    ``hosts`` (host, ip) stands for DNS.  Addresses in one of ``networks`` (net), a
    list of any size, are refused as well.
    """
    if networks is not None:
        ip = N.host_ip(F.col("_host"), F.col("_ip")) if hosts is not None else N.host_ip(F.col("_host"))
        named = links.withColumn("_host", H.hostname(F.col("url")))
        if hosts is not None:
            known = hosts.groupBy(F.col("host").alias("_host")).agg(F.min("ip").alias("_ip"))
            named = named.join(known, "_host", "left")
        met = match(named.withColumn("_at", ip), networks, "_at").where("net is null")
        links = met.select(*links.columns)
    named = links.withColumn("_host", H.hostname(F.col("url")))
    if hosts is None:
        return named.where(~N.blocked(N.host_ip(F.col("_host")), **options)).drop("_host")
    known = hosts.groupBy("host").agg(F.min("ip").alias("_ip"))
    met = named.join(known, F.col("_host") == F.col("host"), "left")
    return met.where(~N.blocked(N.host_ip(F.col("_host"), F.col("_ip")), **options)).drop("_host", "host", "_ip")


def successful_html(pages: DataFrame) -> DataFrame:
    """Status 200 to 299 and a content type that names html."""
    return pages.where(F.col("status").between(200, 299) & F.col("content_type").contains("html"))


def with_base(pages: DataFrame) -> DataFrame:
    """Adds ``base``: the URL that links are relative to."""
    named = pages.select("*", F.explode(F.array(H.base_href(F.col("html")))).alias("_href"))
    return H.with_resolved(named, "url", "_href", "_base").select(*pages.columns, F.coalesce("_base", "url").alias("base"))


def page_links(pages: DataFrame, hosts: DataFrame | None = None, key: str = "url") -> DataFrame:
    """(key, pos, link, nofollow): each page's distinct links, by first occurrence.

    Kept are http(s) links to the same host, or to public hosts, that can hold
    HTML.  A host's address comes from ``hosts`` (host, ip); without that table,
    named hosts count as public and literal addresses are judged, those that
    cannot be read as private.
    """
    spread = with_base(pages).select(F.col(key), "base", F.posexplode(H.anchors(F.col("html"))).alias("pos", "a"))
    resolved = H.with_resolved(spread.select(key, "base", "pos", "a.nofollow", "a.target"), "base", "target", "found")
    found = resolved.where(F.col("found").isNotNull() & H.scheme(F.col("found")).isin("http", "https"))
    found = found.withColumn("link", H.without_fragment(F.col("found"))).withColumn("_host", H.hostname(F.col("found"))).withColumn("_own", H.hostname(F.col("base")))
    if hosts is None:
        literal = N.host_ip(F.col("_host"))
        found = found.where((F.col("_host") == F.col("_own")) | literal.isNull() | ~N.blocked(literal))
    else:
        known = hosts.groupBy("host").agg(F.min("ip").alias("_ip"))
        found = found.join(known, F.col("_host") == F.col("host"), "left").where((F.col("_host") == F.col("_own")) | ~N.blocked(N.host_ip(F.col("_host"), F.col("_ip"))))
    found = found.where(H.crawlable(F.col("link")))
    first = found.groupBy(key, "link").agg(F.min("pos").alias("pos"), F.min_by("nofollow", "pos").alias("nofollow"))
    return first.select(key, "pos", "link", "nofollow")


def crawl_pages(links: DataFrame, pages: DataFrame, hosts: DataFrame | None = None, fetch: str | None = None) -> DataFrame:
    """One crawled row for each fetched link: id, url, title, text, links, no_follow_links.

    With ``fetch`` (see :func:`fetched`) a URL that was fetched several times has a row
    for each, with the links of that page alone.
    """
    got = fetched(crawlable(links), pages, fetch)
    key = fetch or "id"
    if "status" in pages.columns:
        got = successful_html(got)
    if hosts is not None:
        got = public_only(got, hosts)
    spread = page_links(got.select(key, "url", "html"), hosts, key=key)
    listed = spread.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "link", "nofollow"))).alias("found"))
    text = got.select("id", *([fetch] if fetch else []), "url", H.title(F.col("html")).alias("title"), H.text(F.col("html")).alias("text"))
    pick = lambda flag: F.coalesce(F.transform(F.filter("found", lambda x: x["nofollow"] == flag), lambda x: x["link"]), F.expr("cast(array() as array<string>)"))
    return text.join(listed, key, "left").select("id", "url", "title", "text", pick(False).alias("links"), pick(True).alias("no_follow_links"))


def broadcast_union(df: DataFrame, branches: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Every row to every branch, outputs as one bag."""
    outs = [branch(df) for branch in branches]
    if not outs:
        raise StrandlineError("at least one branch is needed")
    return reduce(DataFrame.unionByName, outs)
