"""Registered queries: one for each operator, with the SQL that DuckDB is asked instead.

Tables of the test data stand in for the stored ones: ``pages`` are links (their
ids from the URL, a retrieval time from the page number, every seventh never
retrieved), ``lineitem`` gives a supplier/part graph, ``documents`` are indexed
texts.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import ids
from ..functions import network as N
from ..functions import text as X
from ..operators import crawl, graphstore, index, networks, search
from ..operators.postings import PostingsIndex
from ..operators.segments import SegmentedIndex
from ..schemas import EDGE, LAST_ID, LINK, NEVER, NIL_ID, never
from ..shared import file_versions, shared_dir
from ..ship import ship
from ..sources.stores import ParquetStore, open_index
from . import pagerank as PR
from . import shortest_path as SP
from .mail import MailProgram
from .pregel import Pregel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE_S = 1704067200  # 2024-01-01
NOW = "2024-01-12 00:00:00"
NOW_S = BASE_S + 11 * 86400


def query(sql: str | None = None):
    """Register a query under its name, with its oracle if SQL can express it."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(seconds: int):
    return F.timestamp_seconds(F.lit(seconds))


def seconds(column: str):
    return F.unix_timestamp(column)


# ---- tables, in Spark and in SQL


def uuid_sql(x: str) -> str:
    return f"concat_ws('-', substr(md5({x}), 1, 8), substr(md5({x}), 9, 4), substr(md5({x}), 13, 4), substr(md5({x}), 17, 4), substr(md5({x}), 21, 12))"


def links_of(spark: SparkSession, d: str) -> DataFrame:
    when = F.when(F.col("page_id") % 7 == 0, never()).otherwise(F.timestamp_seconds(F.lit(BASE_S) + F.col("page_id") * 3600))
    return table(spark, d, "pages").select(ids.link_id(F.col("url")).alias("id"), "url", when.alias("retrieved_at"), "page_id")


LINKS = f"links AS (SELECT {uuid_sql('url')} AS id, url, page_id, CASE WHEN page_id % 7 = 0 THEN {NEVER} ELSE {BASE_S} + page_id * 3600 END AS retrieved_s FROM pages)"


def _site(kind: str, column: str):
    return F.concat(F.lit(f"http://{kind}"), F.col(column).cast("string"), F.lit(".example.com/"))


def site_links(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers, and parts with an even key, as links."""
    s = table(spark, d, "supplier").select(_site("s", "s_suppkey").alias("url"))
    p = table(spark, d, "part").where("p_partkey % 2 = 0").select(_site("p", "p_partkey").alias("url"))
    return s.union(p).select(ids.link_id(F.col("url")).alias("id"), "url", never().alias("retrieved_at"))


def site_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from suppliers to the parts of their line items, updated at the last shipment."""
    # grouped by the keys of the line items: the ids made of them are five times as long
    ends = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max(F.col("l_shipdate").cast("timestamp")).alias("updated_at"))
    edges = ends.select(ids.link_id(_site("s", "l_suppkey")).alias("src"), ids.link_id(_site("p", "l_partkey")).alias("dst"), "updated_at")
    return edges.select(ids.edge_id(F.col("src"), F.col("dst")).alias("id"), "src", "dst", "updated_at")


SITES = f"""sites AS (SELECT {uuid_sql('url')} AS id, url FROM (
  SELECT 'http://s' || s_suppkey || '.example.com/' AS url FROM supplier UNION ALL
  SELECT 'http://p' || p_partkey || '.example.com/' FROM part WHERE p_partkey % 2 = 0)),
ends AS (SELECT 'http://s' || l_suppkey || '.example.com/' AS s, 'http://p' || l_partkey || '.example.com/' AS p, max(epoch(l_shipdate))::BIGINT AS updated_s FROM lineitem GROUP BY ALL),
site_edges AS (SELECT src, dst, {uuid_sql("src || '>' || dst")} AS id, updated_s FROM (SELECT {uuid_sql('s')} AS src, {uuid_sql('p')} AS dst, updated_s FROM ends))"""


def graph_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The supplier/part graph of all line items: large orders point to the part, small ones back."""
    lines = table(spark, d, "lineitem")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    # grouped by the keys of the line items, which take less memory than names made of them
    least = lambda chosen: lines.where(chosen).groupBy("l_suppkey", "l_partkey").agg(F.min("l_linenumber").cast("long").alias("cost"))
    there = least("l_quantity >= 25").select(s.alias("src"), p.alias("dst"), "cost")
    edges = there.union(least("l_quantity < 25").select(p.alias("src"), s.alias("dst"), "cost"))
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct(), edges


def numbered_graph_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same graph without costs; its ids are numbers, twice the key, and one more for parts."""
    lines = table(spark, d, "lineitem").where("l_quantity is not null")
    s, p, there = F.col("l_suppkey").cast("long") * 2, F.col("l_partkey").cast("long") * 2 + 1, F.col("l_quantity") >= 25
    edges = lines.select(F.when(there, s).otherwise(p).alias("src"), F.when(there, p).otherwise(s).alias("dst")).distinct()
    # the ends of all line items: their edges need not be made twice
    return lines.select(F.explode(F.array(s, p)).alias("id")).distinct(), edges


def graph_name(number: Column) -> Column:
    return F.concat(F.when(number % 2 == 0, F.lit("s")).otherwise(F.lit("p")), F.shiftright(number, 1).cast("string"))


GRAPH = """edges AS MATERIALIZED (SELECT src, dst, min(l_linenumber)::BIGINT AS cost FROM (
  SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_linenumber FROM lineitem WHERE l_quantity >= 25 UNION ALL
  SELECT 'p' || l_partkey, 's' || l_suppkey, l_linenumber FROM lineitem WHERE l_quantity < 25) GROUP BY src, dst),
vertices AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"""


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    name = F.col("doc_id").cast("string")
    return doc.select(
        ids.uuid_of(F.concat(F.lit("doc:"), name)).alias("link_id"),
        F.concat(F.lit("http://docs.example.com/"), name).alias("url"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat_ws(" ", "source", "lang", name)).alias("title"),
        F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(BASE_S) + F.col("doc_id")).alias("indexed_at"),
        ((F.col("doc_id") % 97) / 97.0).alias("pagerank"),
        "doc_id",
    )


DOCS = f"""docs AS (SELECT doc_id, {uuid_sql("'doc:' || doc_id")} AS link_id, 'http://docs.example.com/' || doc_id AS url,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat_ws(' ', source, lang, doc_id) END AS title, text AS content,
  {BASE_S} + doc_id AS indexed_s, (doc_id % 97) / 97.0::DOUBLE AS pagerank FROM documents)"""
TOKEN = r"[\p{L}\p{N}_]+"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN}')"


# ---- links and edges

LO, HI = "20000000-0000-0000-0000-000000000000", "c0000000-0000-0000-0000-000000000000"
CUT_S = BASE_S + 100 * 3600
EDGE_CUT_S = 820454400  # 1996-01-01


@query(f"WITH {LINKS} SELECT id, url FROM links")
def link_ids(spark, d):
    return links_of(spark, d).select("id", "url")


@query(f"WITH {LINKS} SELECT id, url, retrieved_s FROM links WHERE id >= '{LO}' AND id < '{HI}' AND retrieved_s < {CUT_S}")
def links_scan(spark, d):
    return graphstore.links_scan(links_of(spark, d), LO, HI, at(CUT_S)).select("id", "url", seconds("retrieved_at").alias("retrieved_s"))


@query(f"WITH {SITES} SELECT id, src, dst, updated_s FROM site_edges WHERE src >= '{LO}' AND src < '{HI}' AND updated_s < {EDGE_CUT_S}")
def edges_scan(spark, d):
    return graphstore.edges_scan(site_edges(spark, d), LO, HI, at(EDGE_CUT_S)).select("id", "src", "dst", seconds("updated_at").alias("updated_s"))


@query(f"WITH {LINKS} SELECT id, url, retrieved_s FROM links WHERE retrieved_s < {NOW_S - 7 * 86400}")
def stale_links(spark, d):
    return graphstore.stale_links(links_of(spark, d), at(NOW_S)).select("id", "url", seconds("retrieved_at").alias("retrieved_s"))


@query(f"WITH {LINKS} SELECT id, url, retrieved_s FROM links WHERE id = (SELECT min(id) FROM links WHERE page_id = 3)")
def find_link(spark, d):
    links = links_of(spark, d)
    wanted = links.where("page_id = 3").agg(F.min("id")).first()[0]
    return graphstore.find_link(links, wanted).select("id", "url", seconds("retrieved_at").alias("retrieved_s"))


@query(
    f"""WITH {LINKS}, incoming AS (SELECT url, retrieved_s + 36000 AS retrieved_s FROM links WHERE page_id % 2 = 0 AND page_id % 7 <> 0
      UNION ALL SELECT url, {BASE_S - 5} FROM links WHERE page_id % 3 = 0 UNION ALL SELECT url || 'new', {NEVER} FROM links WHERE page_id % 5 = 0)
    SELECT {uuid_sql('url')} AS id, url, max(retrieved_s)::BIGINT AS retrieved_s FROM (SELECT url, retrieved_s FROM links UNION ALL SELECT * FROM incoming) GROUP BY url"""
)
def upsert_links(spark, d):
    links = links_of(spark, d)
    later = links.where("page_id % 2 = 0 and page_id % 7 <> 0").select("url", F.timestamp_seconds(seconds("retrieved_at") + 36000).alias("retrieved_at"))
    early = links.where("page_id % 3 = 0").select("url", at(BASE_S - 5).alias("retrieved_at"))
    new = links.where("page_id % 5 = 0").select(F.concat("url", F.lit("new")).alias("url"), F.lit(None).cast("timestamp").alias("retrieved_at"))
    return graphstore.upsert_links(links, later.union(early).union(new)).select("id", "url", seconds("retrieved_at").alias("retrieved_s"))


@query(
    f"""WITH {LINKS} SELECT {uuid_sql('url')} AS id, url, max(retrieved_s)::BIGINT AS retrieved_s FROM (
      SELECT url, retrieved_s + k * 3600 AS retrieved_s FROM links, (SELECT unnest(range(5)) AS k) WHERE page_id % 5 >= k
      UNION ALL SELECT url || 'new', {NEVER} FROM links) GROUP BY url"""
)
def delta_upserts(spark, d):
    """Five commits of changed and new links to a stored table, with compactions between them."""
    store = ParquetStore(spark, {"links": LINK}, fresh_store(spark, "parquet").split(":", 1)[1], ranges=4, compact_at=3)
    links = links_of(spark, d)
    for k in range(5):
        own = links.where(F.col("page_id") % 5 >= k).select("url", F.timestamp_seconds(seconds("retrieved_at") + k * 3600).alias("retrieved_at"))
        new = links.where(F.col("page_id") % 5 == k).select(F.concat("url", F.lit("new")).alias("url"), never().alias("retrieved_at"))
        store.upsert_links(own.union(new))
    return store.read("links").select("id", "url", seconds("retrieved_at").alias("retrieved_s"))


@query(
    f"""WITH {SITES}, kept AS (SELECT src, dst, CASE WHEN l THEN {BASE_S + 86400} ELSE updated_s END AS updated_s, cut FROM (
      SELECT *, substr(dst, 1, 1) < '8' AS l, substr(src, 1, 1) < '4' AS cut FROM site_edges))
    SELECT src, dst, updated_s FROM kept WHERE NOT cut OR updated_s >= {BASE_S}"""
)
def delta_edges(spark, d):
    """Edges committed, some of them touched in a second commit that also cuts the older edges of some sources."""
    store = ParquetStore(spark, {"edges": EDGE}, fresh_store(spark, "parquet").split(":", 1)[1], ranges=4)
    edges = site_edges(spark, d)
    store.write("edges", edges)
    cutoffs = edges.where(F.substring("src", 1, 1) < "4").select("src", at(BASE_S).alias("updated_before")).distinct()
    store.upsert_edges(edges.where(F.substring("dst", 1, 1) < "8"), at(BASE_S + 86400), cutoffs)
    return store.read("edges").select("src", "dst", seconds("updated_at").alias("updated_s"))


@query(f"WITH {SITES} SELECT id, src, dst FROM site_edges WHERE src IN (SELECT id FROM sites) AND dst IN (SELECT id FROM sites)")
def edge_fk_semi(spark, d):
    return graphstore.known_edges(site_edges(spark, d), site_links(spark, d)).select("id", "src", "dst")


@query(f"WITH {SITES} SELECT id, src, dst FROM site_edges WHERE src NOT IN (SELECT id FROM sites) OR dst NOT IN (SELECT id FROM sites)")
def edge_fk_anti(spark, d):
    return graphstore.unknown_edges(site_edges(spark, d), site_links(spark, d)).select("id", "src", "dst")


@query(
    f"""WITH {SITES}, known AS (SELECT * FROM site_edges WHERE src IN (SELECT id FROM sites) AND dst IN (SELECT id FROM sites)),
    old AS (SELECT * FROM known WHERE updated_s < {EDGE_CUT_S})
    SELECT id, src, dst, max(updated_s)::BIGINT AS updated_s FROM (SELECT * FROM old UNION ALL SELECT src, dst, id, {NOW_S} FROM known WHERE updated_s < {EDGE_CUT_S + 86400 * 200}) GROUP BY ALL"""
)
def upsert_edges(spark, d):
    links, edges = site_links(spark, d), site_edges(spark, d)
    old = graphstore.known_edges(edges, links).where(F.col("updated_at") < at(EDGE_CUT_S))
    new = edges.where(F.col("updated_at") < at(EDGE_CUT_S + 86400 * 200)).select("src", "dst")
    return graphstore.upsert_edges(old, new, links, at(NOW_S)).select("id", "src", "dst", seconds("updated_at").alias("updated_s"))


@query(f"WITH {SITES} SELECT id, src, dst, updated_s FROM site_edges WHERE NOT (src = {uuid_sql(repr('http://s1.example.com/'))} AND updated_s < {EDGE_CUT_S})")
def remove_stale_edges(spark, d):
    src = spark.range(1).select(ids.link_id(F.lit("http://s1.example.com/"))).first()[0]
    return graphstore.remove_stale_edges(site_edges(spark, d), src, at(EDGE_CUT_S)).select("id", "src", "dst", seconds("updated_at").alias("updated_s"))


@query(f"WITH {LINKS} SELECT id, CASE WHEN id >= '{LAST_ID}' THEN NULL ELSE (('0x' || substr(id, 1, 2))::INT // 16) END AS partition FROM links")
def partition_links(spark, d):
    return graphstore.partition_links(links_of(spark, d), 16).select("id", "partition")


@query(
    """SELECT i::INT AS i, CASE WHEN i = 0 THEN '0' ELSE lower(to_hex(i * 4)) END || '0000000-0000-0000-0000-000000000000' AS lo,
    CASE WHEN i = 3 THEN 'ffffffff-ffff-ffff-ffff-ffffffffffff' ELSE lower(to_hex((i + 1) * 4)) || '0000000-0000-0000-0000-000000000000' END AS hi FROM range(4) t(i)"""
)
def partition_bounds(spark, d):
    rows = [(i, *ids.partition_extent(i, 4)) for i in range(4)]
    return spark.createDataFrame(rows, "i int, lo string, hi string")


# ---- pages


@query(r"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '(?i)\.(?:jpg|jpeg|png|gif|ico|css|js)$')")
def filter_crawlable(spark, d):
    return crawl.crawlable(table(spark, d, "pages")).select("page_id", "url")


@query(
    r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1), ':[0-9]*$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(url, '#.*$', '') AS bare FROM pages"""
)
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", H.scheme(u).alias("scheme"), H.hostname(u).alias("host"), H.url_path(u).alias("path"), H.without_fragment(u).alias("bare"))


BASED = """SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '<head><base target="x" href="http://base' || page_id || '.example.com/a/"></head>'
  WHEN page_id % 3 = 1 THEN '<BASE HREF = "https://b.example.org/dir">' ELSE '' END || html AS html FROM pages"""


@query(
    rf"""SELECT page_id, CASE WHEN href IS NULL OR href = '' THEN url WHEN ends_with(href, '/') THEN href ELSE href || '/' END AS base
    FROM (SELECT page_id, url, regexp_extract(html, '(?i)<base.*?href\s*?=\s*?"(.*?)\s*?"', 1) AS href FROM ({BASED}))"""
)
def extract_base(spark, d):
    n = F.col("page_id")
    head = F.when(n % 3 == 0, F.concat(F.lit('<head><base target="x" href="http://base'), n.cast("string"), F.lit('.example.com/a/"></head>'))).when(n % 3 == 1, F.lit('<BASE HREF = "https://b.example.org/dir">')).otherwise("")
    pages = table(spark, d, "pages").withColumn("html", F.concat(head, F.col("html")))
    return crawl.with_base(pages).select("page_id", "base")


ENCODED = "target"
for _c, _e in (("%2F", "/"), ("%2C", ","), ("%3A", ":"), ("%40", "@"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3B", ";"), ("%3D", "=")):
    ENCODED = f"replace({ENCODED if ENCODED != 'target' else 'url_encode(target)'}, '{_c}', '{_e}')"
_WHOLE = rf"""CASE WHEN regexp_full_match(target, '[A-Za-z0-9\-._~!$&''()*+,;=:@/]*') THEN target ELSE {ENCODED} END"""
FOUND = rf"""anchors AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a.*?href\s*?=\s*?"\s*?(.*?)\s*?".*?>', 0)) AS tag,
    generate_subscripts(regexp_extract_all(html, '(?i)<a.*?href\s*?=\s*?"\s*?(.*?)\s*?".*?>', 0), 1) - 1 AS pos FROM pages),
targets AS (SELECT *, regexp_replace(regexp_extract(tag, '(?i)<a.*?href\s*?=\s*?"\s*?(.*?)\s*?".*?>', 1), '#.*$', '') AS target FROM anchors),
found AS (SELECT page_id, pos, regexp_matches(tag, '(?i)rel\s*?=\s*?"?nofollow"?') AS nofollow,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {_WHOLE} AS link
    FROM targets WHERE starts_with(target, '/') AND NOT regexp_matches(replace(target, '%25', ''), '%'))"""


@query(
    rf"""WITH {FOUND} SELECT page_id, min(pos)::INT AS pos, link, arg_min(nofollow, pos) AS nofollow FROM found
    WHERE NOT regexp_matches(link, '(?i)\.(?:jpg|jpeg|png|gif|ico|css|js)$') GROUP BY page_id, link"""
)
def extract_links(spark, d):
    return crawl.page_links(table(spark, d, "pages"), key="page_id").select("page_id", "pos", "link", "nofollow")


@query(
    r"""WITH parts AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+') AS site, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
    folders AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]+$', '') END AS folder FROM parts)
    SELECT page_id, site || CASE page_id % 5 WHEN 0 THEN folder || 'x' || page_id WHEN 1 THEN regexp_replace(folder, '[^/]+/$', '') || 'y/' || page_id || '/'
      WHEN 2 THEN folder || 'w?p=' || page_id WHEN 3 THEN '/top' ELSE path || '?q=' || page_id END AS resolved FROM folders"""
)
def resolve_relative(spark, d):
    """Relative targets made from pages, with dot segments, against the pages' addresses."""
    n = F.col("page_id").cast("string")
    kinds = [F.concat(F.lit("./x"), n), F.concat(F.lit("../y/"), n, F.lit("/.")), F.concat(F.lit("z/../w?p="), n), F.lit("../" * 20 + "top"), F.concat(F.lit("?q="), n)]
    target = F.element_at(F.array(*kinds), (F.col("page_id") % 5 + 1).cast("int"))
    return H.with_resolved(table(spark, d, "pages").select("page_id", "url", target.alias("target")), "url", "target", "resolved").select("page_id", "resolved")


@query(rf"WITH {FOUND} SELECT page_id, pos::INT AS pos, link AS resolved FROM found")
def resolve_urls(spark, d):
    spread = table(spark, d, "pages").select("page_id", "url", F.posexplode(H.anchors(F.col("html"))).alias("pos", "a"))
    found = H.with_resolved(spread.select("page_id", "url", "pos", "a.target"), "url", "target", "resolved")
    return found.where("resolved is not null").select("page_id", "pos", H.without_fragment(F.col("resolved")).alias("resolved"))


SILENT_SQL = r"regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g')"
for _n in H.SILENT:
    SILENT_SQL = rf"regexp_replace({SILENT_SQL}, '(?is)<{_n}\b[^>]*>.*?(?:</{_n}\s*>|\z)', '', 'g')"
SILENT_SQL = rf"regexp_replace({SILENT_SQL}, '(?s)<[/!?a-zA-Z][^>]*(?:>|\z)', '', 'g')"


def plain_sql(x: str) -> str:
    out = rf"replace(regexp_replace({x}, '[\t\n\f\r ]+', ' ', 'g'), '&amp;', '&' || chr(1))"
    for reference, char in H.ENTITIES[:-1]:
        out = f"replace({out}, '{reference}', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace(replace({out}, '&' || chr(1), '&'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(f"SELECT page_id, {plain_sql(SILENT_SQL)} AS text FROM pages")
def extract_text(spark, d):
    return table(spark, d, "pages").select("page_id", H.text(F.col("html")).alias("text"))


@query(f"SELECT page_id, {plain_sql(SILENT_SQL)} AS title FROM (SELECT page_id, regexp_extract(html, '(?i)<title.*?>(.*?)</title>', 1) AS html FROM pages)")
def extract_title(spark, d):
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"))


FETCHED = [("http://a.example.com/", 200, "text/html"), ("http://b.example.com/", 299, "application/xhtml+xml"), ("http://c.example.com/", 300, "text/html"), ("http://d.example.com/", 199, "text/html"), ("http://e.example.com/", 200, "application/json"), ("http://f.example.com/", 200, "TEXT/HTML")]


@query("SELECT url, status::INT AS status, content_type FROM (VALUES " + ", ".join(map(str, FETCHED)) + ") t(url, status, content_type) WHERE status BETWEEN 200 AND 299 AND contains(content_type, 'html')")
def fetch_filters(spark, d):
    return crawl.successful_html(spark.createDataFrame(FETCHED, "url string, status int, content_type string"))


ADDRESSES = ["127.255.3.9", "10.200.7.1", "192.168.44.5", "192.169.0.1", "172.31.255.254", "172.32.0.1", "169.254.0.9", "9.9.9.9", "0.1.2.3", "255.255.255.255", "255.255.255.254", "11.0.0.1", "no address"]
ADDRESSES_6 = {"::1": False, "::2": True, "fe80::a:b": False, "febf::1": False, "fec0::1": True, "fd12:3456::7": False, "2606:4700::6810:84e5": True, "::ffff:10.9.8.7": False, "::ffff:9.9.9.9": True, "1:2:3": False, "fe80::1%eth0": False}
_IP = "(split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT)"


@query(
    f"""SELECT ip FROM (VALUES {', '.join(f"('{a}')" for a in ADDRESSES)}) t(ip) WHERE CASE WHEN regexp_full_match(ip, '[0-9.]+') THEN NOT (
      {_IP} // 16777216 IN (127, 10, 0) OR {_IP} // 1048576 = 172 * 16 + 1 OR {_IP} // 65536 IN (192 * 256 + 168, 169 * 256 + 254) OR {_IP} = 4294967295) ELSE false END
      UNION ALL SELECT ip FROM (VALUES {', '.join(f"('{a}', {p})" for a, p in ADDRESSES_6.items())}) t(ip, public) WHERE public"""
)
def filter_private(spark, d):
    return spark.createDataFrame([(a,) for a in [*ADDRESSES, *ADDRESSES_6]], "ip string").where(~N.blocked(F.col("ip")))


def _address_sql(x: str) -> str:
    return f"concat_ws('.', ({x}) // 16777216, ({x}) // 65536 % 256, ({x}) // 256 % 256, ({x}) % 256)"


@query(
    f"""WITH nets AS (SELECT DISTINCT {_address_sql('lo')} || '/' || len AS net, len, lo, lo + (1::BIGINT << (32 - len)) - 1 AS hi FROM (
      SELECT len, x // (1::BIGINT << (32 - len)) * (1::BIGINT << (32 - len)) AS lo FROM (SELECT (o_orderkey * 40503) % 4294967296 AS x, 10 + o_orderkey % 23 AS len FROM orders))),
    places AS (SELECT event_id, (user_id * 2654435 + event_id * 40503 * 7) % 4294967296 AS x FROM events),
    met AS (SELECT event_id, arg_max(net, len) AS net FROM places JOIN nets ON x BETWEEN lo AND hi GROUP BY event_id)
    SELECT event_id, {_address_sql('x')} AS ip, net FROM places LEFT JOIN met USING (event_id)"""
)
def match_networks(spark, d):
    """Addresses made from events against a network for each order."""
    x = F.pmod(F.col("o_orderkey") * 40503, F.lit(1 << 32))
    length = (F.lit(10) + F.col("o_orderkey") % 23).cast("int")
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - length)
    dotted = lambda lo: F.concat_ws(".", *[F.pmod(F.shiftright(lo, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    lo = x - F.pmod(x, size)
    nets = table(spark, d, "orders").select(F.concat(dotted(lo), F.lit("/"), length.cast("string")).alias("net"))
    at_ = F.pmod(F.col("user_id") * 2654435 + F.col("event_id") * 40503 * 7, F.lit(1 << 32))
    return networks.match(table(spark, d, "events").select("event_id", dotted(at_).alias("ip")), nets)


SUBMITTED = """(SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'ftp://x.example.com/' || page_id WHEN 2 THEN 'https://new.example.com/' || page_id || '#top' ELSE 'nonsense' END AS site FROM pages)"""


@query(
    f"""WITH {LINKS}, new AS (SELECT regexp_replace(site, '#.*$', '') AS url FROM {SUBMITTED} WHERE regexp_matches(site, '^(?i)https?:'))
    SELECT {uuid_sql('url')} AS id, url, max(retrieved_s)::BIGINT AS retrieved_s FROM (SELECT url, retrieved_s FROM links UNION ALL SELECT url, {NEVER} FROM new) GROUP BY url"""
)
def submit_links(spark, d):
    n = F.col("page_id")
    site = F.when(n % 4 == 0, F.col("url")).when(n % 4 == 1, F.concat(F.lit("ftp://x.example.com/"), n.cast("string"))).when(n % 4 == 2, F.concat(F.lit("https://new.example.com/"), n.cast("string"), F.lit("#top"))).otherwise("nonsense")
    sent = table(spark, d, "pages").select(site.alias("url")).where(H.scheme(F.col("url")).isin("http", "https")).select(H.without_fragment(F.col("url")).alias("url"))
    return graphstore.upsert_links(links_of(spark, d), sent).select("id", "url", seconds("retrieved_at").alias("retrieved_s"))


CRAWLED = rf"""WITH {LINKS}, {FOUND},
    own AS (SELECT page_id, link, min(pos) AS pos, arg_min(nofollow, pos) AS nofollow FROM found WHERE NOT regexp_matches(link, '(?i)\.(?:jpg|jpeg|png|gif|ico|css|js)$') GROUP BY ALL),
    listed AS (SELECT page_id, coalesce(list(link ORDER BY pos) FILTER (NOT nofollow), []) AS links, count(*) FILTER (nofollow) AS n_no_follow FROM own GROUP BY page_id),
    crawled AS (SELECT l.id, l.url, l.page_id, coalesce(links, []) AS links, coalesce(n_no_follow, 0) AS n_no_follow FROM links l LEFT JOIN listed USING (page_id)
      WHERE NOT regexp_matches(l.url, '(?i)\.(?:jpg|jpeg|png|gif|ico|css|js)$'))"""


def crawled_of(spark, d):
    # a URL may stand in several rows of the table, each a fetch of its own
    return crawl.crawl_pages(links_of(spark, d), table(spark, d, "pages").select("url", "page_id", "html"), fetch="page_id")


@query(
    f"""{CRAWLED} SELECT c.id, c.url, array_to_string(links, ' ') AS links, len(links)::INT AS n_links, n_no_follow::INT AS n_no_follow, t.title, p.text FROM crawled c
    JOIN ({ORACLES['extract_title']}) t USING (page_id) JOIN ({ORACLES['extract_text']}) p USING (page_id)"""
)
def crawl_pages(spark, d):
    return crawled_of(spark, d).select("id", "url", F.array_join("links", " ").alias("links"), F.size("links").alias("n_links"), F.size("no_follow_links").alias("n_no_follow"), "title", "text")


@query(r"SELECT count(*) AS pages FROM pages WHERE NOT regexp_matches(url, '(?i)\.(?:jpg|jpeg|png|gif|ico|css|js)$')")
def crawl_count(spark, d):
    got = crawl.fetched(crawl.crawlable(links_of(spark, d)), table(spark, d, "pages").select("url", "page_id"), fetch="page_id")
    return got.agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT page_id, 'url' AS branch, length(url)::INT AS n FROM pages UNION ALL SELECT page_id, 'html', length(html)::INT FROM pages")
def broadcast_union(spark, d):
    pages = table(spark, d, "pages")
    return crawl.broadcast_union(pages, [lambda p, c=c: p.select("page_id", F.lit(c).alias("branch"), F.char_length(c).alias("n")) for c in ("url", "html")])


@query(
    f"""{CRAWLED}, pairs AS (SELECT {uuid_sql('url')} AS src, {uuid_sql('link')} AS dst, {NOW_S} AS updated_s FROM (SELECT DISTINCT url, unnest(links) AS link FROM crawled)),
    old AS (SELECT src, {uuid_sql("'http://old.example.com/' || page_id")} AS dst, {BASE_S} AS updated_s FROM (SELECT {uuid_sql('url')} AS src, page_id FROM pages WHERE page_id % 2 = 0)
      UNION ALL SELECT {uuid_sql("'http://else.example.com/' || page_id")}, {uuid_sql('url')}, {BASE_S} FROM pages)
    SELECT src, dst, max(updated_s)::BIGINT AS updated_s FROM (SELECT * FROM pairs UNION ALL SELECT * FROM old WHERE src NOT IN (SELECT {uuid_sql('url')} FROM crawled)) GROUP BY ALL"""
)
def graph_update(spark, d):
    pages = table(spark, d, "pages")
    gone = pages.where("page_id % 2 = 0").select(ids.link_id(F.col("url")).alias("src"), ids.link_id(F.concat(F.lit("http://old.example.com/"), F.col("page_id").cast("string"))).alias("dst"))
    kept = pages.select(ids.link_id(F.concat(F.lit("http://else.example.com/"), F.col("page_id").cast("string"))).alias("src"), ids.link_id(F.col("url")).alias("dst"))
    old = gone.union(kept).select(ids.edge_id(F.col("src"), F.col("dst")).alias("id"), "src", "dst", at(BASE_S).alias("updated_at"))
    _, edges = graphstore.graph_update(links_of(spark, d).drop("page_id"), old, crawled_of(spark, d), at(NOW_S))
    return edges.select("src", "dst", seconds("updated_at").alias("updated_s"))


# ---- documents and search


@query(f"SELECT doc_id, len({tokens_sql('text')})::INT AS n_tokens, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents")
def tokenize(spark, d):
    t = X.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


POSTINGS = f"""terms AS (SELECT link_id, field, len(ts) AS length, unnest(ts) AS term FROM (
  SELECT link_id, 'title' AS field, {tokens_sql('title')} AS ts FROM docs UNION ALL SELECT link_id, 'content', {tokens_sql('content')} FROM docs)),
postings AS (SELECT field, term, link_id, count(*) AS tf, max(length) AS length FROM terms GROUP BY ALL)"""


@query(f"WITH {DOCS}, {POSTINGS} SELECT field, term, link_id, tf, length FROM postings")
def build_postings(spark, d):
    return index.build_postings(documents_of(spark, d)).select("field", "term", "link_id", "tf", "length")


@query(f"WITH {DOCS}, {POSTINGS} SELECT field, term, count(*) AS df FROM postings GROUP BY ALL")
def term_df(spark, d):
    return index.term_df(index.build_postings(documents_of(spark, d)))


TERMS = ["que", "schaft", "the", "src3"]
MATCH = "Que schaft THE src3"


def bm25_sql(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{POSTINGS}, sizes AS (SELECT field, sum(n) / count(*) AS average, count(*) AS docs FROM (
      SELECT 'title' AS field, len({tokens_sql('title')}) AS n FROM docs UNION ALL SELECT 'content', len({tokens_sql('content')}) FROM docs) GROUP BY field),
    dfs AS (SELECT field, term, count(*) AS df FROM postings WHERE term IN ({listed}) GROUP BY ALL),
    scored AS (SELECT link_id, max(score) AS score FROM (SELECT link_id, field,
      sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {index.K1 + 1} / (tf + {index.K1} * ({1 - index.B} + {index.B} * length / average))) AS score
      FROM postings JOIN dfs USING (field, term) JOIN sizes USING (field) GROUP BY link_id, field) GROUP BY link_id)"""


def stored_index(spark, d) -> PostingsIndex:
    """The documents' postings, written below the session's shared folder."""
    return PostingsIndex(spark, f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}").write(documents_of(spark, d))


_INDEXES: dict[tuple, SegmentedIndex] = {}


def fresh_store(spark, kind: str) -> str:
    return f"{kind}:{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def index_of(spark, d) -> SegmentedIndex:
    """The index of a folder's documents, made at the first search in the application and again when the files change."""
    key = spark.sparkContext.applicationId, d, file_versions(table(spark, d, "documents"))
    if key not in _INDEXES:
        store = open_index(spark, fresh_store(spark, "index"))
        store.write("documents", documents_of(spark, d))
        _INDEXES[key] = store.search_index()
    return _INDEXES[key]


@query(f"WITH {DOCS} SELECT count(*) AS docs, sum(len({tokens_sql('title')}))::BIGINT AS title_terms, sum(len({tokens_sql('content')}))::BIGINT AS content_terms FROM docs")
def index_sizes(spark, d):
    """What the index of the documents holds; the first query to ask for it makes it."""
    return spark.createDataFrame([index_of(spark, d).entry.sizes()], "docs long, title_terms long, content_terms long")


@query(f"WITH {DOCS}, {bm25_sql(TERMS)} SELECT link_id, round(score, 6) AS score FROM scored")
def bm25_scores(spark, d):
    return index_of(spark, d).scores(TERMS).select("link_id", F.round("score", 6).alias("score"))


@query(f"WITH {DOCS}, {bm25_sql(TERMS)} SELECT link_id, url, round(pagerank, 6) AS pagerank, round(score, 6) AS score, (SELECT count(*) FROM scored) AS total_count FROM scored JOIN docs USING (link_id) ORDER BY docs.pagerank DESC, scored.score DESC, link_id LIMIT 10 OFFSET 20")
def search_match(spark, d):
    page = search.search(index_of(spark, d), search.Query.parse(MATCH, 20))
    return page.select("link_id", "url", F.round("pagerank", 6).alias("pagerank"), F.round("score", 6).alias("score"), "total_count")


@query(f"WITH {DOCS}, {bm25_sql(TERMS)} SELECT link_id, round(score * (score + pagerank), 6) AS rank_score, (SELECT count(*) FROM scored) AS total_count FROM scored JOIN docs USING (link_id) ORDER BY scored.score * (scored.score + docs.pagerank) DESC, scored.score DESC, link_id LIMIT 10")
def search_match_blended(spark, d):
    return search.search(index_of(spark, d), search.Query.parse(MATCH), blend="multiply").select("link_id", F.round("rank_score", 6).alias("rank_score"), "total_count")


@query(f"WITH {DOCS}, {bm25_sql(TERMS)} SELECT link_id, round(score, 6) AS score FROM scored")
def stored_postings_scores(spark, d):
    return stored_index(spark, d).scores(TERMS).select("link_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {DOCS} SELECT link_id FROM docs
    WHERE contains(' ' || array_to_string({tokens_sql('title')}, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string({tokens_sql('content')}, ' ') || ' ', ' of the ')"""
)
def stored_postings_phrase(spark, d):
    return stored_index(spark, d).phrase(["of", "the"])


PHRASE = '"of the"'


@query(
    f"""WITH {DOCS} SELECT link_id, url, count(*) OVER () AS total_count FROM docs
    WHERE contains(' ' || array_to_string({tokens_sql('title')}, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string({tokens_sql('content')}, ' ') || ' ', ' of the ')"""
)
def search_phrase(spark, d):
    hits = search.ranked(index_of(spark, d), search.Query.parse(PHRASE))
    urls = index_of(spark, d).documents().select("link_id", "url")
    return hits.select("link_id").join(urls, "link_id").withColumn("total_count", hits.agg(F.count(F.lit(1))).scalar())


@query(f"WITH {DOCS}, {bm25_sql(TERMS)} SELECT link_id, url, round(score, 6) AS score FROM scored JOIN docs USING (link_id) ORDER BY docs.pagerank DESC, scored.score DESC, link_id LIMIT 40 OFFSET 80")
def search_cursor(spark, d):
    """The third batch of 40, each found from the last hit of the one before."""
    stored, asked = index_of(spark, d), search.Query.parse(MATCH)
    first = search.top(stored, asked, 40).hits
    second = search.top(stored, asked, 40, after=first[-1]).hits
    third = search.top(stored, asked, 40, after=second[-1])
    return search.fetched(stored, third.hits, third.total).select("link_id", "url", F.round("score", 6).alias("score"))


CHANGED_DOCS = DOCS.replace("text AS content", "CASE WHEN doc_id % 10 = 3 THEN 'que que ' || text ELSE text END AS content").replace(
    "(doc_id % 97) / 97.0::DOUBLE AS pagerank", "(doc_id % 89) / 89.0::DOUBLE AS pagerank"
)


@query(f"WITH {CHANGED_DOCS}, {bm25_sql(TERMS)} SELECT link_id, round(pagerank, 6) AS pagerank, round(score, 6) AS score FROM scored JOIN docs USING (link_id)")
def segments_followed(spark, d):
    """BM25 and PageRanks after documents came in six commits, some were replaced, segments merged and new scores set."""
    docs, store = documents_of(spark, d), open_index(spark, fresh_store(spark, "index"))
    for k in range(6):
        store.put_documents(docs.where(F.col("doc_id") % 6 == k))
        if k % 2:
            stored = store.search_index()
    store.put_documents(docs.where("doc_id % 10 = 3").withColumn("content", F.concat(F.lit("que que "), "content")))
    store.put_scores(docs.select("link_id", ((F.col("doc_id") % 89) / 89.0).alias("score")))
    stored = store.search_index()
    return stored.scores(TERMS).join(stored.pageranks(), "link_id").select("link_id", F.round("pagerank", 6).alias("pagerank"), F.round("score", 6).alias("score"))


@query(f"WITH {DOCS}, {bm25_sql(['que'])} SELECT link_id, url, CASE WHEN title = '' THEN url ELSE title END AS title, (SELECT count(*) FROM scored) AS total_count FROM scored JOIN docs USING (link_id) ORDER BY docs.pagerank DESC, scored.score DESC, link_id LIMIT 10 OFFSET 10")
def search_page(spark, d):
    return search.search_page(index_of(spark, d), "que", "10").select("link_id", "url", "title", "total_count")


@query(
    """SELECT page_id, page_id + 1 AS from_row, page_id + least(10, total - page_id) AS to_row, total,
    CASE WHEN page_id = 0 THEN NULL WHEN page_id > 10 THEN '/search?q="a b"&offset=' || (page_id - 10) ELSE '/search?q="a b"' END AS prev_link,
    CASE WHEN page_id + least(10, total - page_id) < total THEN '/search?q="a b"&offset=' || (page_id + 10) END AS next_link FROM pages, (SELECT max(page_id) + 1 AS total FROM pages)"""
)
def pagination(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("long"))
    pages = pages.withColumn("all", pages.agg(F.max("page_id") + 1).scalar())
    total = F.col("all")
    return pages.select("page_id", *search.pagination(F.lit('"a b"'), F.col("page_id"), F.least(F.lit(10).cast("long"), total - F.col("page_id")), total))


@query("SELECT doc_id, CASE WHEN starts_with(q, '\"') AND ends_with(q, '\"') THEN 'phrase' ELSE 'match' END AS kind FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '\"' || lang || '\"' WHEN 1 THEN '\"' || lang ELSE lang END AS q FROM documents)")
def query_type(spark, d):
    n = F.col("doc_id")
    q = F.when(n % 3 == 0, F.concat(F.lit('"'), "lang", F.lit('"'))).when(n % 3 == 1, F.concat(F.lit('"'), "lang")).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", search.query_type(q).alias("kind"))


SENTENCES = r"""chars AS (SELECT doc_id, text, string_split(text, '') AS c FROM documents),
cuts AS (SELECT doc_id, text, len(c) AS n, list_filter(range(2, len(c) - 1), lambda i: c[i] IN ('.', '!', '?') AND (
    (regexp_matches(c[i - 1], '[\p{Ll}\p{N}\s\x0B\x{85}\p{Z}\p{S}]') AND regexp_matches(c[i + 1], '[\p{P}\s\x0B\p{Z}\p{N}\p{Lu}]')) OR regexp_matches(c[i - 1], '\p{S}'))) AS ends FROM chars),
pieces AS (SELECT doc_id, text, unnest([0] || ends) AS lo, unnest(ends || [n]) AS hi, generate_subscripts([0] || ends, 1) - 1 AS ordinal FROM cuts),
sentences AS (SELECT doc_id, ordinal::INT AS ordinal, substr(text, lo + 1, hi - lo) AS sentence FROM pieces WHERE hi > lo)"""


@query(f"WITH {SENTENCES} SELECT doc_id, ordinal, sentence FROM sentences")
def split_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("ordinal", "sentence"))


@query(
    r"""SELECT doc_id, round((len(list_filter(ws, lambda w: lower(w) IN ('the', 'que')))::DOUBLE / greatest(len(ws), 1))::FLOAT::DOUBLE, 6) AS ratio
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x0B\x{85}\p{Z}]+'), lambda w: w <> '') AS ws FROM documents)"""
)
def match_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.match_ratio(F.col("text"), ["The", "QUE"]).cast("double"), 6).alias("ratio"))


def summary_sql(terms: list[str], source: str) -> str:
    """A WITH list that ends in summaries(doc_id, summary) of the documents in ``source`` (doc_id, text)."""
    listed = ", ".join(f"'{t.lower()}'" for t in terms)
    return rf"""{SENTENCES.replace("FROM documents)", f"FROM {source})")}, split_up AS (SELECT *, list_filter(regexp_split_to_array(sentence, '[\s\x0B\x{{85}}\p{{Z}}]+'), lambda w: w <> '') AS ws FROM sentences),
    rated AS (SELECT *, (len(list_filter(ws, lambda w: lower(w) IN ({listed})))::DOUBLE / greatest(len(ws), 1))::FLOAT AS ratio FROM split_up),
    sized AS (SELECT *, coalesce(sum(strlen(sentence)) OVER (PARTITION BY doc_id ORDER BY ratio DESC, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before FROM rated WHERE ratio > 0),
    chosen AS (SELECT doc_id, ordinal, CASE WHEN strlen(sentence) > 256 - before THEN left(sentence, 256 - before) || '...' ELSE sentence END AS part FROM sized WHERE before < 256),
    marked AS (SELECT doc_id, ordinal, CASE WHEN ordinal - lag(ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal) <> 1 THEN '..' ELSE '' END || part || CASE WHEN ends_with(part, '.') THEN '' ELSE '.' END AS part FROM chosen),
    summaries AS (SELECT doc_id, coalesce(regexp_replace(joined, '^[\s\x0B\x{{85}}\p{{Z}}]+|[\s\x0B\x{{85}}\p{{Z}}]+$', '', 'g'), '') AS summary
      FROM {source} LEFT JOIN (SELECT doc_id, string_agg(part, '' ORDER BY ordinal) AS joined FROM marked GROUP BY doc_id) USING (doc_id))"""


@query(f"WITH {summary_sql(['the', 'que', 'der'], 'documents')} SELECT doc_id, summary FROM summaries")
def match_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", X.match_summary(F.col("text"), ["the", "que", "der"]).alias("summary"))


WANTED = '"que les"'
HOLDS = " OR ".join(f"contains(' ' || array_to_string({tokens_sql(c)}, ' ') || ' ', ' que les ')" for c in ("title", "content"))
ESCAPED = "summary"
for _c, _r in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'" * 2, "&#39;")):
    ESCAPED = f"replace({ESCAPED}, '{_c}', '{_r}')"


@query(
    f"""WITH {DOCS}, {bm25_sql(["que", "les"])}, hits AS (SELECT docs.*, score FROM docs JOIN scored USING (link_id) WHERE {HOLDS}),
    page AS (SELECT *, content AS text FROM hits ORDER BY pagerank DESC, score DESC, link_id LIMIT 10), {summary_sql(["que", "les"], "page")}
    SELECT link_id, CASE WHEN title = '' THEN url ELSE title END AS title, regexp_replace({ESCAPED}, '(?i)(?:que|les)', '<em>\\0</em>', 'g') AS summary, (SELECT count(*) FROM hits) AS total_count
    FROM page JOIN summaries USING (doc_id)"""
)
def search_page_summaries(spark, d):
    return search.search_page(index_of(spark, d), WANTED).select("link_id", "title", "summary", "total_count")


@query(
    """SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;'), '(?i)(?:tion|the)', '<em>\\0</em>', 'g') AS marked FROM documents"""
)
def highlight(spark, d):
    return table(spark, d, "documents").select("doc_id", X.highlight(X.escape_html(F.col("text")), ["the", "TION"]).alias("marked"))


INCOMING = f"""incoming AS (SELECT link_id, url, 'again' AS title, content, indexed_s + 10 AS indexed_s FROM docs WHERE doc_id % 3 = 0
  UNION ALL SELECT {uuid_sql("'new:' || doc_id")}, url, title, content, indexed_s FROM docs WHERE doc_id % 4 = 0)"""


def incoming_of(spark, d):
    docs = documents_of(spark, d)
    again = docs.where("doc_id % 3 = 0").select("link_id", "url", F.lit("again").alias("title"), "content", (F.col("indexed_at") + F.expr("INTERVAL 10 SECONDS")).alias("indexed_at"))
    new = docs.where("doc_id % 4 = 0").select(ids.uuid_of(F.concat(F.lit("new:"), F.col("doc_id").cast("string"))).alias("link_id"), "url", "title", "content", "indexed_at")
    none = docs.where("doc_id % 50 = 0").select(F.when(F.col("doc_id") % 100 == 0, F.lit(NIL_ID)).alias("link_id"), "url", "title", "content", "indexed_at")
    return docs.drop("doc_id"), again.union(new), none


@query(
    f"""WITH {DOCS}, {INCOMING} SELECT coalesce(n.link_id, o.link_id) AS link_id, coalesce(n.url, o.url) AS url, coalesce(n.title, o.title) AS title,
    length(coalesce(n.content, o.content))::INT AS n_content, coalesce(n.indexed_s, o.indexed_s) AS indexed_s, round(coalesce(o.pagerank, 0), 6) AS pagerank
    FROM docs o FULL OUTER JOIN incoming n ON o.link_id = n.link_id"""
)
def index_documents(spark, d):
    docs, new, none = incoming_of(spark, d)
    out = index.index_documents(docs, new.union(none))
    return out.select("link_id", "url", "title", F.char_length("content").alias("n_content"), seconds("indexed_at").alias("indexed_s"), F.round("pagerank", 6).alias("pagerank"))


@query(f"WITH {DOCS} SELECT CASE WHEN doc_id % 100 = 0 THEN '{NIL_ID}' END AS link_id, url FROM docs WHERE doc_id % 50 = 0")
def index_rejects(spark, d):
    _, new, none = incoming_of(spark, d)
    return index.index_rejects(new.union(none)).select("link_id", "url")


@query(
    f"""WITH {DOCS}, scores AS (SELECT CASE WHEN doc_id % 2 = 0 THEN {uuid_sql("'doc:' || doc_id")} ELSE {uuid_sql("'none:' || doc_id")} END AS link_id, quality + 0.25 AS score FROM labels)
    SELECT coalesce(o.link_id, s.link_id) AS link_id, coalesce(url, '') AS url, coalesce(title, '') AS title, coalesce(indexed_s, {NEVER}) AS indexed_s, round(coalesce(score, pagerank, 0), 6)::DOUBLE AS pagerank
    FROM docs o FULL OUTER JOIN scores s ON o.link_id = s.link_id"""
)
def update_scores(spark, d):
    labels = table(spark, d, "labels")
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("none:"), F.col("doc_id").cast("string")))
    scores = labels.select(ids.uuid_of(name).alias("link_id"), (F.col("quality") + 0.25).alias("score"))
    out = index.update_scores(documents_of(spark, d).drop("doc_id"), scores)
    return out.select("link_id", "url", "title", seconds("indexed_at").alias("indexed_s"), F.round("pagerank", 6).alias("pagerank"))


@query(f"WITH {DOCS} SELECT link_id, url, title, length(content)::INT AS n_content FROM docs WHERE doc_id = 7")
def find_document(spark, d):
    docs = documents_of(spark, d)
    wanted = docs.where("doc_id = 7").select("link_id").first()[0]
    return index.find_document(docs, wanted).select("link_id", "url", "title", F.char_length("content").alias("n_content"))


# ---- graph programs


def rank_sql(steps: int) -> str:
    """Supersteps unrolled: r1 is uniform, each next one follows from the one before."""
    out = f"""{GRAPH}, n AS (SELECT count(*)::DOUBLE AS n FROM vertices), used AS MATERIALIZED (SELECT src, dst FROM edges WHERE src <> dst),
    degree AS MATERIALIZED (SELECT src, count(*) AS k FROM used GROUP BY src), known AS MATERIALIZED (SELECT id, k FROM vertices LEFT JOIN degree ON id = src),
    r1 AS MATERIALIZED (SELECT id, k, 1 / n AS r, 1 / n AS change FROM known, n)"""
    for s in range(2, steps + 1):
        p = f"r{s - 1}"
        out += f""", r{s} AS MATERIALIZED (SELECT {p}.id, {p}.k, 0.15 / n + 0.85 * coalesce(got, 0) + 0.85 * lost / n AS r, abs(0.15 / n + 0.85 * coalesce(got, 0) + 0.85 * lost / n - {p}.r) AS change
          FROM {p} LEFT JOIN (SELECT dst, sum(r / k) AS got FROM used JOIN {p} ON src = id GROUP BY dst) ON dst = {p}.id, n, (SELECT coalesce(sum(r) FILTER (k IS NULL), 0) AS lost FROM {p}))"""
    return out


@query(f"WITH {GRAPH} SELECT src, count(*) AS out_degree FROM edges WHERE src <> dst GROUP BY src")
def out_degree(spark, d):
    return PR.out_degree(PR.usable_edges(*graph_of(spark, d)))


@query(f"WITH {rank_sql(8)} SELECT id, round(r, 9) AS rank FROM r8")
def pagerank_fixed_steps(spark, d):
    return PR.pagerank(*numbered_graph_of(spark, d), max_steps=8).select(graph_name(F.col("id")).alias("id"), F.round("rank", 9).alias("rank"))


#: supersteps to convergence on the oracle's data
CONVERGED = 48


@query(f"WITH {rank_sql(CONVERGED)} SELECT id, round(r, 9) AS rank FROM r{CONVERGED}")
def pagerank(spark, d):
    return PR.pagerank(*numbered_graph_of(spark, d)).select(graph_name(F.col("id")).alias("id"), F.round("rank", 9).alias("rank"))


@query(f"WITH {rank_sql(8)} " + " UNION ALL ".join(f"SELECT {s} AS step, round(sum(change), 9) AS change FROM r{s}" for s in range(1, 9)))
def pagerank_sad(spark, d):
    history: list = []
    PR.pagerank(*numbered_graph_of(spark, d), max_steps=8, history=history)
    return spark.createDataFrame(history, "step int, change double").select("step", F.round("change", 9).alias("change"))


@query(
    f"""WITH {rank_sql(CONVERGED)}, {DOCS} SELECT coalesce(d.link_id, s.link_id) AS link_id, coalesce(d.url, '') AS url, round(coalesce(s.r, d.pagerank), 9) AS pagerank
    FROM docs d FULL OUTER JOIN (SELECT {uuid_sql("'doc:' || substr(id, 2)")} AS link_id, r FROM r{CONVERGED} WHERE starts_with(id, 'p')) s ON d.link_id = s.link_id"""
)
def rank_then_index(spark, d):
    ranks = PR.pagerank(*numbered_graph_of(spark, d)).where("id % 2 = 1")
    scores = ranks.select(ids.uuid_of(F.concat(F.lit("doc:"), F.shiftright("id", 1).cast("string"))).alias("link_id"), F.col("rank").alias("score"))
    return index.update_scores(documents_of(spark, d).drop("doc_id"), scores).select("link_id", "url", F.round("pagerank", 9).alias("pagerank"))


#: rounds of the oracle, which cannot stop by itself; more than the longest cheapest path of its data has edges
DEPTH = 12
PATHS = f"""{GRAPH}, reach(id, cost, depth) AS (SELECT id, 0::BIGINT, 0 FROM vertices WHERE id = 's1' UNION
      SELECT dst, min(reach.cost + edges.cost)::BIGINT, depth + 1 FROM reach JOIN edges ON src = id WHERE depth < {DEPTH} GROUP BY dst, depth),
    best AS MATERIALIZED (SELECT v.id, min(reach.cost)::BIGINT AS cost FROM vertices v LEFT JOIN reach ON v.id = reach.id GROUP BY v.id),
    found AS MATERIALIZED (SELECT b.id, b.cost, min(e.src) FILTER (b.id <> 's1') AS prev FROM best b
      LEFT JOIN (edges e JOIN best s ON s.id = e.src) ON e.dst = b.id AND s.cost + e.cost = b.cost GROUP BY b.id, b.cost)"""


@query(f"WITH RECURSIVE {PATHS} SELECT id, cost, prev FROM found")
def shortest_paths(spark, d):
    return SP.shortest_paths(*graph_of(spark, d), "s1").select("id", "cost", "prev")


@query(
    f"""WITH RECURSIVE {PATHS}, walk(id, path) AS (SELECT id, id FROM found WHERE id = 's1' UNION ALL SELECT f.id, walk.path || '>' || f.id FROM found f JOIN walk ON f.prev = walk.id)
    SELECT f.id, f.cost, f.prev, walk.path FROM found f LEFT JOIN walk USING (id)"""
)
def shortest_path_routes(spark, d):
    return SP.shortest_paths(*graph_of(spark, d), "s1").select("id", "cost", "prev", F.array_join("path", ">").alias("path"))


def _vertices(spark, d, value):
    v, e = graph_of(spark, d)
    return v.select("id", value.alias("value")), e


@query(f"WITH {GRAPH} SELECT id, coalesce(sum(length(src)), 0)::BIGINT AS value FROM vertices LEFT JOIN edges ON dst = id GROUP BY id")
def pregel_message_exchange(spark, d):
    v, e = _vertices(spark, d, F.char_length("id").cast("long"))
    program = Pregel(lambda value, mail, s: (value if s == 0 else F.coalesce(mail, F.lit(0)).cast("long"), F.lit(s == 0)), send=lambda value, edge, s: value, combine=F.sum)
    return program.run(v, e, steps=2).vertices.select("id", "value")


@query(f"WITH {GRAPH} SELECT v.id, CASE WHEN v.id = 's1' OR count(src) > 0 THEN 42 ELSE 0 END::BIGINT AS value FROM vertices v LEFT JOIN edges ON dst = v.id AND src = 's1' GROUP BY v.id")
def pregel_broadcast(spark, d):
    v, e = _vertices(spark, d, F.when(F.col("id") == "s1", F.lit(42)).otherwise(0).cast("long"))
    program = Pregel(lambda value, mail, s: (F.coalesce(mail, value).cast("long"), F.lit(False)), send=lambda value, edge, s: F.when(value == 42, value) if s == 0 else F.lit(None).cast("long"), combine=F.max)
    return program.run(v, e, steps=2).vertices.select("id", "value")


@query(
    f"""WITH {GRAPH} SELECT id, coalesce(quantile_disc(v, 0.5), -1)::BIGINT AS value FROM vertices LEFT JOIN
      (SELECT dst, substr(src, 2)::BIGINT * 7919 % 1009 AS v FROM edges) ON dst = id GROUP BY id"""
)
def pregel_median(spark, d):
    """The lower median of what a vertex's neighbours send, which no combiner gives exactly."""
    v, e = _vertices(spark, d, F.substring("id", 2, 20).cast("long") * 7919 % 1009)

    def median(value, messages, step, n):
        if step == 0:
            return value, True  # active again, so that vertices without mail compute as well
        return next(itertools.islice(messages, (n - 1) // 2, None), -1) if n else -1, False

    return MailProgram(median, lambda value, edge, step: value, count=True).run(v, e, steps=2).vertices.select("id", "value")


@query(f"WITH {GRAPH} SELECT 0 AS step, count(*) + 5 AS total, sum(length(id))::DOUBLE AS weight FROM vertices UNION ALL SELECT 1, 2 * count(*) + 5, 2 * sum(length(id))::DOUBLE FROM vertices")
def pregel_aggregators(spark, d):
    v, e = _vertices(spark, d, F.char_length("id").cast("double"))
    found = Pregel(lambda value, mail, s: (value, F.lit(True)), aggregators={"total": F.count_if("computed"), "weight": F.sum("value")}, presets={"total": 5}).run(v, e, steps=2)
    return spark.createDataFrame([(s.superstep, s.aggregates["total"], float(s.aggregates["weight"])) for s in found.steps], "step int, total long, weight double")


@query(f"WITH {GRAPH} SELECT 0 AS step, count(*) + 5 AS delta FROM vertices UNION ALL SELECT 1, count(*) FROM vertices UNION ALL SELECT 2, count(*) FROM vertices")
def aggregator_delta(spark, d):
    v, e = _vertices(spark, d, F.lit(0).cast("long"))
    found = Pregel(lambda value, mail, s: (value, F.lit(True)), aggregators={"total": F.count_if("computed")}, presets={"total": 5}).run(v, e, steps=3)
    return spark.createDataFrame(list(enumerate(found.deltas("total"))), "step int, delta long")


@query(f"WITH {GRAPH} SELECT 0 AS step, count(*) AS active FROM vertices UNION ALL SELECT 1, count(DISTINCT dst) FROM edges UNION ALL SELECT 2, count(DISTINCT e.dst) FROM edges e WHERE src IN (SELECT dst FROM edges)")
def pregel_active(spark, d):
    v, e = _vertices(spark, d, F.lit(1).cast("long"))
    found = Pregel(lambda value, mail, s: (value, F.lit(False)), send=lambda value, edge, s: value).run(v, e, steps=3)
    return spark.createDataFrame([(s.superstep, s.active) for s in found.steps], "step int, active long")


@query(
    f"""WITH {GRAPH}, a AS MATERIALIZED (SELECT id, least(id, coalesce(min(src), id)) AS value FROM vertices LEFT JOIN edges ON dst = id GROUP BY id),
    b AS MATERIALIZED (SELECT a.id, least(a.value, coalesce(min(s.value), a.value)) AS value FROM a LEFT JOIN edges ON dst = a.id LEFT JOIN a s ON s.id = src GROUP BY a.id, a.value)
    SELECT id, value FROM b"""
)
def pregel_steps(spark, d):
    v, e = _vertices(spark, d, F.col("id"))
    program = Pregel(lambda value, mail, s: (F.least(value, mail.cast("string")), F.lit(True)), send=lambda value, edge, s: value, combine=F.min)
    return program.run(v, e, steps=3).vertices.select("id", "value")
