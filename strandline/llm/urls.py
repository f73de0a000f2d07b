"""URL filters with redirect equivalence (operator 1).

Rules name a host and a path prefix and allow or block; the longest that fits
decides.  A page that no rule fits takes the decision of its aliases: URLs tied
by redirects (``http-equiv=refresh``), canonical links (all of a page, resolved
against its base), or edges given by the caller form components, and a block that a rule lays on any URL of a component
reaches the pages in it.  A page's own rule comes first, so an explicit allow
stands against an inherited block.  Without either, a page is allowed.

Everything is native: rules are a literal list matched by expressions, edges
come from regular expressions (targets relative to the document are resolved in
Arrow batches), components from :mod:`components`, and only URLs
with an edge take part in joins.

Defined results: a null URL, or one without ``://``, has empty host and path,
no rule and no aliases.  Repeated rows are judged alike; URLs that differ in
the fragment alone are one vertex.  Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import with_resolved
from .components import components
from .store import save

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path prefix, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

_NAME = r"(?<![-\w])"
_LINK = rf"(?is)<link\b[^>]*{_NAME}rel\s*=\s*(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>]))[^>]*>"
_META = rf"(?is)<meta\b[^>]*{_NAME}http-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"
_BASE = rf"(?is)<base\b[^>]*{_NAME}href\s*=[^>]*>"
_HREF = rf"(?is){_NAME}href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_TO = r"(?is)\burl\s*=\s*['\"]?([^'\"\s>]+)"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, SMALL)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def vertex(url: Column) -> Column:
    """A URL without its fragment, scheme and host in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    start = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.translate(start, UPPER, SMALL), F.regexp_replace(bare, r"(?s)^.*?://[^/?#]*", ""))


def _href(tag: Column) -> Column:
    return F.concat(*[F.regexp_extract(tag, _HREF, i) for i in (1, 2, 3)])


def _plain(target: Column) -> Column:
    return F.trim(F.regexp_replace(target, "(?i)&amp;", "&"))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): all canonical and refresh targets named in the pages, against the page's base."""
    tags = pages.select("url", "html", F.regexp_extract_all("html", F.lit(_LINK), 0).alias("links"), F.regexp_extract_all("html", F.lit(_META), 0).alias("metas")).where("url is not null and size(links) + size(metas) > 0")
    named = F.concat(F.transform("links", _href), F.transform("metas", lambda tag: F.regexp_extract(tag, _TO, 1)))
    targets = tags.select("url", _plain(_href(F.regexp_extract("html", _BASE, 0))).alias("named"), F.explode(named).alias("to")).where("to <> ''").withColumn("to", _plain(F.col("to")))
    based = with_resolved(targets, "url", "named", "base").withColumn("base", F.coalesce("base", "url"))
    target = F.col("to")
    site = F.regexp_extract("base", r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract("base", r"(?s)^(.*?):", 1)
    whole = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(site, target))
    # the others are relative to the document
    rest = with_resolved(based.withColumn("whole", whole).withColumn("left", F.when(F.col("whole").isNull(), F.col("to"))), "base", "left", "resolved")
    return rest.select(vertex(F.col("url")).alias("src"), vertex(F.coalesce("whole", "resolved")).alias("dst")).where("dst like '%://%'")


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and whether the verdict came from aliases.

    ``edges`` (src, dst), such as a log of redirects, add to those in the pages.
    """
    ties = link_edges(pages)
    if edges is not None:
        ties = ties.union(edges.select(vertex(F.col("src")).alias("src"), vertex(F.col("dst")).alias("dst")))
    ties = save(ties.where("src is not null and dst is not null and src <> dst"), "ties")
    named, verdict = rule(F.col("host"), F.col("path"), rules)
    plain = pages.select("page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    judged = plain.select("page_id", "url", "host", "path", named.alias("rule"), verdict.alias("own"))
    if ties.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.lit(False).alias("inherited"))
    roots = components(ties, "src", "dst")
    met = roots.select("id", "root", host(F.col("id")).alias("host"), path(F.col("id")).alias("path")).select("id", "root", verdict.alias("own"))
    blocked = met.where("own = 'block'").select("root").distinct()
    tainted = met.join(blocked, "root").select("id")
    out = judged.join(tainted, vertex(F.col("url")) == F.col("id"), "left")
    inherited = F.col("own").isNull() & F.col("id").isNotNull()
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(inherited, F.lit("block")), F.lit("allow")).alias("verdict"), inherited.alias("inherited"))


def oracle(rules=RULES) -> str:
    """DuckDB SQL with the columns of :func:`judge` on pages that name their links by absolute URLs."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    parts = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{SMALL}') AS host, regexp_extract(coalesce({u}, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path"
    best = lambda t: f"(SELECT arg_max(struct_pack(name := rh || rp, v := v), length(rh || rp)) FROM rules WHERE ({t}.host = rh OR ends_with({t}.host, '.' || rh)) AND starts_with({t}.path, rp))"
    return f"""
    WITH RECURSIVE rules(rh, rp, v) AS (VALUES {values}),
    plain AS (SELECT page_id, regexp_replace(url, '#.*$', '', 's') AS node, html, {parts('url')} FROM pages),
    judged AS (SELECT *, {best('plain')} AS r FROM plain),
    ties AS (SELECT node AS a, regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?is)\\bhref\\s*=\\s*"([^"]*)"', 1) AS b FROM plain),
    both_ AS (SELECT a, b FROM ties WHERE b <> '' AND a IS NOT NULL UNION SELECT b, a FROM ties WHERE b <> '' AND a IS NOT NULL),
    reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
    nodes AS (SELECT DISTINCT b, {parts('b')} FROM reach),
    bad AS (SELECT b FROM (SELECT b, {best('nodes')} AS r FROM nodes) WHERE r.v = 'block'),
    tainted AS (SELECT DISTINCT reach.a FROM reach JOIN bad ON reach.b = bad.b)
    SELECT page_id, host, path, r.name AS rule,
           coalesce(r.v, CASE WHEN tainted.a IS NOT NULL THEN 'block' END, 'allow') AS verdict, r.v IS NULL AND tainted.a IS NOT NULL AS inherited
    FROM judged LEFT JOIN tainted ON judged.node = tainted.a"""
