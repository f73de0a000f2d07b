"""Links, titles and text of HTML.

The regular expressions are fixed values and matched with Java's ``d`` flag, so
that a dot stops at line feeds alone; white space is spelled out for the same
reason.
"""

from __future__ import annotations

import html as _html
import re
from urllib.parse import quote, unquote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .let import let

# The patterns that define links, bases, titles and exclusions.
WS = r"[\t\n\f\r ]"
BASE = rf'(?id)<base.*?href{WS}*?={WS}*?"(.*?){WS}*?"'
LINK = rf'(?id)<a.*?href{WS}*?={WS}*?"{WS}*?(.*?){WS}*?".*?>'
NOFOLLOW = rf'(?id)rel{WS}*?={WS}*?"?nofollow"?'
TITLE = r"(?id)<title.*?>(.*?)</title>"
EXCLUDED = r"(?id)\.(?:jpg|jpeg|png|gif|ico|css|js)$"
# Elements whose content is not text.
SILENT = ("script", "style", "title", "noscript", "iframe", "object", "noembed", "noframes")


def crawlable(url: Column) -> Column:
    """Whether a URL can hold HTML, by its ending."""
    return ~url.rlike(EXCLUDED.replace("$", r"\z"))


def base_href(html: Column) -> Column:
    """The page's base with a slash at its end; null if it names none, or an empty one."""
    return let(F.regexp_extract(html, BASE, 1), lambda found: F.when(found != "", F.when(found.endswith("/"), found).otherwise(F.concat(found, F.lit("/")))))


def anchors(html: Column) -> Column:
    """array<struct<target, nofollow>> of all anchors, in page order."""
    tags = F.regexp_extract_all(html, F.lit(LINK), 0)
    return F.transform(tags, lambda tag: F.struct(F.regexp_extract(tag, LINK, 1).alias("target"), tag.rlike(NOFOLLOW).alias("nofollow")))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*\z", "")


_VALID_PATH = re.compile(r"[A-Za-z0-9\-._~!$&'()*+,;=:@/\[\]%]*").fullmatch
_KEPT = "/$&+,:;=@~-._"


def resolve(base: str | None, target: str | None) -> str | None:
    """An absolute URL (RFC 3986); null if either part cannot be read.

    A path that holds other than URL characters is escaped anew.
    """
    if not base or not target:
        return None
    if re.search(r"[\x00-\x1f\x7f]", target) or re.search(r"%(?![0-9a-fA-F]{2})", target) or re.match(r"[^/?#]*:", target) and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", target):
        return None
    try:
        if target.startswith("//"):
            target = f"{urlsplit(base).scheme}:{target}"
        whole = urlsplit(urljoin(base, target))
        path = whole.path if _VALID_PATH(whole.path) else quote(unquote(whole.path), safe=_KEPT)
        return urlunsplit((whole.scheme, whole.netloc, path, whole.query, whole.fragment))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _resolve_any(base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, t) for b, t in zip(base, target, strict=True)], dtype="object")


_PLAIN = r"[A-Za-z0-9_~!$&'()*+,;=@-]"


_STEP = r"[A-Za-z0-9_~!$&'()*+,=@.-]*"


def _squeezed(segments: Column) -> Column:
    """Without empty segments between others."""
    return F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == F.size(segments) - 1))


def _without_dots(segments: Column) -> Column:
    """A path's segments with ``.`` and ``..`` carried out on a stack."""
    empty = F.expr("cast(array() as array<string>)")
    up = lambda stack: F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
    stack = F.aggregate(segments, empty, lambda stack, s: F.when(s == "..", up(stack)).when(s == ".", stack).otherwise(F.concat(stack, F.array(s))))
    last = F.element_at(segments, -1).isin(".", "..")
    return F.when(last, F.concat(stack, F.array(F.lit("")))).otherwise(stack)


def relative_url(base: Column, target: Column) -> Column:
    """:func:`resolve` natively for paths of plain characters, relative ones and dot segments included; null for others."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    under = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    steps = rf"(?:/?{_STEP}(?:/{_STEP})*)"
    fits = (site != "") & under.rlike(rf"^(?:/{_STEP})*\z") & target.rlike(rf"^(?!//){steps}(?:\?{_PLAIN}*)?\z") & (target != "")
    path = F.substring_index(target, "?", 1)
    query = F.when(target.contains("?") & ~target.endswith("?"), F.concat(F.lit("?"), F.substring_index(target, "?", -1))).otherwise(F.lit(""))
    around = F.regexp_replace(under, r"[^/]+\z", "")  # the folder that the page lies in
    joined = F.concat(F.when(around == "", F.lit("/")).otherwise(around), path)
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(let(F.split(joined, "/"), _squeezed))
    walked = let(segments, lambda s: F.array_join(_without_dots(s), "/"))
    rooted = let(walked, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))
    # a query alone stays on the page
    return F.when(fits & (path == ""), F.concat(site, under, query)).when(fits, F.concat(site, rooted, query))


def plain_url(base: Column, target: Column) -> Column:
    """:func:`resolve` natively for plain absolute URLs and plain paths; null for others."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rooted = target.rlike(rf"^(?:/{_PLAIN}+(?:\.{_PLAIN}+)*)+/?(?:\?{_PLAIN}*)?\z")
    absolute = target.rlike(rf"^https?://[a-z0-9.:-]+(?:/{_PLAIN}+(?:\.{_PLAIN}+)*)*/?\z")
    return F.when(rooted & site.contains("://"), F.concat(site, target)).when(absolute, target).otherwise(relative_url(base, target))


def with_resolved(df: DataFrame, base: str, target: str, name: str) -> DataFrame:
    """Adds ``name``, the URL of ``target`` against ``base``: natively where that does, in Arrow batches for the rest.

    One-element generators keep the optimizer from writing the expressions out
    once for each use.
    """
    native = df.select("*", F.explode(F.array(plain_url(F.col(base), F.col(target)))).alias("_native"))
    rest = F.when(F.col("_native").isNull(), F.col(base))
    settled = native.withColumn("_found", F.coalesce("_native", _resolve_any(rest, F.col(target))))
    return settled.select(*df.columns, F.explode(F.array("_found")).alias(name))


def hostname(url: Column) -> Column:
    """Host in lower case without user, port or brackets."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    return let(authority, lambda a: F.when(a.startswith("["), F.regexp_extract(a, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(a, r":[0-9]*$", "")))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, WS + "+", " ")


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+\z", "")


def strip_tags(html: Column) -> Column:
    """Text between tags; comments and the content of silent elements go too, and nothing stands in their place."""
    out = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    for name in SILENT:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)", "")
    return F.regexp_replace(out, r"(?s)<[/!?a-zA-Z][^>]*(?:>|\z)", "")


# The character references that are read natively, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


@F.pandas_udf(T.StringType())
def _unescape_any(text: pd.Series) -> pd.Series:
    return text.map(_html.unescape, na_action="ignore")


def unescape(text: Column, every: bool = False) -> Column:
    """Character references resolved: common ones natively; with ``every``, the whole of HTML's list."""
    if every:
        return F.when(text.contains("&"), _unescape_any(text)).otherwise(text)
    marked = F.regexp_replace(text, "&amp;", "&\u0001")
    for reference, char in ENTITIES[:-1]:
        marked = F.regexp_replace(marked, reference, char)
    return F.regexp_replace(marked, "&\u0001", "&")


def title(html: Column, every: bool = False) -> Column:
    return trimmed(unescape(collapse(strip_tags(F.regexp_extract(html, TITLE, 1))), every))


def text(html: Column, every: bool = False) -> Column:
    return trimmed(unescape(collapse(strip_tags(html)), every))
