"""Search: match and phrase queries, ranking, pages of results."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import StrandlineError
from ..functions import text as X
from .postings import PostingsIndex
from .segments import Found, SegmentedIndex

PAGE_SIZE = 10
SUMMARY_LENGTH = 256
ENDPOINT = "/search"


@dataclass(frozen=True)
class Query:
    expr: str
    offset: int = 0
    phrase: bool = False

    @classmethod
    def parse(cls, text: str, offset: str | int | None = 0) -> Query:
        """A query as typed: in double quotes it is a phrase; an offset that is no number counts as 0."""
        try:
            start = max(int(offset or 0), 0)
        except ValueError:
            start = 0
        return cls(text, start, text.startswith('"') and text.endswith('"') and text != "")

    @property
    def terms(self) -> list[str]:
        return X.phrase_terms(self.expr) if self.phrase else X.query_terms(self.expr)


def query_type(expr: Column) -> Column:
    return F.when(expr.startswith('"') & expr.endswith('"'), F.lit("phrase")).otherwise(F.lit("match"))


def parse_offset(value: Column) -> Column:
    """An unsigned offset; 0 for anything else."""
    number = value.try_cast("bigint")
    return F.when(number >= 0, number).otherwise(F.lit(0).cast("bigint"))


def matching(stored: PostingsIndex | SegmentedIndex, query: Query) -> DataFrame:
    """(link_id, score, pagerank) of the documents that match: any term, or the phrase in one field."""
    terms = query.terms
    scored = stored.scores(terms)
    if query.phrase:
        scored = scored.join(stored.phrase(terms), "link_id", "left_semi")
    return scored.join(stored.pageranks() if isinstance(stored, SegmentedIndex) else stored.ranks(), "link_id")


def ranked(stored: PostingsIndex | SegmentedIndex, query: Query, blend: str | None = None) -> DataFrame:
    """Matches with ``rank_score``: by PageRank then text score, or blended.

    ``blend``: 'multiply' is score * (score + pagerank), 'sum' is score + pagerank.
    """
    found = matching(stored, query)
    if blend is None:
        return found.withColumn("rank_score", F.col("pagerank"))
    _check_blend(blend)
    total = F.col("score") + F.col("pagerank")
    return found.withColumn("rank_score", F.col("score") * total if blend == "multiply" else total)


def order() -> list[Column]:
    """Best first; ties by text score, then the smaller id."""
    return [F.desc("rank_score"), F.desc("score"), F.asc("link_id")]


def _check_blend(blend: str | None) -> None:
    if blend not in ("multiply", "sum", None):
        raise StrandlineError("blend must be 'multiply', 'sum' or None")


def top(stored: SegmentedIndex, query: Query, k: int, blend: str | None = None, after: Row | None = None) -> Found:
    """The first ``k`` hits, or those after the hit ``after``, from the blocks that can hold them (see :class:`SegmentedIndex`)."""
    _check_blend(blend)
    terms = query.terms
    key = None if after is None else (after.rank_score, after.score, after.link_id)
    return stored.top(list(dict.fromkeys(terms)), k, blend, terms if query.phrase else None, key)


def fetched(stored: PostingsIndex | SegmentedIndex, page: list[Row], total: int) -> DataFrame:
    """Hits with their documents, which are fetched by their ids."""
    keys = [r.link_id for r in page]
    shown = stored.spark.createDataFrame([(i, r.link_id, r.score, r.rank_score, total) for i, r in enumerate(page)], "position int, link_id string, score double, rank_score double, total_count long")
    found = stored.documents(keys) if isinstance(stored, SegmentedIndex) else stored.documents().where(F.col("link_id").isin(keys))
    return found.join(F.broadcast(shown), "link_id").orderBy("position")


def search(stored: PostingsIndex | SegmentedIndex, query: Query, blend: str | None = None, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of hits in order, each with its ``position`` and the number of all hits.

    Hits are ranked from the postings of the query's terms as a top-k of ids;
    only the page's documents are then fetched, by their ids.  An index in segments
    reads the postings that can hold the page's hits and no others.
    """
    if isinstance(stored, SegmentedIndex):
        found = top(stored, query, query.offset + page_size, blend)
        return fetched(stored, found.hits[query.offset :], found.total)
    hits = ranked(stored, query, blend)
    page = hits.orderBy(*order()).offset(query.offset).limit(page_size).select("link_id", "score", "rank_score").collect()  # page_size rows
    if 0 < len(page) < page_size:
        total = query.offset + len(page)
    else:
        total = hits.count() if page else 0
    return fetched(stored, page, total)


def batches(stored: PostingsIndex | SegmentedIndex, query: Query, blend: str | None = None, size: int = PAGE_SIZE) -> Iterator[Row]:
    """All hits from the query's offset on, fetched ``size`` at a time as they are asked for.

    Over an index in segments each batch begins after the last hit of the one
    before, on one version of the index, whatever is written meanwhile.
    """
    if isinstance(stored, SegmentedIndex):
        skip, last = query.offset, None
        while True:
            page = top(stored, query, skip + size, blend, last)
            rows = page.hits[skip:]
            yield from fetched(stored, rows, page.total).collect() if rows else []
            if len(rows) < size:
                return
            skip, last = 0, rows[-1]
    offset = query.offset
    while True:
        rows = search(stored, replace(query, offset=offset), blend, size).collect()
        yield from rows
        if len(rows) < size:
            return
        offset += size


def search_page(stored: PostingsIndex | SegmentedIndex, text: str, offset: str | int = 0, page_size: int = PAGE_SIZE, summary_length: int = SUMMARY_LENGTH) -> DataFrame:
    """link_id, url, title, summary, total_count, rank_score, score: a page as shown, summaries made for its rows alone."""
    query = Query.parse(text, offset)
    page = search(stored, query, page_size=page_size)
    terms = X.display_terms(query.expr)
    summary = X.highlight(X.escape_html(X.match_summary(F.col("content"), terms, summary_length)), terms)
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url"))
    return page.select("link_id", "url", title.alias("title"), summary.alias("summary"), F.col("total_count"), "rank_score", "score")


def pagination(text: Column, offset: Column, shown: Column, total: Column, page_size: int = PAGE_SIZE) -> list[Column]:
    """From, To, Total and the links to the pages before and after; links keep the query as typed."""
    before = offset - page_size
    prev = F.when(offset > 0, F.when(before > 0, F.format_string(ENDPOINT + "?q=%s&offset=%d", text, before)).otherwise(F.format_string(ENDPOINT + "?q=%s", text)))
    after = offset + shown
    follow = F.when(after < total, F.format_string(ENDPOINT + "?q=%s&offset=%d", text, after))
    return [(offset + 1).alias("from_row"), after.alias("to_row"), total.alias("total"), prev.alias("prev_link"), follow.alias("next_link")]
