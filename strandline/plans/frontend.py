"""Pages for people over the search: a form, results, and a form to submit sites.

A request is handled on the driver by one search, which reads the postings of
its terms and the documents of one page; HTML is made of those rows alone.
"""

from __future__ import annotations

import html
import json
import threading
from datetime import timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, urlsplit

from pyspark.sql import Column, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import html as H
from ..operators import search
from ..sources.stores import IndexStore, Store

HOME, SEARCH, SUBMIT = "/", search.ENDPOINT, "/submit/site"


def to_json(schema: StructType) -> Column:
    """A row of a stored table as a JSON object; times in UTC with zone."""
    return F.to_json(F.struct(*schema.fieldNames()), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"})


def from_json(text: Column, schema: StructType) -> Column:
    """The struct of a JSON object; null where it cannot be read."""
    return F.from_json(text, schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"})


def _page(title: str, body: str, terms: str = "") -> str:
    form = f'<form action="{SEARCH}"><input name="q" value="{html.escape(terms)}"><button>Search</button></form>'
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><nav><a href="{HOME}">Home</a> <a href="{SUBMIT}">Submit a site</a></nav>{form}{body}</body></html>'


def results_page(terms: str, rows: list[Row], offset: int, page_size: int = search.PAGE_SIZE) -> str:
    """Rows of :func:`search.search_page` as HTML; summaries are escaped and marked already."""
    if not rows:
        return _page("Search", "<p>No page matches this search.</p>", terms)
    total, upto = rows[0].total_count, offset + len(rows)
    out = [f"<p>Results {offset + 1} to {upto} of {total}</p><ol start={offset + 1}>"]
    out += [f'<li><a rel="nofollow" href="{html.escape(r.url or "")}">{html.escape(r.title or "")}</a> <cite>{html.escape(r.url or "")}</cite><p>{r.summary}</p></li>' for r in rows]
    link = lambda at, name: f'<a rel="nofollow" href="{SEARCH}?q={quote(terms)}' + (f"&amp;offset={at}" if at else "") + f'">{name}</a>'
    before = link(max(offset - page_size, 0), "Previous") if offset else ""
    after = link(upto, "Next") if upto < total else ""
    return _page("Search", "".join(out) + f"</ol><p>{before} {after}</p>", terms)


class Frontend:
    """Routes: the home page, searches, and submitted sites; anything else is not found."""

    def __init__(self, graph: Store, documents: IndexStore, page_size: int = search.PAGE_SIZE, summary_length: int = search.SUMMARY_LENGTH, address: tuple[str, int] = ("127.0.0.1", 8080)) -> None:
        self.graph, self.documents, self.page_size, self.summary_length, self.address = graph, documents, page_size, summary_length, address
        self.name, self.interval = "front-end", timedelta(seconds=1)
        self.server: ThreadingHTTPServer | None = None

    def handle(self, method: str, target: str, form: str = "") -> tuple[int, str]:
        """(status, HTML) of a request."""
        parts = urlsplit(target)
        given = {k: v[0] for k, v in parse_qs(parts.query).items()}
        if parts.path == HOME and method == "GET":
            return 200, _page("Search", "")
        if parts.path == SEARCH and method == "GET":
            return self._search(given.get("q", ""), given.get("offset", "0"))
        if parts.path == SUBMIT and method == "GET":
            return 200, self._submit_page("")
        if parts.path == SUBMIT and method == "POST":
            return self._submit(parse_qs(form).get("link", [""])[0])
        return 404, _page("Not found", "<p>There is no such page.</p>")

    def _search(self, terms: str, offset: str) -> tuple[int, str]:
        try:
            rows = search.search_page(self.documents.search_index(), terms, offset, self.page_size, self.summary_length).collect()  # page_size rows
        except Exception:  # noqa: BLE001 - shown as an error page, whatever failed
            return 500, _page("Error", "<p>The search failed. Please try again later.</p>", terms)
        return 200, results_page(terms, rows, search.Query.parse(terms, offset).offset, self.page_size)

    @staticmethod
    def _submit_page(message: str) -> str:
        return _page("Submit a site", f'<form action="{SUBMIT}" method="post"><input name="link" placeholder="http://"><button>Submit</button></form><p>{message}</p>')

    def _submit(self, link: str) -> tuple[int, str]:
        spark = self.graph.spark
        url = spark.range(1).select(F.lit(link).alias("url")).where(H.scheme(F.col("url")).isin("http", "https")).select(H.without_fragment(F.col("url")).alias("url"))
        if url.isEmpty():
            return 400, self._submit_page("This is no address of a web site.")
        self.graph.upsert_links(url)
        return 200, self._submit_page("The site was added.")

    def start(self) -> ThreadingHTTPServer:
        """Serve in the background; ``shutdown()`` of what is returned ends it."""
        front = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self) -> None:
                size = int(self.headers.get("Content-Length") or 0)
                status, page = front.handle(self.command, self.path, self.rfile.read(size).decode("utf-8", "replace"))
                body = page.encode()
                self.send_response(status)
                self.send_header("Content-Type", "text/html; charset=utf-8")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            do_GET = do_POST = answer

            def log_message(self, *_: object) -> None:
                pass

        self.server = ThreadingHTTPServer(self.address, Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self.server

    def run_once(self) -> None:
        """As a service of a group: the first turn starts the server."""
        if self.server is None:
            self.start()


def hits_json(rows: list[Row]) -> str:
    """Rows of a page of results as JSON."""
    return json.dumps([r.asDict() for r in rows], default=str, ensure_ascii=False)
