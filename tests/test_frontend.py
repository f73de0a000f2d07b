import json
from datetime import datetime, timedelta
from urllib.request import urlopen

import pytest
from pyspark.sql import functions as F

from strandline.__main__ import arguments, duration, partition, services
from strandline.errors import StrandlineError
from strandline.operators import search as S
from strandline.plans.frontend import Frontend, from_json, hits_json, to_json
from strandline.schemas import DOCUMENT, LINK
from strandline.sources.stores import open_graph, open_index


@pytest.fixture
def front(spark, tmp_path):
    documents = open_index(spark, f"index:{tmp_path}/d")
    rows = [(f"{i}", f"http://x/{i}?a&b", "" if i else "A <b> title", f"We saw the heron {i} times. <i>Nothing</i> else.", datetime(2024, 1, 1), 5.0 - i) for i in range(5)]
    documents.write("documents", spark.createDataFrame(rows, DOCUMENT))
    return Frontend(open_graph(spark, f"parquet:{tmp_path}/g"), documents, page_size=2, address=("127.0.0.1", 0))


def test_pages(front):
    status, page = front.handle("GET", "/search?q=heron")
    assert status == 200 and "Results 1 to 2 of 5" in page and "A &lt;b&gt; title" in page and "<em>heron</em>" in page and "http://x/0?a&amp;b" in page
    assert "offset=2" in page and "Previous" not in page
    status, page = front.handle("GET", "/search?q=heron&offset=4")
    assert "Results 5 to 5 of 5" in page and "offset=2" in page and "Next" not in page
    assert "No page matches" in front.handle("GET", "/search?q=%3Cscript%3E")[1] and "<script>" not in front.handle("GET", "/search?q=%3Cscript%3E")[1]
    assert front.handle("GET", "/")[0] == 200 and front.handle("GET", "/none")[0] == 404 and front.handle("POST", "/search")[0] == 404
    server = front.start()
    with urlopen(f"http://127.0.0.1:{server.server_address[1]}/") as got:
        assert got.status == 200 and b"<form" in got.read()
    server.shutdown()


def test_submit(front):
    assert front.handle("GET", "/submit/site")[0] == 200
    assert front.handle("POST", "/submit/site", "link=ftp%3A%2F%2Fx.example.com")[0] == 400
    for _ in range(2):
        assert front.handle("POST", "/submit/site", "link=http%3A%2F%2Fnew.example.com%2Fa%23top")[0] == 200
    assert [r.url for r in front.graph.read("links").collect()] == ["http://new.example.com/a"]


def test_failed_search(front, monkeypatch):
    monkeypatch.setattr(S, "search_page", lambda *a: 1 / 0)
    assert front.handle("GET", "/search?q=heron")[0] == 500


def test_json(spark, front):
    links = spark.createDataFrame([("1", "http://x/é", datetime(2024, 1, 2, 3, 4, 5))], LINK)
    text = links.select(to_json(LINK).alias("j"))
    assert json.loads(text.first().j)["url"] == "http://x/é" and "2024-01-02T03:04:05" in text.first().j
    back = text.select(from_json(F.col("j"), LINK).alias("s")).select("s.*")
    assert back.collect() == links.collect()
    assert spark.range(1).select(from_json(F.lit("nonsense"), LINK).alias("s")).select("s.id").first().id is None
    assert len(json.loads(hits_json(S.search_page(front.documents.search_index(), "heron").collect()))) == 5


def test_arguments(spark, tmp_path):
    options = arguments(["--text-indexer-uri", f"index:{tmp_path}/d", "--crawler-update-interval", "1h30m", "--frontend-listen-addr", ":0"])
    assert options.crawler_update_interval == timedelta(minutes=90) and options.ranker_update_interval == timedelta(hours=1)
    assert [s.name for s in services(spark, options)] == ["front-end", "crawler", "ranker"]
    assert partition("single")() == (0, 1)
    with pytest.raises(StrandlineError):
        partition("magic")
    with pytest.raises(Exception, match="duration"):
        duration("soon")
    with pytest.raises(StrandlineError):
        services(spark, arguments(["--text-indexer-uri", f"parquet:{tmp_path}/d"]))
