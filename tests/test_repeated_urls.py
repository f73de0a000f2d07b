from strandline.operators import crawl
from strandline.schemas import LINK


def frames(spark):
    url = "http://a.example.com/"
    pages = [(1, url, '<a href="/one">x</a>'), (2, url, '<a href="/two">y</a>'), (3, "http://b.example.com/", "z")]
    stored = spark.createDataFrame(pages, "page_id long, url string, html string")
    links = stored.selectExpr("md5(url) AS id", "url", "timestamp_seconds(0) AS retrieved_at", "page_id")
    return links, stored


def test_fetches_of_one_url_stay_apart(spark):
    links, pages = frames(spark)
    assert set(LINK.fieldNames()) <= set(links.columns)
    assert crawl.fetched(links, pages, fetch="page_id").count() == 3
    found = crawl.crawl_pages(links, pages, fetch="page_id").select("url", "links").collect()
    assert sorted((r.url, r.links) for r in found) == [("http://a.example.com/", ["http://a.example.com/one"]), ("http://a.example.com/", ["http://a.example.com/two"]), ("http://b.example.com/", [])]
