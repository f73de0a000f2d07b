from strandline.llm import urls


def rows(spark, data):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(data)], "page_id long, url string, html string, verdict string, id string")


def test_rules_and_hosts(spark):
    data = [("http://EXAMPLE.com/en/x", ""), ("http://www.example.com/en/", ""), ("http://a.www.Example.com/en/a?q", ""), ("https://x.net/es/1", ""), ("https://x.net/de/1", ""), ("http://other.org", ""), ("no url", ""), (None, None), ("http://com?x/", ""), ("ftp://u@example.com:80/en/", ""), ("http://notexample.com/en/", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(rows(spark, data)).collect()}
    assert got == {
        0: ("example.com", "/en/x", "example.com/en/", "block"),
        1: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        2: ("a.www.example.com", "/en/a", "www.example.com/en/", "allow"),
        3: ("x.net", "/es/1", "net/es/", "block"),
        4: ("x.net", "/de/1", None, "allow"),
        5: ("other.org", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("com", "", None, "allow"),
        9: ("u@example.com:80", "/en/", None, "allow"),
        10: ("notexample.com", "/en/", "com/", "allow"),
    }


def test_aliases(spark):
    canonical = lambda to: f'<head><link rel="canonical" href="{to}"></head>'
    refresh = lambda to: f'<META http-equiv="refresh" content="0; url={to}">'
    data = [
        ("http://a.org/1", canonical("http://b.org/2")),
        ("http://b.org/2", refresh("http://x.net/es/bad")),
        ("http://ok.com/", canonical("http://a.org/1")),
        ("http://c.org/", canonical("/home")),
        ("http://c.org/home#top", ""),
        ("http://d.org/", canonical("http://a.org/1#part")),
        ("http://d.org/", canonical("http://a.org/1#part")),
    ]
    got = {(r.page_id, r.verdict, r.inherited) for r in urls.judge(rows(spark, data)).collect()}
    assert got == {(0, "block", True), (1, "block", True), (2, "allow", False), (3, "allow", False), (4, "allow", False), (5, "block", True), (6, "block", True)}
    log = spark.createDataFrame([("http://c.org/home", "http://z.net/fr/"), (None, "http://c.org/"), ("http://c.org/", "http://c.org/")], "src string, dst string")
    got = {r.page_id: r.verdict for r in urls.judge(rows(spark, data), edges=log).collect()}
    assert got[3] == got[4] == "block" and got[2] == "allow"


def test_relative_targets_and_all_tags(spark):
    bad = "http://x.net/es/bad"
    data = [
        ("http://a.org/d/1", "<meta http-equiv=refresh content='0;url=index.html'>"),
        ("http://a.org/d/index.html", f'<link rel="canonical" href="{bad}">'),
        ("http://b.org/d/e/1", "<link rel=canonical href='../a'>"),
        ("http://b.org/d/a", f"<link rel='alternate canonical' href='{bad}'>"),
        ("http://c.org/p?id=1", '<link rel="canonical" href="?id=3">'),
        ("http://c.org/p?id=3", f'<link rel="canonical" href="http://ok.org/"><link href="{bad}" rel="canonical">'),
        ("http://d.org/1", '<base href="http://e.org/q/"><link rel="canonical" href="2">'),
        ("http://e.org/q/2", f'<meta http-equiv="refresh" content="9"><meta http-equiv="refresh" content="0; url={bad}">'),
        ("http://f.org/1", f'<link rel="non-canonical" href="{bad}"><link rel="alternate" href="{bad}"><link rel="canonical" href="mailto:x">'),
    ]
    got = {r.page_id: (r.verdict, r.inherited) for r in urls.judge(rows(spark, data)).collect()}
    assert got == {i: ("block", True) for i in range(8)} | {8: ("allow", False)}


def test_empty(spark):
    assert urls.judge(rows(spark, []).limit(0)).collect() == []
