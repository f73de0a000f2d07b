import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import mainpage as M

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site name and menu</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad 3 -->
<div id="cookie-notice">We use cookies here</div>
<div class="ad">Buy this thing now.</div><article><h1>Title &eacute; here</h1><p><b>First  paragraph
of the text.<br><p>Second &amp; third&nbsp;words.</p><div class="ad">Inner advert.</div><aside>Side words</aside>
<p>End.</p><form>Name: <input><button>Go</button></form><div class="comments"><p>Nice post! I liked it very much indeed.</p></div></article>
<footer>&copy; site</footer></body></html>"""
EXPECTED = "Title é here\nFirst paragraph of the text.\nSecond & third words.\nEnd."


def pages(spark, html):
    return spark.createDataFrame([(i, f"u{i}", h, "t", "f") for i, h in enumerate(html)], "page_id long, url string, html string, text string, feature string")


def test_article(spark):
    plain = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")
    cut = PAGE[: PAGE.index("third&nbsp;") + 3]
    got = {r.page_id: (r.text, r.n_chars) for r in M.extract(pages(spark, [PAGE, plain, None, "", PAGE, cut, "<p>a &lt; b</p><p", "only text"])).collect()}
    assert got[0] == got[1] == got[4] == (EXPECTED, len(EXPECTED))
    assert got[2] == got[3] == ("", 0)
    assert got[5][0] == EXPECTED[: EXPECTED.index("third") + 3]
    assert got[6][0] == "a < b" and got[7][0] == "only text"


@pytest.mark.parametrize("wrapper", ["div class='content no-sidebar'", "div class='has-comments ad-free'", "div class='sidebar'", "div class='overflow-hidden'", "form id=aspnet"])
def test_wrapper_of_the_article(wrapper):
    page = f"<body><div class='ad'>Buy it now.</div><{wrapper}><article><p>The words of the <math><mi>x</mi></math> article.</p><div class='ad'>Inner advert.</div></article></{wrapper.split()[0]}></body>"
    assert M.main_blocks(page, M.Scorer({})) == ["The words of the x article."]


def test_names_are_a_prior():
    page = "<body><div class='related'><p>Words that labelled pages hold in such elements.</p></div></body>"
    assert M.main_blocks(page, M.Scorer({})) == []
    assert M.main_blocks(page, M.Scorer({".related": 5.0})) == ["Words that labelled pages hold in such elements."]
    assert M.main_blocks("<div hidden>Words not shown.</div><div style='display: none'>Nor these.</div><p>Words.</p>", M.Scorer({})) == ["Words."]


def test_no_labels_and_empty(spark):
    assert M.extract(pages(spark, ["<nav>menu</nav><p>Words of a page.</p>"])).first().text == "Words of a page."
    assert M.extract(pages(spark, [""]).limit(0)).collect() == []
    assert M.learn(pages(spark, ["<p>x</p>"])) == {}


def test_long_page(spark):
    body = "".join(f"<p>Paragraph number {i} with some words.</p>" for i in range(20000))
    text = M.extract(pages(spark, [f"<nav>m</nav><article>{body}</article>"])).first().text
    assert text.count("\n") == 19999


@pytest.mark.parametrize("source", ["<", "<p", "</", "<!--", "<a href='", "<script>x", "&am", "<p></b></p></div>x", "<table><tr><td>a<td>b</table>"])
def test_broken(source):
    M.main_blocks(source, M.Scorer({}))


def exhaustive(line):
    """First region with the highest positive total, of all."""
    best, region = 0.0, None
    for i in range(len(line)):
        total = 0.0
        for j in range(i, len(line)):
            total += line[j][1] - (line[j][0] if j > i else 0)
            if total > best + 1e-9:
                best, region = total, (i, j)
    return best, region


def total(line, region):
    return 0.0 if region is None else sum(w for _, w in line[region[0] : region[1] + 1]) - sum(t for t, _ in line[region[0] + 1 : region[1] + 1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-9, 9)), max_size=14))
def test_best_region(line):
    got = M.best_region(line)
    best, region = exhaustive(line)
    assert total(line, got) == pytest.approx(best) and (got is None) == (region is None)


def test_region_of_random_pages():
    """The text of pages with and without a marked article against a search of all regions."""
    rng = random.Random(8)
    kinds = ["<p>{}</p>", "<div class=ad>{}</div>", "<nav>{}</nav>", "<div class=text>{}</div>", "<ul><li>{}</ul>", "<aside>{}</aside>"]
    weights = {".text": 1.5, ".ad": -2.0, "<li>": -0.7, "<p>": 0.9}
    for n in range(150):
        parts = [rng.choice(kinds).format(" ".join(f"w{n}x{i}y{j}" for j in range(rng.randrange(1, 20)))) for i in range(rng.randrange(1, 10))]
        if n % 2:
            a, b = sorted(rng.sample(range(len(parts) + 1), 2)) if len(parts) > 1 else (0, 1)
            parts[a:b] = ["<article>" + "".join(parts[a:b]) + "</article>"]
        page = "<body>" + "".join(parts) + "</body>"
        scorer, blocks = M.Scorer(weights), M.Page(page).blocks
        line = scorer.line(blocks)
        best, region = exhaustive(line)
        got = M.main_blocks(page, M.Scorer(weights))
        texts = [text for element, text, _ in blocks if scorer.word(element) > 0]
        assert set(got) <= set(texts)
        at = [i for i, (_, text, _) in enumerate(blocks) if text in got]
        assert (not at and region is None) or total(line, (at[0], at[-1])) == pytest.approx(best)


def test_deep_nesting_and_repeats(spark):
    deep = "<div class=a>" * 30_000 + "<p>Words at the bottom.</p>"
    rows = [(None, None, deep), (1, "u", deep), (1, "u", deep)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [(r.page_id, r.text) for r in M.extract(frame).orderBy("page_id").collect()] == [(i, "Words at the bottom.") for i in (None, 1, 1)]


@pytest.mark.parametrize("source", ["<b>" * 50_000 + "</i>" * 50_000, "<span>" * 50_000 + "<p>a</p>" * 50_000, "<div class=ad>" * 50_000 + "<p>a" * 50_000])
def test_many_open_elements(source):
    """Each tag takes constant time; walking all open elements for each would take hours here."""
    M.main_blocks(source, M.Scorer({".ad": -1.0}))
    assert sum(M.Page(source).votes()[1].values()) >= 0


def test_whole_query_by_brute_force(spark):
    """Weights counted block by block over all elements around, texts by a search of all regions."""
    rng = random.Random(4)
    kinds = ["<p>{}", "<div class='ad box'>{}</div>", "<nav>{}</nav>", "<div class=text>{}</div>", "<ul><li>{}</ul>", "<b>{}</i>", "<form>{}</form>", "<div class=related>{}</div>", "{}<br>"]
    html = [None, ""]
    for n in range(60):
        parts = [rng.choice(kinds).format(" ".join(f"w{n}x{i}y{j}" for j in range(rng.randrange(1, 20)))) for i in range(rng.randrange(1, 9))]
        if n % 2:
            a, b = sorted(rng.sample(range(len(parts) + 1), 2)) if len(parts) > 1 else (0, 1)
            parts[a:b] = [rng.choice(["<article>", "<div itemprop=articleBody>"]) + "".join(parts[a:b]) + "</div></article>"]
        html.append("<body>" + "".join(parts))
    inside, outside = {}, {}
    for source in html:
        if source and ("<article" in source or "articleBody" in source):
            for element, text, _ in M.Page(source).blocks:
                found, e = {"*"}, element
                while e is not None:
                    found |= set(e.features) if e.name not in ("html", "body") else set()
                    e = e.parent
                for f in found:
                    table = inside if element.inside else outside
                    table[f] = table.get(f, 0) + len(text.split())
    scale = (outside["*"] + 1) / (inside["*"] + 1)
    names = {f for f in inside.keys() | outside.keys() if f != "*" and inside.get(f, 0) + outside.get(f, 0) >= M.LEAST_WORDS}
    want = {f: math.log((inside.get(f, 0) * scale + M.SMOOTH) / (outside.get(f, 0) + M.SMOOTH)) for f in names}
    frame = spark.createDataFrame([(i, f"u{i}", h, "t", "f", "w", "i") for i, h in enumerate(html)], "page_id long, url string, html string, text string, feature string, words string, inside string").repartition(3)
    assert M.learn(frame) == pytest.approx(want)
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in M.extract(frame).collect()}
    for i, source in enumerate(html):
        scorer, blocks = M.Scorer(want), M.Page(source or "").blocks
        region = exhaustive(scorer.line(blocks))[1]
        text = "\n".join(t for e, t, _ in blocks[region[0] : region[1] + 1] if scorer.word(e) > 0) if region else ""
        assert got[i] == (f"u{i}", text, len(text))
