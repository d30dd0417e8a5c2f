import re
from html import unescape

import pytest

from marlstone.llm import html

SCHEMA = "page_id long, url string, html string, host string, paths string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(2)


def texts(spark, rows):
    return {r.page_id: r for r in html.main_text(pages(spark, rows)).collect()}


def plain(source):
    """The article of the generated pages, by regular expressions."""
    inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|article)>", inner)
    return "\n".join(x for x in (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>|<[^>]*$", lambda m: " " if m[0] == "<br>" else "", b))).strip() for b in blocks) if x)


def test_generated_pages(spark):
    own = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in own.select("page_id", "html").collect()}
    got = {r.page_id: r for r in html.main_text(own).collect()}
    assert {k: r.text for k, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


LAYOUT = """<html><head><title>T &amp; x</title><script>if (a<b) document.write("<p>no</p>")</script></head><body>
<header class="site"><a href=/>Home</a><p>Site header text, with commas, and words enough to be prose.</p></header>
<div id="nav-main"><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></div>
<div class="wrap w12"><div class="post-body p{n}"><h2>Title {n}</h2><p>First  paragraph&nbsp;of page {n}, with caf&eacute; &#8212; and <em>in</em>line <a href=x>links</a>.
<p>Second paragraph, unclosed, says more about {n}.<div class="share-buttons">Share this now, please, everybody</div><ul><li>item a<li>item b</ul>
<blockquote>Quoted, at length, by somebody with something to say.</blockquote></div>
<div class="sidebar">Side notes that go on, and on, for long, with many, many, commas, to score well if kept.</div>
<section id="comments"><p>Reader: I disagree, strongly, with all of this, and here is why, in many words.</p></section></div>
<div class="cookie-notice">We use cookies, and so on, and so forth.</div><form><p>Subscribe to it, now, here.</p><input name=q></form><footer>&copy; us</footer></body></html>"""


def test_consensus_layout(spark):
    rows = [(n, f"https://News.example.org/{n}", LAYOUT.format(n=n)) for n in range(8)]
    odd = '<body><div class="wrap w9"><div class="post-body p77"><p>Short.</p></div><div class="extra"><p>A much longer block, with commas, and more commas, that would win on this page alone, if it were alone.</p></div></div>'
    got = texts(spark, [*rows, (100, "http://news.example.org:80/odd", odd)])
    for n in range(8):
        assert got[n].text == f"Title {n}\nFirst paragraph of page {n}, with café — and inline links.\nSecond paragraph, unclosed, says more about {n}.\nitem a\nitem b\nQuoted, at length, by somebody with something to say."
    assert got[100].text == "Short."


INSIDE = ["<div class='legal'>{}</div>", "<section id='related-work'><p>{}</p></section>", "<p class='side-effects'>{}</p>", "<div class='search'>{}</div>", "<p>a <span class='header'>{}</span></p>", "<blockquote class='reviews'>{}</blockquote>", "<div class='ad-hoc'>{}</div>", "<p><math>{}</math></p>", "<p><object>{}</object></p>", "<pre class='comment'>{}</pre>"]
FURNITURE = ["<div class='ad'>{}</div>", "<div class='share-buttons'>{}</div>", "<aside>{}</aside>", "<nav>{}</nav>", "<footer>{}</footer>", "<form>{}</form>", "<section id='comments'><p>{}</p></section>", "<ul class='related-links'><li>{}</ul>", "<div role='complementary'>{}</div>", "<div class='cookie-notice'>{}</div>", "<div hidden>{}</div>", "<script>{}</script>"]


@pytest.mark.parametrize(("part", "stays"), [(x, True) for x in INSIDE] + [(x, False) for x in FURNITURE])
def test_parts_of_an_article(part, stays):
    article = "<article><h1>On things</h1><p>A first paragraph, with some words, and commas.</p>" + part.format("these words here") + "<p>The last one, which ends it.</p></article>"
    assert ("these words here" in html.extract(html.read(f"<body>{article}</body>"), [])) is stays


@pytest.mark.parametrize("wrap", ["<div class='content-sidebar-wrap'>{}</div>", "<div class='layout has-sidebar'>{}</div>", "<div class='sidebar'>{}</div>", "<form id='aspnet'>{}</form>", "<div class='ad'><div class='footer'>{}</div></div>"])
def test_wrappers_of_the_article_are_no_furniture(wrap):
    for tag in ("article", "div"):
        body = f"<{tag}><p>The text itself, long enough, with commas, to be what the page is for.</p></{tag}>"
        assert html.extract(html.read(wrap.format(body)), []).startswith("The text itself")


def test_sibling_boxes_rare_templates_and_furniture_by_repetition(spark):
    """One host: an article in two boxes, a third of a page's prose that is the same on every page, four templates."""
    words = lambda n, k: ", ".join(f"w{n}x{i}" for i in range(k))
    same = "<div class='about'><p>" + words("same", 60) + "</p></div>"
    rows = [(n, f"http://h.org/{n}", f"<body><div class='wrap'><div class='intro'><p>{words(n, 30)}</p></div><div class='rest'><p>{words(n + 500, 40)}</p></div></div>{same}</body>") for n in range(20)]
    rows += [(100 + 10 * k + n, f"http://h.org/t{k}/{n}", f"<body><div class='kind{'abcd'[k]}'><p>{words(100 + 10 * k + n, 30)}</p></div>{same}</body>") for k in range(4) for n in range(6)]
    got = texts(spark, rows)
    for n in range(20):
        assert got[n].text == f"{words(n, 30)}\n{words(n + 500, 40)}"
    for n in [100 + 10 * k + i for k in range(4) for i in range(6)]:
        assert got[n].text == words(n, 30)


def test_ties_of_votes_go_to_the_smaller_path(spark):
    one = "<body><div class='b'><p>some words, here</p></div><section class='a'><p>some words, here</p></section></body>"
    assert texts(spark, [(1, "http://tie.org/", one)])[1].text == "some words, here\nsome words, here"  # siblings with as many votes
    apart = "<body><div><div class='z'><p>other words, here</p></div></div><section><section class='y'><p>other words, more</p></section></section></body>"
    page = html.read(apart)
    assert html.extract(page, [("div>div.z", 1.0), ("section>section.y", 1.0)]) == "other words, here"


def test_winners_by_brute_force(spark):
    """Votes, furniture and order of the winning paths, recounted page by page."""
    own = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    table = [(re.match(html.HOST, r.url)[1].lower(), html.read(r.html or "")) for r in own.collect()]
    want = {}
    for host in {h for h, _ in table}:
        mine, sums, seen = [p for h, p in table if h == host], {}, {}
        for page in mine:
            for path, vote in html.best(page):
                inside = html.within(page, {path})
                sums[path] = sums.get(path, 0) + vote
                seen.setdefault(path, []).append("\n".join(t for t, at, _ in page.blocks if inside[at]))
        won = [p for p in sums if len(seen[p]) >= html.STAPLE * len(mine) and not (len(seen[p]) >= html.SAME_PAGES and len(set(seen[p])) <= html.SAME_SHARE * len(seen[p]))]
        if won:
            want[host] = sorted(((p, round(sums[p], 6)) for p in won), key=lambda x: (-x[1], x[0]))
    from pyspark.sql import functions as F

    got = html.winners(own.select("html", F.lower(F.regexp_extract("url", html.HOST, 1)).alias("host"))).collect()
    assert {r.host: [(x["path"], x["vote"]) for x in r.ranked] for r in got} == want and want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""), ("", ""), ("no tags at all", "no tags at all"), ("<p>cut in a tag <b", "cut in a tag"), ("<p>a &amp b &unknown; &#x41;", "a & b &unknown; A"), ("1 < 2 <p>x</p>", "1 < 2\nx"),
        ("<article><h1>H</h1><header><p>by me</p></header><p>t</article>after", "H\nby me\nt"), ("<script>never ends <p>x", ""), ("<div><p>one</div></div></p></div><p>two", "one\ntwo"),
        ("<!-- <p>no</p> --><p>\n yes \t it is\n</p>", "yes it is"), ("<p hidden>no</p><p>yes</p>", "yes"),
    ],
)
def test_odd_pages(source, want):
    page = html.read(source or "")
    assert html.extract(page, []) == want or want == "one\ntwo" and html.extract(page, [("", 1.0)]) in (want, "one")


def test_edge_rows(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i}, long.</p>" for i in range(20000)) + "</article>"
    got = texts(spark, [(1, None, "<article><p>x y</p></article>"), (2, "nonsense", None), (None, "http://a.b/", "<p>q</p>"), (3, "http://a.b/", long)])
    assert got[1].text == "x y" and got[2].text == "" and got[2].n_chars == 0 and got[None].text == "q" and got[3].text.count("\n") == 19999
    twice = html.main_text(pages(spark, [(1, "http://c.d", "<p>z</p>")] * 2)).collect()
    assert [r.text for r in twice] == ["z", "z"]
    assert html.main_text(pages(spark, [])).count() == 0
