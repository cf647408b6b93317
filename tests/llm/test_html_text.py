"""Page text against plain regular expressions on the table's pages, and on made sites of
several layouts with known articles."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from docfetch.llm import html_text, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def of_article(page):
    """What the table's pages hold between article tags."""
    found = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    found = re.sub(r"<[a-z/][^>]*(>|$)", lambda m: " " if m[0].strip("</>") in ("p", "h1", "br") else "", found)
    return " ".join(html.unescape(found).split())


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = sorted(map(tuple, queries.QUERIES["op13_html_text"](spark, SF).collect()))
    texts = [of_article(r["html"]) for r in pages]
    assert got == sorted((r["page_id"], r["url"], t, len(t)) for r, t in zip(pages, texts))


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta,", "gamma.", "d&lt;e", "<b>zeta</b>", "eta<i>ta</i>", "&eacute;t&#233;", "漢字", "a &amp; b"])
                    for _ in range(n))


def paragraphs(rng):
    return [words(rng, rng.randrange(8, 60)) for _ in range(rng.randrange(2, 7))]


def clean(parts):
    return " ".join(" ".join(html.unescape(re.sub(r"</?[bi]>", "", p)).split()) for p in parts)


def news(rng, n):
    """Named parts around an article element; tags left open."""
    title, body = words(rng, 6), paragraphs(rng)
    page = (f"<html><head><title>x</title><script>if (a<b) '</p>'</script></head><body><header>The site</header>"
            f"<nav><ul><li><a href=/>Home<li><a href=/b>News</ul></nav><div class='cookie-notice'>We use cookies</div>"
            f"<main><article id=post-{n}><header><h1>{title}</h1></header>" + "".join(f"<p>{p}" for p in body[:1])
            + f"<div class='ad-slot'>{words(rng, 30)}</div>" + "".join(f"<p>{p}</p>\n" for p in body[1:])
            + f"<form><input name=q>Subscribe now</form></article><aside>{words(rng, 50)}</aside>"
            f"<section id='comments'><article class='comment'><p>{words(rng, 40)}</p></article></section></main>"
            f"<footer>&copy; site</footer></body></html>")
    return page, clean([title, *body])


def soup(rng, n):
    """Unnamed boxes: only the host's other pages tell which one is the article."""
    body = paragraphs(rng) if n % 4 else [words(rng, 9)]
    side = [words(rng, rng.randrange(5, 25)) for _ in range(2)]
    page = (f"<body><div class=box{n}><p>{side[0]}</p></div><div class='col c{n}'><div class='story-{n * 7}'>"
            + "".join(f"<p class=x{n}>{p}<br>" for p in body) + f"</div></div><div class=right><p>{side[1]}</p></div>")
    return page, clean(body)


def form_page(rng, n):
    """The whole page in a form, the article in table cells, a list in it."""
    title, body = words(rng, 5), paragraphs(rng)
    page = (f"<BODY><FORM id=aspnetForm><TABLE class=layout><TR><TD class=menu><A HREF=1>one</A><TD class=body><H1>{title}</H1>"
            + "".join(f"<UL><LI>{p}<LI>{p}</UL>" for p in body) + "</TABLE></FORM>")
    return page, clean([title, *(p for p in body for _ in range(2))])


@pytest.mark.parametrize("layout", [news, soup, form_page])
def test_sites(spark, layout):
    rng = random.Random(layout.__name__)
    made = [layout(rng, n) for n in range(60)]
    rows = [(i, f"https://user@{'WWW.' if i % 2 else 'www.'}{layout.__name__}.example:8080/p/{i}?q=1", page)
            for i, (page, _) in enumerate(made)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("host", "path", "text", "votes")})
    got = {r["page_id"]: r["text"] for r in html_text.extract(docs.repartition(4)).collect()}
    assert got == {i: text for i, (_, text) in enumerate(made)}


def test_votes(spark):
    """The winner is the path with most pages, whatever a large page says; others keep their own."""
    rng = random.Random(9)
    rows = [(i, "http://a.example/", soup(rng, 1)[0]) for i in range(9)]
    rows += [(9, "http://a.example/x", news(rng, 9)[0] * 3), (10, None, rows[0][2]), (11, "mailto:x", rows[0][2])]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("host", html_text.host_of(F.col("url")))
    assert [tuple(r) for r in html_text.winning_paths(pages).collect()] == [("a.example", "body/div.c0.col/div.story-0")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[10] == got[11] == got[0] and "漢字" in got[9]


def test_odd_pages(spark):
    cases = [(None, ""), ("", ""), (" \n ", ""), ("plain &amp text", "plain & text"), ("a < b <3 </>c", "a < b <3 </>c"),
             ("<p>one<!-- > <p>no --> two<!--", "one two"), ("<p>a<div class=ad", "a"), ("<p title='x>y'>in</p>", "in"),
             ("<p class=it's>a</p> don't <b>b</b>", "a don't b"), ("<script>" + "x" * 99, ""), ("<p>x&nbsp;&#8195;y\t\nz</p>", "x y z"),
             ("<title>t</title><p>b</p><textarea><p>no</textarea>", "b"), ("</p></div>x</article>", "x"),
             ("<nav><a>m</a><main><p>text of the page</main>", "text of the page"),
             ("<div><p>" + "word " * 100_000 + "</div>", ("word " * 100_000).strip()),
             ("<div>" * 3000 + "deep", "deep"), ("<a href=\"x" * 2000, ""), ("<" * 3000, "<" * 3000)]
    rows = [(i // 2 if i % 2 else None, "http://h.example/" if i % 3 else None, page) for i, (page, _) in enumerate(cases)]
    got = html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(((i, u, t, len(t)) for (i, u, _), (_, t) in zip(rows, cases)), key=key)
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0
