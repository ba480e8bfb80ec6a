"""Main text of pages: against a plain reading of the given pages, and on sites whose true text is known."""

from __future__ import annotations

import html
import random
import re

import pytest

from tillwise.llm import extraction, markup
from tillwise.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def test_query_equals_a_plain_reading(spark):
    """The given pages have one article each, some cut off; its text is what tags leave."""
    got = {r.page_id: r for r in QUERIES["op11_html_extraction"](spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page.html, re.S)
        plain = " ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", article[1])).split()) if article else ""
        assert (got[page.page_id].text, got[page.page_id].n_chars, got[page.page_id].url) == (plain, len(plain), page.url)


def soup(rng, i):
    """A page without telling elements or class names: everything but the article recurs or is a list of links."""
    words = lambda n: " ".join(rng.choice("red green blue sun moon tree river stone cloud wind".split()) + str(rng.randint(0, 99)) for _ in range(n))
    paragraphs = [words(rng.randint(5, 40)) for _ in range(rng.randint(1, 5))]
    title = words(4)
    links = "".join(f"<li><a href='/{rng.random()}'>{words(2)}</a></li>" for _ in range(4))
    page = (
        "<html><head><title>T</title></head><body><div id=top>Welcome to the site of stones</div>"
        f"<div><ul>{links}</ul></div><div class=x1><h1>{title}</h1><div>Written by {words(1)} for us</div>"
        + "".join(f"<p>{p}</p>" for p in paragraphs)
        + "</div><div>All rights reserved by the people of the site</div></body></html>"
    )
    by = re.search(r"Written by (\S+)", page)[1]
    return page, " ".join([title, by, *paragraphs])


def test_template_of_a_site_without_telling_names(spark):
    rng = random.Random(2)
    made = [soup(rng, i) for i in range(30)]
    rows = [(i, f"http://Soup.example/{i}", page) for i, (page, _) in enumerate(made)]
    cut = rows[3][2][: rows[3][2].index("Written by")]
    rows.append((100, "//soup.example:8080/cut", cut))
    got = {r.page_id: r for r in extraction.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert [got[i].text for i in range(30)] == [text for _, text in made]
    assert got[100].text == " ".join(made[3][1].split()[:4]) and got[100].host == "soup.example"
    # The same pages on a host of their own each: no template, so that all but the links could be text.
    alone = spark.createDataFrame([(i, f"http://{i}.example/", page) for i, (page, _) in enumerate(made)], SCHEMA)
    assert all("rights reserved" in r.text and r.n_tags == 0 for r in extraction.extract(alone).collect())


def test_copies_of_one_page_keep_their_text(spark):
    page = "<html><body><nav>Menu</nav><article><h1>Title here</h1><p>Some text.</p></article></body></html>"
    rows = [(i, "http://copies.example/", page) for i in range(9)]
    assert {r.text for r in extraction.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"Title here Some text."}


PARTS = [
    ("<p>a<b>b</b>c</p>", "abc"),
    ("<p>one<p>two<br>three<li>four<li>five", "one two three four five"),
    ("<p>x &lt;y&gt; &amp;amp; &#233;&#x1F92F; &am</p>", "x <y> &amp; é🤯 &am"),
    ("<p> many \n\t blanks&nbsp;here </p>", "many blanks here"),
    ("<script>var t='<p>no</p>';</script><style>p{}</style><p>yes</p>", "yes"),
    ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
    ("<div class='ad-box'>no <div>no</div></div><p>yes</p>", "yes"),
    ("<div id=cookieNotice>no</div><aside>no</aside><form><p>no</form><p>yes", "yes"),
    ("<section class='comments'><article class=comment>no</article></section><p>yes", "yes"),
    ("<div class='no-sidebar'><p>yes</p></div>", "yes"),
    ("<p>a < b and c > d</p>", "a < b and c > d"),
    ("<p title='a > b' hidden=x>no</p><p title=\"it's > that\">yes</p>", "yes"),
    ("<header><h1>Title</h1><p>by me</p></header><p>yes</p>", "Title yes"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("</div></p>stray ends</span>", "stray ends"),
    ("<p>text <img alt='no' src=x/> more <a href=x>link</a>.</p><p", "text more link."),
    ("<svg><text>no</text></svg><iframe>no</iframe><p>yes</p>", "yes"),
]


@pytest.mark.parametrize("part, text", PARTS)
def test_what_is_read_of_an_article(part, text):
    page = f"<html><body><header>no</header><main><article>{part}</article></main><footer>no</footer></body></html>"
    if part.endswith(("open", "<p")):
        page = page[: page.index("</article>")]
    assert " ".join(extraction.main_words(markup.Reader().events(page), (set(), {}))) == text


def test_classes_out_of_order_or_crossing_are_broken():
    walk = extraction.Walk([(1, 0, 10), (1, 1, 11), (2, 0, 20), (2, 1, 21)])
    assert walk.broken([10, 20, 21, 20, 21, 11]) == set()
    assert walk.broken([10, 20, 11, 21]) != set()
    assert walk.broken([11, 10, 20, 21]) >= {1}
    assert walk.broken([10, 20, 21]) == {1}


def test_odd_rows_and_empty_tables(spark):
    long = "<html><body><article>" + "<p>word</p>" * 50_000 + "</article></body></html>"
    rows = [(1, None, None), (2, "", ""), (None, "x", "plain text"), (4, "http://h/", "<"), (4, "http://h/", "<"),
            (5, "http://h/", long), (6, "http://h/", "<div><div><b></p>" * 300), (7, "http://h/", "a\0b <p>c")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], f"{SCHEMA}, host string, text string")
    got = sorted((r.page_id or 0, r.text) for r in extraction.extract(df).collect())
    assert got == sorted(
        [(1, ""), (2, ""), (0, "plain text"), (4, "<"), (4, "<"), (5, " ".join(["word"] * 50_000)), (6, ""), (7, "a\0b c")]
    )
    assert extraction.extract(df.limit(0)).count() == 0
