"""Main text of pages: templates with known articles, odd pages, and the given pages against their own article element."""

import html
import os
import re

import pytest
from pyspark.sql import functions as F

from sievemark.llm import html_main
from sievemark.llm.html_main import Page, extract_main, host_paths

DATA = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def alone(source):
    return Page(source).extract(None)


@pytest.mark.parametrize(
    "source, text",
    [
        ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b <b>c</b>d<br>e", "a b cd e"),
        ("<article>x<script>var a = '</p>';</script><style>p{}</style><aside>no</aside><footer>no</footer>y</article>", "x y"),
        ("<body><header><h1>Site</h1></header><main><header><h1>T</h1></header><p>x<ul><li>a<li>b</ul></main><form>Name <p>much longer text in a form</form>", "T x a b"),
        ("<div id=sidebar>one two three</div><div class='post-12 entry'><p>text of it</p><div class=ad>buy</div></div><div class=cookieNotice>we use</div>", "text of it"),
        ("<article><p>said</p></article><section class=comments><article class=comment><p>a reader's much longer remark on it</p></article></section>", "said"),
        ("<div id=main><p>said of it</p><ol class=commentlist><li>a reader's longer remark</ol><div class='footerLinks'>x</div><p class=commented-on>no</p></div>", "said of it"),
        ("<body class='no-sidebar sidebar'><article>main</article></body>", "main"),
        ("<div class='page ads'><p>all of the text is here</p></div><div>x</div>", "all of the text is here"),
        ("x &lt;b&gt; &nbsp;&#65; &#x42 &amp y &am", "x <b> A B & y &am"), ("a<b>x</b> <!-- nev", "ax"), ("x < y and 3 > 2", "x < y and 3 > 2"), ("<!---->z<!-->y<!-- a --!>w<![CDATA[q]]><?p?>v", "zywv"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("</b></div>" * 9 + "t", "t"), ("<div role=navigation>menu</div>t", "t"),
    ],
)
def test_page(source, text):
    assert alone(source)[0] == text


@pytest.mark.parametrize("source", ["<a \"" * 50_000, "<a '\"> " * 50_000, "<div>" * 100_000 + "x", "<p><b>" * 50_000, "</b>" * 100_000, "<li>" * 50_000, "<!--" * 50_000, "<script>" * 50_000])
def test_hard_pages_take_time_by_length(source):
    import time

    t = time.process_time()
    Page(source).votes()
    assert time.process_time() - t < 20


def site(words, n, boxes):
    """A page whose article has no element of its own; boxes: boilerplate of more text than the article."""
    p = "".join(f"<p>{words} {k}</p>" for k in range(n))
    return f"<div class=top>{boxes}</div><div class='body-{n}'><div class=text>{p}</div></div>"


def test_consensus_of_host(spark):
    rows = [(i, "http://user@A.example:80/x", site("some words of an article", 6, "")) for i in range(9)]
    # Here a list beside it has more text, as on no other page of the host; alone the page would choose it.
    odd = site("few words here", 3, "<p>much more text than the article on this page has</p>" * 2)
    rows += [(9, "https://a.example/y", odd), (10, "https://other.example", odd), (11, None, None), (12, "x", "<div><p>t</p></div>"), (12, "x", "<div><p>t</p></div>")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"host": F.lit(1), "key": F.lit(2), "path": F.lit(3)})
    paths = {r.host: r for r in host_paths(df).collect()}
    assert paths["a.example"].path == "div.body-#/div.text" and set(paths) == {"a.example", "other.example", ""}
    got = [(r.page_id, r.text) for r in extract_main(df).orderBy("page_id").collect()]
    assert got[9] == (9, "few words here 0 few words here 1 few words here 2") and got[10][1].startswith("much more") and got[11:] == [(11, ""), (12, "t"), (12, "t")]
    assert extract_main(df.limit(0)).count() == 0
    # Over FOREIGN times the text of the host's path: another template.
    far = spark.createDataFrame([*rows[:9], (9, "http://a.example", site("few", 1, "<p>much more text than the article on this page has</p>" * 9))], SCHEMA)
    assert extract_main(far).where("page_id = 9").first().text.startswith("much more")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_given_pages(spark):
    """Their articles are in an article element with h1, p, b and br only."""
    got = {r.page_id: r for r in html_main.op11_html_main(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(rows) == len(got)
    for r in rows:
        inner = re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1]))
        text = " ".join(html.unescape(inner).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (text, len(text))
