"""Main text of pages: markup cases by hand, pruning on a small site, the tables' articles."""

import html
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases

from rillflow.llm.sitetree import host_of, main_texts, op5_site_tree, walked


def text(page):
    return " ".join(t for _, t in walked(page))


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<b>b</b>c<br>d<p>e", "abc d e"),
    ("<nav>x</nav><article><h1>T</h1><p>a  \n b</p></article><footer>f</footer>", "T a b"),
    ("<script>var t='</p>'</script><style>p{}</style>a<!-- x > y -->b", "ab"), ("<div class='ad top'>x</div><div class=lead>y</div>", "y"),
    ("<title>t</title><p>a<script>x", "a"), ("<ul><li>a<li>b</ul>c", "a b c"), ("a <b class=x>b</b> <span class='ad'>no</span> c", "a b c"),
    ("<p>cut off <a hre", "cut off"), ("x < y and <3", "x < y and <3"), ("<section id=comments><p>me</p></section><p>z", "z"),
    ("<div hidden>x</div><div role=navigation>y</div>z", "z"), ("&am &lt;b&gt; &#233;&#x41;", "&am <b> éA"), ("</p></div><td>q</td>", "q"),
    ("<p title=\"a > b\">t</p>", "t"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("<form>f<p>g</p></form>h", "h"),
])
def test_markup(page, want):
    assert text(page) == want


def test_deep_and_long_pages():
    assert text("<div>" * 5000 + "a" + "</div>" * 5000 + "b") == "a b"
    assert text("<p>" + "x y " * 200_000 + "</p><" + "z" * 100_000).startswith("x y")


def test_host():
    assert [host_of(u) for u in ("http://A.b/c", "x://Y?z://q", "nothing", None, "http://h#f")] == ["a.b", "y", "", "", "h"]


def test_low_branches_of_a_site(spark):
    """An unnamed box with the same text on every page goes; the same box on a small site stays."""
    page = "<body><div class=box><p>the same on every page</p></div><div class=main><p>{}</p></div></body>"
    rows = [(i, "http://big.org/x", page.format(cases.words(20, i))) for i in range(60)]
    rows += [(100 + i, "http://small.org/x", page.format(cases.words(20, i))) for i in range(3)]
    rows += [(200 + i, "http://copies.org/x", "<p>only this</p>") for i in range(60)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == cases.words(20, i) for i in range(60))
    assert all(got[100 + i] == "the same on every page " + cases.words(20, i) for i in range(3))
    assert all(got[200 + i] == "only this" for i in range(60))


def test_edges(spark):
    schema = "page_id long, url string, html string, host string, path long, low string, text string"
    rows = [(1, None, None), (None, "u", "<p>a"), (2, "http://h/", ""), (2, "http://h/", ""), (3, "http://h/", "é " * 50_000)]
    got = main_texts(spark.createDataFrame([(*r, "h", 1, "l", "t") for r in rows], schema)).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", 0), ("2", 0), ("3", 99_999), ("None", 1)]
    assert main_texts(spark.createDataFrame([], schema)).count() == 0


def test_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op5_site_tree(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub("</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)
