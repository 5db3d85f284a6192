from __future__ import annotations

import html
import re

from pagemill.llm import queries, templates

SF = "/root/testdata/sf0.01"


def plain(page):
    """Text of the one article of a given test page, read with patterns."""
    body = page.split("<article>")[1].split("</article>")[0]
    parts = re.split(r"</?(?:p|h1|br)\b[^>]*>", body)
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in parts]
    return " ".join(x for x in parts if x)


def test_given_pages(spark):
    got = {r.page_id: r for r in queries.op6_templates(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(plain(r.html))


def site(i, host="h.example"):
    menu = "<ul class=top><li>Home<li>About</ul><div class='box'><div>Our motto, on every page</div>"
    own = f"<h2>Title {i}</h2><div>First &amp; own {i}<br>line\n {i}</div><p>Second <b>own</b> {i}<p>Third {i}</div>"
    end = "<div>All rights kept</div><div id='comments'><p>nice</div><form>name <input></form><script>x='<p>no</p>'"
    return (i, f"http://{host}/{i}", f"<html><body><header>Site</header>{menu}{own}{end}")


def test_template_wording_goes_without_articles(spark):
    pages = spark.createDataFrame([site(i) for i in range(8)], "page_id long, url string, html string").withColumn("text", templates.F.lit(1))
    got = {r.page_id: r.text for r in templates.extract(pages).collect()}
    assert got == {i: f"Title {i} First & own {i} line {i} Second own {i} Third {i}" for i in range(8)}


def test_classes_share_vectors_and_nest(spark):
    rows = [(i, f"http://a/{i}", "<div><p>a</p><p>b</p>" + ("<ul><li>x</ul>" if i % 3 else "") + f"<i>{i}</i></div>") for i in range(9)]
    pages = spark.createDataFrame(rows + rows[:2], "page_id long, url string, html string")
    told = templates.classes(pages).toPandas()
    names = {templates._hash("tag", t): t for t in ("/div", "//div", "/div/p", "//div/p", "/div/ul", "//div/ul", "/div/ul/li")}
    groups = {frozenset(names[t] for t in g["token"] if t in names) for _, g in told.groupby("class")}
    assert frozenset({"/div/ul", "//div/ul", "/div/ul/li"}) in groups and {frozenset({"/div/p", "//div/p"}), frozenset({"/div", "//div"})} < groups
    template = templates.Template(*[told[c].to_numpy() for c in ("token", "class", "place", "everywhere")])
    roots = [k for k, p in template.parent.items() if p is None]
    assert len(roots) == 1 and templates._hash("tag", "/div") in template.members[roots[0]]
    flagged = [(s.block.text, s.fixed) for s in templates.slots(rows[1][2], template)]
    assert flagged == [("a", True), ("b", True), ("x", True), ("1", False)]


def text_of(page):
    return templates.main_text(page, templates._EMPTY)


def test_parts_and_broken_markup():
    assert text_of("<article>a<nav-menu>b</nav-menu><svg/>c<div class=ad-box>d</div><p>e<p>f</article>g<article>h</article>") == "a b c e f h"
    assert text_of("<main><header>T</header><aside>no</aside>x &lt;b&gt; &#00000065; &alpha;&nbsp;y</main><footer>z</footer>") == "T x <b> A α y"
    assert text_of("<p>a<!-- no <p> --><p>b<![CDATA[ no ]]>c<?php no ?>d") == "a bcd"
    assert text_of("<div " + " ".join(f"a{i}='>'" for i in range(300)) + ">x</div>") == "x"
    assert text_of("<table><tr><td>1<td>2<tr><td>3</table>") == "1 2 3"
    assert text_of("a<script>if (1 < 2) '</p>'</script>b<style>p{}</style>c<script>never closed") == "abc"
    assert text_of("<article>one<article>two</article>three</article>") == "one two three"
    assert text_of("<div role=navigation>m</div><div hidden>h</div>5 < 6 > 4 <<b>bold</b> <") == "5 < 6 > 4 <bold <"
    assert text_of("") == text_of("<a") == text_of("<!--") == "" and text_of("<") == "<"


def test_wrappers_and_names():
    assert text_of("<form id=aspnetForm><nav>m</nav><article>kept</article><input></form>") == "kept"
    assert text_of("<div class='layout has-sidebar'><article>kept</article></div>") == "kept"
    assert text_of("<div class=sidebar><div>x</div><article>kept</article></div>") == "kept"
    assert text_of("<form><h1>t</h1><p>all of the page stands in one form</p></form>") == "t all of the page stands in one form"
    assert text_of("<p>a page with text of its own</p><form>name <input></form>") == "a page with text of its own"
    assert text_of("<aside><article>teaser</article></aside><article>kept</article>") == "kept"
    inside = "<h2 id=legal-status>Legal</h2><section id=side-effects>side</section><p class=comment>said</p><p>see <a class=share>this</a> too</p><p id=copyright>c</p>"
    assert text_of(f"<article>{inside}</article>") == "Legal side said see this too c"
    apart = "<div class='share'>s</div><ul class='related-posts'><li>r</ul><div id=comments>c</div><div class='post ad'>a</div><div class='adapted'>kept</div>"
    assert text_of(f"<article>{apart}</article>") == "kept"


def test_unnamed_notice_in_articles_goes(spark):
    notice = "<div>Please share this article</div>"
    same = "<p>A line that many pages share.</p>"
    rows = [(i, f"http://h/{i}", f"<body><article>{notice if i < 9 else ''}<h1>T{i}</h1>{same if i % 4 else ''}<p>own {i}</p>{notice}</article></body>") for i in range(10)]
    few = [(100 + i, f"http://few/{i}", f"<article><p>all alike</p><p>{i}</p></article>") for i in range(5)]
    copies = [(200 + i, f"http://copies/{i}", "<article><p>one page under many names</p></article>") for i in range(30)]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows + few + copies, "page_id long, url string, html string").repartition(4)).collect()}
    assert [got[i] for i in range(9)] == [f"T{i} " + ("A line that many pages share. " if i % 4 else "") + f"own {i}" for i in range(9)]
    assert got[9] == "T9 A line that many pages share. own 9"
    assert all(got[100 + i] == f"all alike {i}" for i in range(5))
    assert {got[200 + i] for i in range(30)} == {"one page under many names"}


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>x</p>", 5, 6, 7, 8, 9)], "page_id long, url string, html string, _host int, _token int, host int, key int, `n.a` int")
    assert templates.extract(pages).first().text == "x" and templates.extract(pages).columns == [*pages.columns, "text", "n_chars"]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "not a url ::", "<p>x"), (None, "http://[bad", ""), (3, "http://a/", "<p>x" * 5000), (3, "http://a/", "<p>x" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_host_", templates.F.lit(1))
    got = templates.extract(pages)
    assert got.columns == ["page_id", "url", "html", "_host_", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 0), (1, 0), (2, 1), (3, 9999), (3, 9999)]
    assert templates.extract(pages.limit(0)).count() == 0
