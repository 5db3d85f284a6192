from __future__ import annotations

import itertools
from urllib.parse import urljoin

from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators import html


def page(spark, body: str, url: str = "http://ex.com/docs/a/b.html"):
    return spark.createDataFrame([(url, body)], "url string, html string")


def metadata(spark, head: str, attrs: str = "") -> dict:
    row = html.extract_metadata(page(spark, f"<html{attrs}><head>{head}</head><body></body></html>")).first()
    return {k: v for k, v in row.metadata.asDict().items() if v is not None}


def test_metadata_fields(spark):
    found = metadata(
        spark,
        """<title> A &amp; B&#8217;s </title><meta name="description" content="first"><meta name="description" content="x > y">
        <meta content=k name=keywords><meta property='og:title' content=T><meta property="og:url" content="">
        <meta name="description2" property="og:image" content="i"><meta name="keywords" property="og:description" content="not og">
        <!-- <meta name="keywords" content="hidden"> --><script>'<meta name="keywords" content="script">'</script>
        <link rel="stylesheet" href="s.css"><link rel="shortcut icon" href="../f.ico"><link rel=icon href=late.ico>""",
        " lang='en'",
    )
    assert found == {
        "source_url": "http://ex.com/docs/a/b.html", "title": "A & B’s", "description": "x > y", "keywords": "not og",
        "language": "en", "og_title": "T", "og_url": "", "og_image": "i", "favicon": "http://ex.com/docs/f.ico",
    }


def test_metadata_gaps(spark):
    assert metadata(spark, '<meta property="og:title" content="O"><title></title>')["title"] == "O"
    late_without_content = metadata(spark, '<meta name="description" content="a"><meta name="description">')
    assert "description" not in late_without_content
    assert "favicon" not in metadata(spark, '<link rel="icon"><link rel="icon" href="/x.ico">')
    assert metadata(spark, "", ' lang=""') == {"source_url": "http://ex.com/docs/a/b.html"}


def test_links_in_document_order(spark):
    body = """<a href="/x?q=1&amp;r=2#z">1</a><!-- <a href="/no">n</a> --><a name=n>no</a><A HREF='y'>2</A>
    <script>"<a href='/no'>"</script><a class="a>b" href=//h2/p>3</a><a href="mailto:a@b">4</a><a href="">5</a>"""
    got = [(r.pos, r.href, r.abs_url) for r in html.extract_links(page(spark, body)).orderBy("pos").collect()]
    assert got == [
        (0, "/x?q=1&r=2#z", "http://ex.com/x?q=1&r=2"), (1, "y", "http://ex.com/docs/a/y"), (2, "//h2/p", "http://h2/p"),
        (3, "mailto:a@b", "mailto:a@b"), (4, "", "http://ex.com/docs/a/b.html"),
    ]


def test_urls_resolve_as_the_standard_library_does(spark):
    bases = ["http://h.com/a/b/c?x=1#f", "https://h.com", "http://h.com/", "http://h.com/a/b/", "http://u:p@h.com:8080/a//b/c"]
    heads = ["", "/", "./", "../", "../../../", "?q=2", "#frag", "//o.com/", "https://o.com/", "http://o.com/", "mailto:", "javascript:"]
    tails = ["", "x", "x/y", "..", ".", "x/./y/..", "a b", "é/ü", "x;p=1", "x?y#z", "a//b", "x..y/.z"]
    rows = [(b, h + t) for b, (h, t) in itertools.product(bases, itertools.product(heads, tails))]
    df = spark.createDataFrame(rows, "b string, h string")
    for r in df.withColumn("r", urls.resolve_url(F.col("b"), F.col("h"))).collect():
        want = urljoin(r.b, r.h).split("#")[0]
        assert r.r == want or (r.r, r.h[-1:]) == (want + "?", "?"), (r.b, r.h)


def test_same_host_compares_as_written(spark):
    rows = [
        ("http://a.com/x", "https://a.com/y", True), ("http://a.com", "http://a.com:80/", False), ("http://a.com", "http://www.a.com", False),
        ("http://a.com", "http://A.com", False), ("http://a.com", "mailto:x@a.com", False), ("http://é.com/ x", "http://é.com/y z", True),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    kept = {(r.a, r.b) for r in html.same_domain(df, "a", "b").collect()}
    assert kept == {(a, b) for a, b, want in rows if want}


def markdown(spark, body: str):
    return html.main_content_markdown(page(spark, body)).first().markdown


def test_main_content(spark):
    assert markdown(spark, "<body><nav>n</nav><main><h2>Hi <em>you</em></h2><p>a_b * c <b>bold <i>it</i> </b>d</p></main></body>") == (
        "## Hi *you*\n\na\\_b \\* c **bold *it*** d"
    )
    code = markdown(spark, "<article><p>x</p><pre><code class=py>def f(a):\n    return a*2  # c &lt; d</code></pre><p><code>a_b</code></p></article>")
    assert code == "x\n\n```\ndef f(a):\n    return a*2  # c < d\n```\n\n`a_b`"
    assert markdown(spark, '<article><ul><li>one</li><li><a href="/x">t<span>w</span>o</a></li></ul>a<br>b</article>') == "* one\n* [two](/x)\n\na  \nb"
    assert markdown(spark, '<article><script>var t="</p></article>";</script><p># not a header</p><p>cut &am') == "\\# not a header\n\ncut &am"
    assert markdown(spark, "<body><header>h</header><p>body <b>unclosed <p>text</p><footer>f</footer></body>") == "body unclosed\n\ntext"
    listed = "<main><ol><li>one</li>\n  <li>two</li></ol><ol><li>a<ul><li>b</li></ul></li></ol><p>x</p></main>"
    assert markdown(spark, listed) == "1. one\n2. two\n\n* a\n\n* b\n\nx"
    table = "<main><table><tr><th>a</th><th>b</th></tr>\n<tr><td>1</td><td>2 <i>x</i></td></tr></table>end</main>"
    assert markdown(spark, table) == "| a | b |\n| --- | --- |\n| 1 | 2 *x* |\n\nend"
    assert markdown(spark, "<body><nav>only</nav></body>") is None


def test_documents_drop_failed_and_empty_pages(spark):
    rows = [("http://a/1", "<main>x</main>", 200), ("http://a/2", "<main>y</main>", 404), ("http://a/3", "<nav>z</nav>", 200)]
    docs = html.pages_to_documents(spark.createDataFrame(rows, "url string, html string, status int"))
    assert [(r.url, r.markdown) for r in docs.collect()] == [("http://a/1", "x")] and "html" not in docs.columns


def test_unusual_markup_loses_nothing(spark):
    cases = {
        "many": "<a " + " ".join(f"d{i}='>'" for i in range(5000)) + " href='/far'>x</a><a href=/ok>y</a>",
        "articles": "<body>out<article>one<article>inner</article>tail</article><article>two</article>out</body>",
        "names": "<nav-menu>menu</nav-menu><p>kept</p><form-field>f</form-field>",
        "selfclosed": "<p>a</p><svg/><p>b</p><noscript/>c",
        "unclosed": "<p>before</p><form action='/x'><p>after</p>",
        "raw": "<p>seen</p><script>never closed <p>no</p>",
    }
    pages = spark.createDataFrame([(f"http://h/{k}", v) for k, v in cases.items()], "url string, html string")
    got = {r.url[9:]: r.markdown for r in html.main_content_markdown(pages).collect()}
    for name, words in {"articles": ["one", "inner", "tail", "two"], "names": ["menu", "kept", "f"], "selfclosed": ["a", "b", "c"], "unclosed": ["before", "after"], "raw": ["seen"]}.items():
        assert all(w in got[name] for w in words), (name, got[name])
    assert got["articles"].count("out") == 0 and "no" not in got["raw"]
    links = [r.href for r in html.extract_links(pages.filter("url = 'http://h/many'")).orderBy("pos").collect()]
    assert links == ["/far", "/ok"]


def test_pages_that_are_no_text_or_badly_encoded(spark):
    rows = spark.sql("select * from values (1, cast(null as string)), (2, ''), (3, cast(x'3C703E41FF42E4BD3C2F703E' as string)) as t(id, html)")
    found = dict(html.main_content_markdown(rows).select("id", "markdown").collect())
    assert found == {1: None, 2: None, 3: "A\ufffdB\ufffd"}
