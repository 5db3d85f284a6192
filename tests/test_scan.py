from __future__ import annotations

import random

import pytest

from pagemill.operators import html, scan

LONG = "Plain words that tell of something at length. " * 4

CASES = {
    "menu between articles": ("<article>one</article><nav>MENU</nav><aside>AD</aside><article>two</article>", "one\n\ntwo"),
    "text between articles stays": ("<article>one</article><p>bridge</p><article>two</article>", "one\n\nbridge\n\ntwo"),
    "head without an end": ("<html><head><title>x</title><body><p>text</p>", "text"),
    "head without end or body": ("<head><meta charset=x><title>x</title><p>text", "text"),
    "title without an end": ("<html><head><title>x<body><p>text", "text"),
    "form without an end": ("<p>a</p><form action=/x><p>b</p><div>c</div><p>d", "a\n\nb\n\nc\n\nd"),
    "form with an end": (f"<p>{LONG}</p><form action=/x><p>b</p></form><p>d", f"{LONG.strip()}\n\nd"),
    "page in one form": ("<form id=aspnetForm><div><p>all</p></div></form>", "all"),
    "article in a form": ("<form><nav>m</nav><article>kept</article></form>", "kept"),
    "article in a footer": ("<footer><article>kept</article></footer>", "kept"),
    "menu without an end": ("<nav><p>a</p><article>b</article>", "b"),
    "menu of links": (f"<div><a href=/1>one page</a><a href=/2>two page</a><a href=/3>three</a></div><p>{LONG}</p>", LONG.strip()),
    "links in an article stay": ("<article><ul><li><a href=/1>a</a><li><a href=/2>b</a><li><a href=/3>c</a></ul></article>", "* [a](/1)\n* [b](/2)\n* [c](/3)"),
    "header outside and inside": ("<header>h</header><article><header><h1>T</h1></header>x<footer>f</footer></article>", "# T\n\nx"),
    "optional end tags": ("<main><ul><li>a<li>b<p>c</ul><dl><dt>d<dd>e</dl><p>f<p>g", "* a\n* b\n\nc\n\nd\n\ne\n\nf\n\ng"),
    "stray end tags": ("<main></div></b>a</span></p>b</main>", "ab"),
    "overlapping": ("<main><b>a<i>b</b>c</i>d</main>", "**ab**cd"),
    "bold over blocks": ("<main><b><p>a</p><p>b</p></b></main>", "a\n\nb"),
    "cell ends stay in their table": ("<main><table><tr><td>a<table><tr><td>b</td></tr></table>c</td><td>d</td></tr></table></main>", "| a\n\n| b |\n\nc | d |"),
    "raw to the end": ("<p>seen</p><style>p{}<p>no", "seen"),
    "unseen without an end": ("<p>a<svg><p>b", "a\n\nb"),
    "unseen with an end": ("<p>a<svg><text>no</text></svg><noscript>no</noscript><picture><source><img alt=no></picture>b", "ab"),
    "quoted marks": ("<main><a title='a > b' href=\"/x>y\">t</a></main>", "[t](/x>y)"),
    "slash after a value": ("<main><a href=/x/>t</a> <br/>u</main>", "[t](/x/)   \nu"),
    "links without text": ("<main><a href=/x><img src=y></a>a<a name=n>b</a></main>", "ab"),
    "comments": ("<main>a<!-- <p>no --> b<!-- never ended <p>c", "a b"),
    "cut tag": ("<main>a <a hre", "a"),
    "numbered": ("<main>&#00000065;&#x42;&amp;lt;</main>", "AB&lt;"),
    "empty heading": ("<main><h2></h2><p>a", "##\n\na"),
    "nothing": ("<body><nav>only</nav></body>", None),
    "empty": ("", None),
    "null": (None, None),
}


def test_main_content_cases(spark):
    pages = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "url string, html string")
    got = {r.url: r.markdown for r in html.main_content_markdown(pages).collect()}
    for name, (_, want) in CASES.items():
        cleaned = "\n".join(line.rstrip() if not line.endswith("  ") else line for line in got[name].split("\n")) if got[name] else got[name]
        assert cleaned == want, name


def test_many_attributes_and_deep_nesting():
    many = " ".join(f"d{i}='>'" for i in range(300))
    assert "kept" in scan.marked_content(f"<article {many}><p {many}>kept</article>")
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert "deep" in scan.marked_content(deep) and "deep" in scan.marked_content("<div>" * 20_000 + "deep")


@pytest.mark.parametrize("seed", range(3))
def test_any_markup_is_survived(seed):
    rng = random.Random(seed)
    names = ["p", "div", "li", "ul", "table", "tr", "td", "b", "a", "article", "form", "head", "title", "pre", "code", "script", "nav", "h2", "br"]
    for _ in range(300):
        pieces = ["".join(rng.choice(["<", "</"]) + rng.choice(names) + rng.choice(["", " href='x", " a=\"b\"", "/"]) + rng.choice([">", ">", ""])) + rng.choice(["", "t", " \n", "&am"]) for _ in range(30)]
        found, parts = scan.elements("".join(pieces))
        assert all(e.first <= e.last <= len(parts) for e in found) and all(0 <= i < len(found) for i, _ in parts)
        assert isinstance(scan.marked_content("".join(pieces)), str)


def test_every_word_outside_furniture_stays():
    rng = random.Random(9)
    for _ in range(200):
        words = [f"w{i}" for i in range(40)]
        page = "".join(rng.choice(["<p>", "<div>", "</div>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<td>", "<h2>", "</h2>", "<pre>", "</pre>", " "]) + w for w in words)
        out = scan.marked_content(page)
        assert all(w in out for w in words)
