"""Main text of pages by the template that pages of a host share.

Tokens (tags by their path, and text blocks by path and wording) that occur
equally often on each page of a host form an equivalence class.  Occurrence vectors are
never gathered: each token's vector is summed into a signature, page by page,
so a host of any size is an aggregate.  Classes on most pages whose tokens keep
one order are valid; nested by their places they make the host's template.
Wording of the template is not a page's own; what fills its slots is, unless a
slot stands where pages keep menus, headers, footers, notices, adverts, forms or comments.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.scale import join_dimension, stage, unused

MIN_PAGES = 3  # pages that a class must span to be a template of its host
EVERY = 6  # pages of a host from which wording that all have is no page's own, wherever it stands

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
} | {b: {"p"} for b in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}

# What a part of a page is, by element, role, class and id.
APART = frozenset("head nav footer aside script style noscript template iframe object svg canvas select button textarea dialog menu".split())
WRAPPERS = frozenset(("form", "header"))  # set apart, unless what they hold says otherwise
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
# Whole class names, or ids, of furniture; a part of a longer name says nothing.
_APART_NAMES = re.compile(
    r"ads?|advert(?:s|isement|isements|ising)?|adsense|ad[-_]?(?:box|banner|unit|slot|container|wrapper|block)|(?:top|site|page)?[-_]?banner|sponsor(?:ed|s)?|"
    r"promos?|promotion|side[-_]?bars?(?:[-_](?:left|right|\d+))?|widgets?|widget[-_]area|nav|nav[-_]?bar|navigation|(?:main|top|site|side)[-_]?(?:nav|menu)|menus?|"
    r"breadcrumbs?|(?:site|page)?[-_]?footer|(?:site|page)[-_]?header|masthead|cookies?(?:[-_](?:banner|notice|consent|bar|law))?|consent|notices?|gdpr|popup|modal|"
    r"newsletter(?:[-_](?:form|box|signup))?|subscribe|sign[-_]?up|comments?(?:[-_](?:list|area|section|form|thread))?|disqus(?:_thread)?|respond|replies|"
    r"share|sharing|(?:share|social)[-_](?:bar|box|buttons?|links?|icons?|media|share)|social|related(?:[-_](?:posts|articles|links|content))?|recommend(?:ed|ations?)|"
    r"pagination|pager|toolbar|skip(?:[-_]?(?:link|nav|to[-_]content))?|login|search(?:[-_]?(?:form|box|bar))?|legal|copyright",
    re.I,
)
_NEVER_NAMED = INLINE | frozenset("html body main article p h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"<(?:!--|!|\?|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTE = re.compile(r"""\s*/?\s*([^\s=>/"'][^\s=>/]*)?(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?|\s*["'/=]""")
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    """A run of text between block tags: path of tags, whether a part set apart encloses it, whether an article does, text."""

    path: str
    apart: bool
    inside: bool
    text: str


@dataclass(slots=True)
class _Part:
    """A part that may be set apart: unless it holds an article or, if a form, most of the page's text."""

    name: str
    always: bool
    holds: bool = False
    chars: int = 0


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes of a tag from ``at``, the place after its end, and whether it closes itself."""
    out: dict[str, str] = {}
    while at < len(page) and page[at] != ">":
        found = _ATTRIBUTE.match(page, at)
        if not found or found.end() == at:
            at += 1
            continue
        if found[1]:
            out.setdefault(found[1].lower(), next((v for v in found.groups()[1:] if v is not None), ""))
        at = found.end()
    return out, min(at + 1, len(page)), page[at - 1 : at] == "/"


def _part(name: str, attributes: dict[str, str], inside: bool) -> _Part | None:
    """The part that an element makes, if it is of a kind that pages set apart."""
    if name in WRAPPERS:
        return None if name == "header" and inside else _Part(name, False)
    if name in APART or attributes.get("role", "").lower() in ROLES:
        return _Part(name, True)
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return _Part(name, True)
    if name in _NEVER_NAMED or name == "section" and inside or not ("class" in attributes or "id" in attributes):
        return None
    named = (*attributes.get("class", "").split(), attributes.get("id", "").strip())
    return _Part(name, False) if any(_APART_NAMES.fullmatch(n) for n in named) else None


def parse(page: str) -> list[str | Block]:
    """Tag tokens (paths) and text blocks of a page, in order.

    One pass with a stack of open elements: an element ends at its end tag, at
    that of an element about it, at a sibling that closes it (as ``p`` or ``li``), or with the page.
    A header inside an article or main part belongs to it.  Whether a part is set
    apart is known when the page has been read: a form, a header and an element of
    a telling name are not, if they hold an article or main part, nor is a form
    that holds most of the text outside other such parts.
    """
    out: list[str | Block] = []
    stack: list[tuple[str, str, tuple[int, ...], bool]] = []  # name, path, parts about it, inside an article
    parts: list[_Part] = []
    said: list[str] = []
    where: tuple[str, tuple[int, ...], bool] = ("", (), False)

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(said))).strip()
        said.clear()
        if text:
            out.append(Block(*where, text))

    def now() -> tuple[str, tuple[int, ...], bool]:
        return stack[-1][1:] if stack else ("", (), False)

    def text(part: str) -> None:
        nonlocal where
        if part:
            if said and now()[1:] != where[1:]:
                flush()
            if not said:
                where = now()
            said.append(part)

    at = 0
    while True:
        found = _TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        closing, name = found[1], found[2]
        if name is None:
            if page.startswith("<!--", found.start()):
                end = page.find("-->", found.end() - 2)
                at = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", found.end())
                at = len(page) if end < 0 else end + 1
            continue
        name = name.lower()
        attributes, at, empty = _attributes(page, found.end())
        if name not in INLINE and name not in RAW:
            flush()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name in INLINE and any(e[0] not in INLINE for e in stack[depth + 1 :]):
                        break
                    if name not in INLINE:
                        out.append(f"/{stack[depth][1]}")
                    del stack[depth:]
                    break
            continue
        closed = CLOSED_BY.get(name, ())
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in closed:
                del stack[depth:]
                break
            if stack[depth][0] not in INLINE and stack[depth][0] != "p":
                break
        path, within, inside = now()
        label = name + "".join(f".{c}" for c in sorted(attributes.get("class", "").split())) + (f"#{i}" if (i := attributes.get("id", "")) and not re.search(r"\d", i) else "")
        path = f"{path}/{label}" if name not in INLINE else path
        if name not in INLINE:
            out.append(path)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if not empty:
                at = len(page) if not end else end.start()
                if end:
                    at = page.find(">", at) + 1 or len(page)
            continue
        if name in VOID or empty and name not in ("p", "div", "span", "a"):
            continue
        main = name in ("article", "main") or attributes.get("role") == "main"
        if main:
            for i in within:
                parts[i].holds = True
        elif (own := _part(name, attributes, inside)) is not None:
            within = (*within, len(parts))
            parts.append(own)
        stack.append((name, path, within, inside or main))
    flush()
    return _judged(out, parts)


def _judged(events: list, parts: list[_Part]) -> list[str | Block]:
    """The events, blocks knowing whether they are set apart."""
    total = 0
    for e in events:
        if not isinstance(e, str) and all(parts[i].name == "form" for i in e.apart):
            total += len(e.text)
            for i in e.apart:
                parts[i].chars += len(e.text)
    gone = [p.always or not p.holds and not (p.name == "form" and 2 * p.chars > total) for p in parts]
    return [e if isinstance(e, str) else e._replace(apart=any(gone[i] for i in e.apart)) for e in events]


def host_of(url: Column) -> Column:
    """Host that a URL names, lower-cased; empty for a null or bad one."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]*)", 1)), F.lit(""))


def _hash(kind: str, *parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join((kind, *parts))) >> 1


def tokens(events: list[str | Block]) -> list[int]:
    """Token of each event: a tag's path, or a block's path and wording."""
    return [_hash("tag", e) if isinstance(e, str) else _hash("text", e.path, e.text) for e in events]


def classes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Equivalence classes that are on most pages of their host: rows (host, token, class, place).

    A token's occurrence vector over the pages of its host is summed up as its
    number of pages and two sums of hashes of (page, occurrences), equal for
    equal vectors; a class is the tokens of a host that share all three.  Only
    tokens on MIN_PAGES pages and more than half of the host's are kept, so a
    host has at most twice as many as a page has on average.  ``place`` is the mean
    place of the first occurrence, ``everywhere`` whether all of EVERY or more pages have
    the token.  Pages of a host with one html are one page.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = _distinct_pages(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[tuple[str, int], list[int]] = {}
            for host, u, h in zip(batch["host"], batch["url"], batch["html"]):
                page = _hash("page", u, h)
                ids, first, n = np.unique(np.array(tokens(parse(h)), np.int64), return_index=True, return_counts=True)
                for token, place, times in [(0, 0, 1), *zip(ids.tolist(), first.tolist(), n.tolist())]:
                    mark = _hash("seen", str(page), str(times))
                    sums = held.setdefault((host, token), [0, 0, 0, 0])
                    for j, x in enumerate((1, mark & 0x7FFFFFFF, mark >> 32, place)):
                        sums[j] += x
            if held:
                yield pd.DataFrame([(*k, *v) for k, v in held.items()], columns=["host", "token", "pages", "low", "high", "places"])

    part = rows.mapInPandas(run, "host string, token long, pages long, low long, high long, places long")
    sums = [F.sum(c).alias(c) for c in ("pages", "low", "high", "places")]
    vectors = stage(part.groupBy("host", "token").agg(*sums).filter(F.col("pages") >= MIN_PAGES), "token-vectors")
    hosts = vectors.filter("token = 0").select("host", F.col("pages").alias("host_pages"))
    often = join_dimension(vectors.filter("token != 0"), hosts, ["host"]).filter(2 * F.col("pages") > F.col("host_pages"))
    signature = F.xxhash64("pages", "low", "high")
    everywhere = (F.col("pages") == F.col("host_pages")) & (F.col("pages") >= EVERY)
    return often.select("host", "token", signature.alias("class"), (F.col("places") / F.col("pages")).alias("place"), everywhere.alias("everywhere"))


def _distinct_pages(rows: DataFrame) -> DataFrame:
    """(host, url, html) less pages whose html another url of the host has; only hashes are shuffled."""
    keyed = rows.withColumn("key", F.xxhash64("html"))
    again = keyed.groupBy("host", "key").agg(F.min("url").alias("first"), F.max("url").alias("last")).filter("first <> last").drop("last")
    met = join_dimension(keyed, stage(again, "copied-pages"), ["host", "key"], "left")
    return met.filter(F.col("first").isNull() | (F.col("first") == F.col("url"))).select("host", "url", "html")


class Template:
    """Classes of one host: tokens in order of place, and for each class the one it is nested in."""

    def __init__(self, token: np.ndarray, kind: np.ndarray, place: np.ndarray, everywhere: np.ndarray):
        order = np.lexsort((token, place))
        self.everywhere = set(np.asarray(token)[np.asarray(everywhere, bool)].tolist())
        self.members: dict[int, list[int]] = {}
        self.spans: dict[int, tuple[float, float]] = {}
        for t, k, p in zip(token[order].tolist(), kind[order].tolist(), place[order].tolist()):
            self.members.setdefault(k, []).append(t)
            self.spans[k] = (self.spans.get(k, (p, p))[0], p)
        wide = sorted(self.spans, key=lambda k: self.spans[k][0] - self.spans[k][1])
        self.parent: dict[int, int | None] = {}
        for i, k in enumerate(wide):  # the narrowest wider class about it
            low, high = self.spans[k]
            about = [o for o in wide[:i] if self.spans[o][0] <= low and high <= self.spans[o][1]]
            self.parent[k] = about[-1] if about else None

    def on(self, listed: list[int]) -> set[int]:
        """Template tokens of a page: those of the classes that are whole and in order on it, and nested in such."""
        first: dict[int, int] = {}
        for i, t in enumerate(listed):
            first.setdefault(t, i)
        valid: dict[int | None, bool] = {None: True}
        for k in self.parent:  # wider classes come first
            places = [first.get(t, -1) for t in self.members[k]]
            valid[k] = valid[self.parent[k]] and min(places) >= 0 and places == sorted(places)
        return {t for k, ok in valid.items() if ok and k is not None for t in self.members[k]}


class Slot(NamedTuple):
    """A block with its slot (how many template tokens precede it), and how common its wording is at its place."""

    number: int
    block: Block
    fixed: bool  # wording of the template
    everywhere: bool  # that all pages of the host have


def slots(page: str, template: Template) -> list[Slot]:
    """Blocks of a page in the slots that the tokens of the host's template leave."""
    events = parse(page)
    listed = tokens(events)
    fixed = template.on(listed)
    out, number = [], 0
    for event, token in zip(events, listed):
        if isinstance(event, Block):
            out.append(Slot(number, event, token in fixed, token in fixed and token in template.everywhere))
        number += token in fixed
    return out


def main_text(page: str, template: Template) -> str:
    """Text of the slots of a page that are its main part, block by block.

    Blocks in parts set apart fill no slot.  A page without an article or main
    part gives all slots, less the template's wording.  Otherwise an article or main part tells
    which slots are meant: those that it fills.  What it says in the very words,
    at the very place, that all other pages of the host have is not the page's own and goes;
    a line that only many of them share stays.
    """
    own = [s for s in slots(page, template) if not s.block.apart]
    told = {s.number for s in own if s.block.inside}
    if told:
        return " ".join(s.block.text for s in own if s.number in told and s.block.inside and not s.everywhere)
    return " ".join(s.block.text for s in own if not s.fixed)


_EMPTY = Template(*[np.zeros(0, np.int64)] * 4)


def extract(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the main text, empty if none) and ``n_chars`` (its code points).

    Character references are decoded, white space inside a block is one space,
    blocks follow one another in page order with a space between.  A null html
    is empty; a null or bad url belongs to the host of that name (empty); a
    host of fewer than MIN_PAGES pages has no template, and its pages are judged by
    their parts alone.  Columns of the two names are replaced; rows are neither
    added nor lost.
    """
    columns = ("token", "class", "place", "everywhere")
    listed = classes(pages, url, html).groupBy("host").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("t"))
    rest = pages.drop("text", "n_chars")
    names = {c: unused(rest, f"_{c}") for c in ("host", *columns)}
    told = listed.select(F.col("host").alias(names["host"]), *[F.col(f"t.{c}").alias(names[c]) for c in columns])
    rows = join_dimension(rest.withColumn(names["host"], host_of(F.col(url))), stage(told, "templates"), [names["host"]], "left")

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known: dict[str, Template] = {}
        for host, page, *lists in batches:
            if len(known) > 1000:
                known.clear()
            out = []
            for i, h in enumerate(host):
                if h not in known:
                    known[h] = _EMPTY if lists[0].iat[i] is None else Template(*[x.iat[i] for x in lists])
                out.append(main_text(page.iat[i] or "", known[h]))
            yield pd.Series(out)

    found = rows.withColumn("text", run(names["host"], F.col(html), *[names[c] for c in columns]))
    return found.select(*[f"`{c}`" for c in rest.columns], "text", F.length("text").cast("long").alias("n_chars"))
