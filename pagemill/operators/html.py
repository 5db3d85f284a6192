"""Landed pages to metadata, links and main-content markdown."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import text, urls
from pagemill.operators import scan
from pagemill.operators.scale import compute_once

# Page metadata fields.
METADATA_FIELDS = [
    "source_url", "title", "description", "language", "keywords",
    "og_title", "og_description", "og_image", "og_url", "favicon",
]
METADATA_TYPE = "struct<" + ",".join(f"{f}:string" for f in METADATA_FIELDS) + ">"

# possessive, so Java repeats the group in a loop and not on the stack
_TAG_BODY = r"""(?:[^>"']++|"[^"]*"|'[^']*'|["'])*+"""
_NAME_END = r"(?=[\s/>])"
# Elements whose content is not markup: without an end tag they reach to the end of the page.
_RAW = ("script", "style")
_ATTRIBUTE = r"""([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _raw_elements() -> str:
    parts = [rf"<{n}{_NAME_END}[^>]*/>|<{n}{_NAME_END}[^>]*>.*?(?:</{n}\s*>|\z)" for n in _RAW]
    return "(?is)" + "|".join(parts)


def visible_html(html: Column) -> Column:
    """Page without comments, scripts and styles, whose text can look like tags."""
    return text.chain(html, [(r"(?s)<!--.*?(?:-->|\z)", ""), (_raw_elements(), "")])


def with_visible(pages: DataFrame) -> DataFrame:
    """Add the visible page as ``_seen``, unless an earlier step has."""
    return pages if "_seen" in pages.columns else pages.withColumn("_seen", visible_html(F.col("html")))


def _tags(html: Column, name: str) -> Column:
    """Start tags of one element as structs of lower-cased attribute names and raw values."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{name}{_NAME_END}{_TAG_BODY}>"), F.lit(0))
    return F.transform(
        found,
        lambda t: F.struct(
            F.transform(F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(1)), F.lower).alias("names"),
            F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(2)).alias("vals"),
        ),
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute as written, quotes removed; null when the tag lacks it."""

    def unquoted(at: Column) -> Column:
        raw = F.when(at > 0, F.element_at(tag["vals"], at.cast("int")))
        return F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2")

    return text.let(F.array_position(tag["names"], name), unquoted)


def _last_meta(metas: Column, name: str | None = None, prop: str | None = None) -> Column:
    """Content of the last matching meta tag, as written; ``name`` is tested before ``property``."""

    def matches(tag: Column) -> Column:
        if name is not None:
            return F.coalesce(tag["name"], F.lit("")) == name
        named = F.coalesce(tag["name"].isin("description", "keywords"), F.lit(False))
        return ~named & (F.coalesce(tag["property"], F.lit("")) == prop)

    return F.try_element_at(F.filter(metas, matches), F.lit(-1))["content"]


def _with_attributes(html: Column, tag: str, *names: str) -> Column:
    """All start tags of an element as structs of the named attributes."""
    return F.transform(_tags(html, tag), lambda t: F.struct(*[_attribute(t, n).alias(n) for n in names]))


def extract_metadata(pages: DataFrame) -> DataFrame:
    """Add the ``metadata`` struct of ten nullable strings to ``pages(url, html, ...)``."""
    seen, metas = F.col("_seen"), F.col("_metas")
    title_text = F.regexp_extract(seen, r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)", 1)
    icon = F.try_element_at(
        F.filter(F.col("_icons"), lambda t: F.contains(F.coalesce(t["rel"], F.lit("")), F.lit("icon"))), F.lit(1)
    )
    # values as written; character references are decoded in all of them at once
    raw = {
        "title": text.empty_to_null(title_text),
        "language": F.try_element_at(_with_attributes(seen, "html", "lang"), F.lit(1))["lang"],
        "description": _last_meta(metas, name="description"),
        "keywords": _last_meta(metas, name="keywords"),
        **{f"og_{p}": _last_meta(metas, prop=f"og:{p}") for p in ("title", "description", "image", "url")},
        "icon": icon["href"],
    }
    found = (
        with_visible(pages)
        .withColumn("_metas", _with_attributes(seen, "meta", "name", "property", "content"))
        .withColumn("_icons", _with_attributes(seen, "link", "rel", "href"))
        .withColumn("_raw", F.array(*raw.values()))
        .withColumn("_raw", F.transform("_raw", lambda v: text.decode_entities(v)))
    )
    value = {name: F.element_at(F.col("_raw"), i + 1) for i, name in enumerate(raw)}
    own_title = text.strip(value["title"])
    href = text.empty_to_null(value["icon"])
    fields = {
        **value,
        "source_url": F.col("url"),
        "title": F.coalesce(text.empty_to_null(own_title), text.empty_to_null(value["og_title"]), own_title),
        "language": text.empty_to_null(value["language"]),
        "favicon": F.when(href.isNotNull(), urls.resolve_url(F.col("url"), href)),
    }
    struct = F.struct(*[fields[f].alias(f) for f in METADATA_FIELDS])
    return found.withColumn("metadata", struct).select(*pages.columns, "metadata")


def with_hrefs(pages: DataFrame) -> DataFrame:
    """Add ``hrefs``: the raw targets of all ``<a href>`` in document order."""
    anchors = _with_attributes(F.col("_seen"), "a", "href")
    hrefs = F.transform(F.filter(anchors, lambda t: t["href"].isNotNull()), lambda t: t["href"])
    return with_visible(pages).withColumn("hrefs", hrefs).select(*pages.columns, "hrefs")


def links_of(parsed: DataFrame) -> DataFrame:
    """Links of pages with ``hrefs``, one row each: (..., src_url, pos, href, abs_url)."""
    carried = [c for c in parsed.columns if c not in ("url", "hrefs", "html", "markdown", "metadata")]
    return (
        parsed.select(*carried, F.col("url").alias("src_url"), F.posexplode("hrefs").alias("pos", "_raw"))
        .withColumn("href", text.decode_entities(F.col("_raw")))
        .drop("_raw")
        .withColumn("abs_url", urls.resolve_url(F.col("src_url"), F.col("href")))
    )


def extract_links(pages: DataFrame) -> DataFrame:
    """Every ``<a href>`` in document order: (src_url, pos, href, abs_url).

    Columns of ``pages`` other than ``url`` and ``html`` are carried along.
    """
    found = with_hrefs(pages)
    return links_of(compute_once(found.drop("html"), "hrefs", F.col("hrefs")))


def parse_pages(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` to (url, metadata, hrefs, markdown) in one pass over the page."""
    return main_content_markdown(with_hrefs(extract_metadata(with_visible(pages)))).drop("html", "_seen")


def same_domain(df: DataFrame, a: str, b: str) -> DataFrame:
    """Keep rows whose two URLs name the same host, compared as written."""
    return df.filter(urls.same_host(F.col(a), F.col(b)))


def ok_pages(pages: DataFrame) -> DataFrame:
    """Successful responses; a table without ``status`` counts as all successful."""
    return pages.filter(F.col("status") < 400) if "status" in pages.columns else pages


_FINISH = [
    (r"([*_])", r"\\$1"),
    (r" *\n[ \n]*\n *", "\n\n"),
    (r"(?md)^( *)#", r"$1\\#"),
]


# Spark ends an Arrow batch at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch); pages become Python texts one by one.
@F.arrow_udf(T.StringType())
def _marked(pages: pa.Array) -> pa.Array:
    raw = (page.as_buffer() for page in pages)
    texts = (None if page is None else page.to_pybytes().decode("utf-8", "replace") for page in raw)
    return pa.array(map(scan.marked_content, texts), pa.string())


def main_content_markdown(pages: DataFrame, out: str = "markdown") -> DataFrame:
    """Add the page's main content as markdown; null when there is none.

    Content is what lies from the first ``article`` to the end of the last, else
    ``main`` likewise, else the page; in each case without menus, asides, footers,
    forms and unseen elements, and outside articles without headers and containers
    that are mostly links.  An element without an end tag is no such part.
    """
    body = text.chain(text.decode_entities(F.col("_marked")), _FINISH)
    marked = pages.withColumn("_marked", _marked("html"))
    return compute_once(marked, out, text.empty_to_null(text.strip(_restore(body)))).select(*pages.columns, out)


def _restore(col: Column) -> Column:
    """Marks and protected characters back to what they stand for."""
    marks = scan.MARKS
    col = F.replace(col, F.lit(marks["br"]), F.lit("  \n"))
    col = F.replace(col, F.lit(marks["]("]), F.lit("]("))
    singles = [({"nl": "\n", "lead": " "}.get(k, k), v) for k, v in marks.items() if k not in ("br", "](")]
    return F.translate(col, "".join(v for _, v in singles) + scan.KEEP, "".join(k for k, _ in singles) + scan.KEPT)


def pages_to_documents(pages: DataFrame) -> DataFrame:
    """Successful pages with main content as documents (markdown, metadata).

    ``html`` is dropped here; it must not travel into any later shuffle.
    """
    docs = main_content_markdown(extract_metadata(ok_pages(pages)))
    return nonempty_markdown(docs).drop("html", "status")


def nonempty_markdown(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("markdown").isNotNull() & (F.col("markdown") != ""))
