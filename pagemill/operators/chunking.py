"""Documents to header chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import hashing, text
from pagemill.operators.html import nonempty_markdown
from pagemill.operators.scale import compute_once

# Header pattern and the names of text outside any header.
_HEADER = r"(?mdU)^#{1,6}[\s\x1c-\x1f]+"
INTRODUCTION = "Introduction"
GENERAL = "General"
UNKNOWN_SOURCE = "unknown"


def chunk_by_headers(docs: DataFrame, markdown: str = "markdown") -> DataFrame:
    """One row per header section: carried columns, chunk_idx, header, text.

    Text before the first header becomes an introduction; a document without
    headers is one unstripped general chunk.  ``chunk_idx`` counts every
    section, also those a later filter drops.
    """
    md = F.col(markdown)
    heads = F.regexp_extract_all(md, F.lit(_HEADER + "(.*)"), F.lit(1))
    # split yields exactly one part more than there are headers
    split = docs.withColumn("_heads", heads).withColumn("_parts", F.split(md, _HEADER + ".*", -1))

    def section(header: Column, body: Column) -> Column:
        return F.struct(header.alias("header"), body.alias("text"))

    parts = F.col("_parts")
    lead = F.element_at(parts, 1)
    sections = F.zip_with(
        F.col("_heads"),
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda h, p: section(text.strip(h), text.strip(p)),
    )
    introduction = F.filter(
        F.array(section(F.lit(INTRODUCTION), text.strip(lead))), lambda _: F.length(lead) > 0
    )
    whole = F.filter(F.array(section(F.lit(GENERAL), md)), lambda c: F.length(c["text"]) > 0)
    chunks = F.when(F.size("_heads") > 0, F.concat(introduction, sections)).otherwise(whole)
    carried = [c for c in docs.columns if c != markdown]
    return (
        compute_once(split, "_chunks", chunks)
        .select(*carried, F.posexplode("_chunks").alias("chunk_idx", "_chunk"))
        .select(*carried, "chunk_idx", "_chunk.header", "_chunk.text")
    )


def nonempty_chunks(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop chunks whose ``col`` is empty; ordinals are left as they are."""
    return df.filter(F.col(col) != "")


def min_words(df: DataFrame, n: int = 5, col: str = "text") -> DataFrame:
    return df.filter(text.has_words(F.col(col), n))


def source_url(docs: DataFrame) -> DataFrame:
    """Add ``source_url`` from the metadata, defaulted when missing."""
    return docs.withColumn("source_url", F.coalesce(F.col("metadata.source_url"), F.lit(UNKNOWN_SOURCE)))


def retrieval_chunks(docs: DataFrame) -> DataFrame:
    """Chunks worth embedding: raw ``text`` for context, cleaned ``document`` for search.

    Narrow from end to end: no shuffle, no Python.
    """
    chunks = nonempty_chunks(chunk_by_headers(source_url(nonempty_markdown(docs)).drop("metadata")))
    cleaned = compute_once(chunks, "document", text.clean_text(F.col("text")))
    return nonempty_chunks(cleaned, "document").withColumn(
        "chunk_id", hashing.chunk_id(F.col("source_url"), F.col("chunk_idx"))
    )


def graph_chunks(docs: DataFrame, words: int = 5) -> DataFrame:
    """Chunks for entity extraction: at least ``words`` words, ids that include the header."""
    chunks = chunk_by_headers(source_url(nonempty_markdown(docs)).drop("metadata"))
    return min_words(nonempty_chunks(chunks), words).withColumn(
        "chunk_id", hashing.graph_chunk_id(F.col("source_url"), F.col("chunk_idx"), F.col("header"))
    )
