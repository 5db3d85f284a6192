"""Cleaner and chunker: pinned cases, and random documents against plain statements of the rules."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import hashing, text
from pagemill.operators import chunking

NBSP, LS = " ", " "

CHUNKS = {
    "intro\n# A\nx": [("Introduction", "intro"), ("A", "x")],
    "plain": [("General", "plain")],
    "": [],
    "  \n# B": [("Introduction", ""), ("B", "")],
    "#\nnext": [("next", "")],
    "####### x": [("General", "####### x")],
    "x\r\n# H\r\ny": [("Introduction", "x"), ("H", "y")],
    f"a{LS}# U\nb": [("General", f"a{LS}# U\nb")],
    f"#{NBSP}N\nb": [("N", "b")],
    "# A\n# B\nc\n## C": [("A", ""), ("B", "c"), ("C", "")],
    "```\n# in a fence\n```": [("Introduction", "```"), ("in a fence", "```")],
    "  padded  ": [("General", "  padded  ")],
}

CLEANED = {
    "```\ncode\n``` kept ```x```": "kept",
    "```never closed": "`never closed".replace("`", ""),
    "![alt](u) [a](b)": "!alt a",
    "Edit this page on GitHub tail\nnext": "next",
    "© ２０２４ X all rights reserved.": "",
    "Was this page helpful? ON THIS PAGE yes": "yes",
    "a \t b\n\n\n\nc": "a b\nc",
    "Some *em*, **bold**, ***both***, _it_ and snake_case_name": "some em, bold, both, it and snake_case_name",
    "a\\*b \\_c\\_ 2 * 3 * 4": "a*b _c_ 2 * 3 * 4",
    "- one\n- two\n\n1. three\n> quoted": "one\ntwo\nthree\nquoted",
    "Title\n=====\n\ntext\n\n---\n\nend": "title\n\ntext\n\nend",
    "<b>x</b> &lt;y&gt; &#8217; &#x27; &amp;lt; &bogus; <!-- gone -->": "x <y> ’ ' &lt; &bogus;",
    "<script>var a = '<p>';</script>after": "after",
    "İSTANBUL": "i̇stanbul",
    "*a\n\nb*": "*a\nb*",
    "*****deep***** and ____under____": "deep and under",
    "&#00000065;&rArr;&alpha;&bogus2; &#99999999999999999999999;": "a⇒α&bogus2; \ufffd",
}


def test_pinned_chunks(spark):
    rows = [(i, md) for i, md in enumerate(CHUNKS)]
    docs = spark.createDataFrame(rows, "i int, markdown string")
    got: dict[int, list] = {}
    for r in chunking.chunk_by_headers(docs).orderBy("i", "chunk_idx").collect():
        assert r.chunk_idx == len(got.setdefault(r.i, []))
        got[r.i].append((r.header, r.text))
    for i, md in rows:
        assert got.get(i, []) == CHUNKS[md], repr(md)


def test_pinned_cleaning(spark):
    rows = [(i, t) for i, t in enumerate(CLEANED)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.d for r in df.select("i", text.clean_text(F.col("t")).alias("d")).collect()}
    for i, t in rows:
        want = CLEANED[t]
        assert re.sub("\n+", "\n", got[i]) == re.sub("\n+", "\n", want), repr(t)
    nothing = spark.createDataFrame([(None,)], "t string").select(text.clean_text(F.col("t"))).first()[0]
    assert nothing == ""


def test_random_chunks_and_ids(spark):
    rng = random.Random(7)
    alphabet = ["#", "#", "##", " ", "\n", "\n", "\t", "a", "b c", "\r", NBSP, "\x1c", LS, "\x85", "`", "####### "]
    docs = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))) for i in range(3000)]
    df = spark.createDataFrame(docs, "i int, markdown string").withColumn("url", F.concat(F.lit("u"), "i"))
    out = chunking.chunk_by_headers(df).withColumn("id", hashing.chunk_id(F.col("url"), F.col("chunk_idx")))
    got: dict[int, list] = {}
    for r in out.orderBy("i", "chunk_idx").collect():
        got.setdefault(r.i, []).append((r.header, r.text))
        assert r.id == hashlib.sha256(f"u{r.i}-{r.chunk_idx}".encode()).hexdigest()
    for i, md in docs:
        chunks = got.get(i, [])
        marked = sum(line.startswith("#") for line in md.split("\n"))
        assert len(chunks) <= marked + 1 and bool(chunks) == bool(md), repr(md)
        if not marked:
            assert chunks == ([("General", md)] if md else []), repr(md)
        at = 0
        for header, body in chunks:  # parts stand in the document in order
            if (header, at) not in (("Introduction", 0), ("General", 0)):
                at = md.index(header, at) + len(header)
            at = md.index(body, at) + len(body)


def test_strip_words_and_boilerplate_match_python(spark):
    rng = random.Random(3)
    alphabet = [" ", "\n", "\x1c", NBSP, "　", "x", "é", "on this page", "ON THIS PAGE", "next  →", "© 2024 a All Rights Reserved.", "\x85"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, t string")
    t = F.col("t")
    got = df.select("i", text.strip(t).alias("s"), text.words(t).alias("w"), text.drop_boilerplate(t).alias("b"), text.has_words(t, 3).alias("h")).collect()
    for r, (_, raw) in zip(sorted(got), rows):
        assert r.s == raw.strip() and r.w == raw.split() and r.h == (len(raw.split()) >= 3)
        want = raw
        for p in text.BOILERPLATE:
            want = re.sub(p, "", want, flags=re.I)
        assert r.b == want


def test_ordinals_survive_filters_and_min_words(spark):
    docs = spark.createDataFrame(
        [("t", 1, "lead\n# A\n# B\n`code`\n# C\none two three four five", ("u",)), ("t", 2, None, ("v",)), ("t", 3, "x", (None,))],
        "target string, doc_ord long, markdown string, metadata struct<source_url:string>",
    )
    got = [(r.doc_ord, r.chunk_idx, r.source_url) for r in chunking.retrieval_chunks(docs).orderBy("doc_ord", "chunk_idx").collect()]
    assert got == [(1, 0, "u"), (1, 3, "u"), (3, 0, "unknown")]
    graph = chunking.graph_chunks(docs).collect()
    assert [(r.chunk_idx, r.chunk_id) for r in graph] == [(3, hashlib.sha256(b"u-3-C").hexdigest())]


@pytest.mark.parametrize("size", [400_000])
def test_long_documents_do_not_overflow(spark, size):
    body = ("word *em* _x_ [l](u) &amp; " * (size // 26)) + "`" + "y\n" * 1000
    df = spark.createDataFrame([(body,)], "t string")
    assert len(df.select(text.clean_text(F.col("t"))).first()[0]) > size // 3
