"""Named queries over the test tables, one or more per operator.

Every query reads whole tables; inputs an operator needs and the tables lack
(link graphs, model replies, boilerplate) are derived from them by columns.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import hashing, text, urls, vectors
from pagemill.operators import chunking, encode, graph, html, knn, retrieve, scale, triples
from pagemill.operators.crawl import crawl_order
from pagemill.plans import answer, build
from pagemill.settings import Settings
from pagemill.sources import cache, packs, pages as landed, targets
from pagemill.streaming import documents as doc_stream
from pagemill.streaming import triggers

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.read_pages(spark, f"{sf_dir}/pages.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in document form, one target per language."""
    return landed.spread(table(spark, sf_dir, "documents")).select(
        F.col("lang").alias("target"),
        F.col("doc_id").alias("doc_ord"),
        F.col("text").alias("markdown"),
        F.struct(F.concat_ws("/", "source", "doc_id").alias("source_url")).alias("metadata"),
    )


def _scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for queries that write and read back."""
    return f"{scale.staging_root(spark)}/pagemill-query/{label}-{uuid.uuid4().hex}"


# --- pages -----------------------------------------------------------------

_MANY = " ".join(f"d{i}='>'" for i in range(300))  # attributes of one tag


def _with_head_tags(pages: DataFrame) -> DataFrame:
    """Pages with meta and icon tags; every fourth loses its title, whose text the og tag then supplies."""
    extra = F.concat(
        F.lit('<meta charset="utf-8"><meta name="description" content="superseded">'),
        F.lit(f'<meta {_MANY} name="description" content="Page '), F.col("page_id"), F.lit(' &gt; &amp;amp; &#00000065; more">'),
        F.lit("<META property='og:title' content='OG "), F.col("page_id"), F.lit("'>"),
        F.lit('<meta name="keywords"><link rel="stylesheet" href="a.css">'),
        F.lit('<link href="/icons/'), F.col("page_id"), F.lit('.png" rel="shortcut icon">'),
    )
    tagged = F.replace(F.col("html"), F.lit('<meta charset="utf-8">'), extra)
    untitled = F.regexp_replace(tagged, "<title>[^<]*</title>", "<title></title>")
    return pages.withColumn("html", F.when(F.col("page_id") % 4 == 0, untitled).otherwise(tagged))


@query
def page_metadata(spark, sf_dir):
    found = html.extract_metadata(_with_head_tags(_pages(spark, sf_dir)))
    return found.select("page_id", "metadata.*")


def _with_anchors(pages: DataFrame) -> DataFrame:
    anchors = (
        '<body><a href="?q=1&amp;r=2">q</a><a class=x href=\'//cdn.example.org/a#b\'>c</a>'
        '<a name="n">n</a><a href="mailto:x@y.z">m</a><A HREF="../up/./x#f">u</A>'
        f'<a {_MANY} href="/many">d</a>'
    )
    return pages.withColumn("html", F.replace(F.col("html"), F.lit("<body>"), F.lit(anchors)))


@query
def page_links(spark, sf_dir):
    return html.extract_links(_with_anchors(_pages(spark, sf_dir))).select("page_id", "pos", "href", "abs_url")


@query
def same_host_links(spark, sf_dir):
    links = html.extract_links(_with_anchors(_pages(spark, sf_dir)))
    kept = html.same_domain(links, "src_url", "abs_url")
    return kept.groupBy(urls.netloc(F.col("src_url")).alias("host")).agg(F.count(F.lit(1)).alias("links"))


def _with_first_article(pages: DataFrame) -> DataFrame:
    """Pages with a further article, a menu and an advert before their own; a third of them without an end of the head."""
    first = (
        f"<article {_MANY}><h2>First &#00000065;</h2><p>Some <b>bold <i>text</i></b> and <a href='/x_y'>a link</a>.<p>No end tag"
        "<table><tr><th>a<th>b</tr>\n<tr><td>1</td><td>2</td></tr></table><pre><code>def f(a):\n    return a*2  # c &lt; d</code></pre>"
        "<blockquote><p>Quoted</p></blockquote><ol><li>one\n<li>two <code>x_y</code></ol><form><input><button>Send</button></form></article>"
        "<nav><ul><li><a href='/m'>MENU</a></ul></nav><aside><p>ADVERT<div>nested</div></aside><p>Between"
    )
    page = F.replace(F.col("html"), F.lit("<article>"), F.concat(F.lit(first), F.lit("<article>")))
    return pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.replace(page, F.lit("</head>"), F.lit(""))).otherwise(page))


@query
def main_content(spark, sf_dir):
    return html.main_content_markdown(_with_first_article(_pages(spark, sf_dir))).select("page_id", "markdown")


def _page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page markdown with an introduction, further sections and boilerplate around it."""
    md = html.main_content_markdown(_pages(spark, sf_dir).select("page_id", "url", "html"))
    body = F.concat(
        F.lit("Intro of "), F.col("page_id"), F.lit("\n"), F.col("markdown"),
        F.lit("\n## Details \nOn this page see [the *page*]("), F.col("url"),
        F.lit(") and `code` now.\n\n\n\n- item\t one\n- item two\nEdit this page on GitHub\n"),
        F.lit("```\n# kept as a header by the chunker\nx = 1\n```\n###\nLast &amp; least\n\n© 2024 X all rights reserved.\n#### \n"),
    )
    return md.select(
        urls.netloc(F.col("url")).alias("target"),
        F.col("page_id").alias("doc_ord"),
        body.alias("markdown"),
        F.struct(F.col("url").alias("source_url")).alias("metadata"),
    )


@query
def header_chunks(spark, sf_dir):
    docs = chunking.source_url(chunking.nonempty_markdown(_page_documents(spark, sf_dir)))
    return chunking.chunk_by_headers(docs).select(
        F.col("doc_ord").alias("page_id"), "chunk_idx", "header", "text",
        hashing.chunk_id(F.col("source_url"), F.col("chunk_idx")).alias("chunk_id"),
    )


@query
def clean_chunks(spark, sf_dir):
    return chunking.retrieval_chunks(_page_documents(spark, sf_dir)).select(
        F.col("doc_ord").alias("page_id"), "chunk_idx", "document"
    )


@query
def min_words(spark, sf_dir):
    docs = landed.spread(table(spark, sf_dir, "documents"))
    return chunking.min_words(docs, 60).select("doc_id", F.size(text.words(F.col("text"))).alias("n_words"))


# --- sources and stores ----------------------------------------------------

@query
def select_targets(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents")
    limits = docs.join(good, "doc_id").groupBy(F.concat_ws("-", "source", "lang").alias("target")).agg(
        F.when(F.count(F.lit(1)) > 3, F.count(F.lit(1))).cast("int").alias("page_limit")
    )
    known = targets.with_default_limit(targets.select_targets(limits, "ALL"))
    requests = docs.select("doc_id", F.concat_ws("-", "source", "lang").alias("target"))
    lost = targets.unknown_targets(requests, known).withColumn("page_limit", F.lit(-1))
    return targets.resolve_targets(requests, known).unionByName(lost)


@query
def source_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("target", F.concat_ws("-", "source", "lang"))
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    primary = docs.join(good, "doc_id").select("target", "doc_id", F.lit("primary").alias("origin"))
    other = docs.select("target", "doc_id", F.lit("fallback").alias("origin"))
    return landed.with_fallback(primary, other)


@query
def normalize_feed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    given = F.when(
        F.col("lang") != "es",
        F.create_map(F.lit("title"), F.col("source"), F.lit("language"), F.col("lang"), F.lit("length"), F.col("n_chars").cast("string")),
    )
    feed = docs.select("doc_id", F.col("text").alias("markdown"), given.alias("metadata"))
    return landed.normalize_feed(feed).select(
        "doc_id", "metadata.title", "metadata.language", "metadata.source_url",
        F.try_element_at("extra", F.lit("length")).alias("length"), F.size("extra").alias("n_extra"),
    )


@query
def cache_roundtrip(spark, sf_dir):
    path = _scratch(spark, "cache")
    docs = _documents(spark, sf_dir)
    meta = F.struct(*[
        (F.col("metadata.source_url") if f == "source_url" else F.lit(None).cast("string")).alias(f)
        for f in html.METADATA_FIELDS
    ])
    docs = docs.withColumn("metadata", meta)
    cache.write_scrape_cache(docs.filter(F.col("target") != "fr"), path)
    cache.write_scrape_cache(docs.withColumn("markdown", F.lit("skipped unless new")), path)
    cache.write_scrape_cache(docs.filter(F.col("target") == "de").withColumn("markdown", F.lit("forced")), path, force=True)
    return cache.read_scrape_cache(spark, path).select(
        "target", "doc_ord", F.md5("markdown").alias("markdown_md5"), "metadata.source_url"
    )


@query
def dedupe_last(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "doc_id", "source")
    return scale.dedupe_last(docs, ["text_md5"], ["doc_id"])


@query
def upsert_vectors(spark, sf_dir):
    old = table(spark, sf_dir, "embeddings").select(
        F.lit("all").alias("target"), F.col("vec_id").cast("string").alias("chunk_id"),
        "embedding", F.concat(F.lit("label "), "label").alias("document"), F.lit("old").alias("source_url"),
    )
    new = table(spark, sf_dir, "labels").select(
        F.lit("all").alias("target"), F.col("doc_id").cast("string").alias("chunk_id"),
        F.array(F.col("toxic").cast("float")).alias("embedding"),
        F.concat(F.lit("quality "), "quality").alias("document"), F.lit("new").alias("source_url"),
    )
    return packs.upsert_vectors(old, new).select("chunk_id", "document", "source_url", F.size("embedding").alias("width"))


@query
def pack_metadata(spark, sf_dir):
    docs = scale.stage(_page_documents(spark, sf_dir), "documents")
    return packs.pack_metadata(docs, chunking.retrieval_chunks(docs), "hashing-64", "2024.01.31")


@query
def pack_roundtrip(spark, sf_dir):
    root = _scratch(spark, "packs")
    built = build.build_pack(_documents(spark, sf_dir), encode.hashing_encoder(), version="2024.01.31")
    packs.publish_pack(built, root, "2024.01.31")
    stored = packs.load_packs(spark, root).select("target", "chunk_id", "source_url", F.size("embedding").alias("width"))
    raw = packs.load_packs(spark, root, "chunks").select("target", "chunk_id", F.md5("text").alias("text_md5"), "header")
    return stored.join(raw, ["target", "chunk_id"])


@query
def page_documents(spark, sf_dir):
    docs = html.pages_to_documents(_with_head_tags(_pages(spark, sf_dir)))
    return docs.select("page_id", F.md5("markdown").alias("markdown_md5"), "metadata.source_url", "metadata.title")


@query
def json_cache(spark, sf_dir):
    """Documents as JSON arrays, a hundred to a file, and a file that breaks off."""
    path = _scratch(spark, "json")
    docs = _documents(spark, sf_dir).withColumn("file", F.floor(F.col("doc_ord") / 100))
    arrays = docs.groupBy("file").agg(F.to_json(F.array_sort(F.collect_list(F.struct("markdown", "metadata")))).alias("value"))
    broken = arrays.agg(F.min("file").alias("file")).select(F.lit(-1).cast("long").alias("file"), F.lit('[{"markdown": "lost"').alias("value"))
    arrays.unionByName(broken).repartition("file").write.partitionBy("file").text(path)
    return cache.read_json_cache(spark, f"{path}/*", "all").select("target", F.md5("markdown").alias("markdown_md5"), "metadata.source_url")


@query
def unknown_source(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    some = F.when(F.col("doc_ord") % 3 != 0, F.col("metadata.source_url"))
    return chunking.source_url(docs.withColumn("metadata", F.struct(some.alias("source_url")))).select("doc_ord", "source_url")


@query
def version_stamps(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy(hashing.version_stamp(F.col("ts").cast("timestamp")).alias("version")).agg(F.count(F.lit(1)).alias("events"))


@query
def metadata_sink(spark, sf_dir):
    path = _scratch(spark, "metadata")
    packs.write_pack_metadata(pack_metadata(spark, sf_dir), path)
    columns = ["framework", "version", "documents_scraped", "chunks_embedded", "embedding_model"]
    return spark.read.json(path).select(*columns)


def _label_pack(rows: DataFrame, document: Column) -> dict[str, DataFrame]:
    """Tables of packs that hold the given vectors, one target per label, named by three digits."""
    named = rows.select(
        F.lpad(F.col("label").cast("string"), 3, "0").alias("target"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding",
        document.alias("document"), F.lit("s").alias("source_url"), F.lit(0).alias("chunk_idx"), document.alias("text"), F.lit("h").alias("header"),
    )
    counted = named.groupBy(F.col("target").alias("framework")).agg(F.count(F.lit(1)).alias("documents_scraped"))
    meta = counted.select("framework", F.lit("-").alias("version"), "documents_scraped", F.col("documents_scraped").alias("chunks_embedded"), F.lit("m").alias("embedding_model"))
    return {"vectors": named.select(*packs.VECTOR_COLUMNS), "chunks": named.select(*packs.CHUNK_COLUMNS), "metadata": meta}


@query
def rebuild_pack(spark, sf_dir):
    """Packs of all vectors, then new texts for some of them upserted: kept beside the old ones, and in their place."""
    rows = table(spark, sf_dir, "embeddings")
    new = rows.filter((F.col("label") % 2 == 0) & (F.col("vec_id") % 3 == 0))
    out = None
    for prune in (False, True):
        root = _scratch(spark, "rebuilt")
        packs.publish_pack(_label_pack(rows, F.concat(F.lit("old "), "vec_id")), root, "2024.9")
        packs.upsert_pack(_label_pack(new, F.concat(F.lit("new "), "vec_id")), root, "2024.10", prune)
        raw = packs.load_packs(spark, root, "chunks").select("target", "chunk_id", "text")
        got = packs.load_packs(spark, root).join(raw, ["target", "chunk_id"])
        got = got.select(F.lit(prune).alias("pruned"), "target", "version", "chunk_id", "document", "text", F.size("embedding").alias("width"))
        out = got if out is None else out.unionByName(got)
    return out


@query
def load_numeric_names(spark, sf_dir):
    """Targets and versions that look like numbers: the latest by its numbers, one target with an older pack only."""
    rows, root = table(spark, sf_dir, "embeddings"), _scratch(spark, "numeric")
    for version, some in (("2024.9", rows), ("2024.10", rows.filter("label <> 7"))):
        packs.publish_pack(_label_pack(some, F.lit(version)), root, version)
    return packs.load_packs(spark, root).select("target", "version", "chunk_id", "document")


# --- vectors and retrieval -------------------------------------------------

def _vectors(spark: SparkSession, sf_dir: str, target: Column | None = None) -> DataFrame:
    name = F.concat(F.lit("label_"), F.col("label")) if target is None else target
    return table(spark, sf_dir, "embeddings").select(
        name.alias("target"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding",
        F.concat(F.lit("text of "), "vec_id").alias("document"),
        F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("src/"), "vec_id")).alias("source_url"),
    )


def _vector_queries(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Every stored vector as a query; with a shift, against the next label's vectors."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.concat(F.lit("label_"), F.col("label") + shift).alias("target"), "embedding",
        (F.lit(2) + F.col("vec_id") % 4).cast("int").alias("n_results"),
    )


@query
def knn_exact(spark, sf_dir):
    found = knn.knn(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir))
    return found.withColumn("distance", F.round("distance", 6))


@query
def knn_blocked(spark, sf_dir):
    """The same search batch by batch over vectors that stay, as for query sets too large to broadcast."""
    found = knn.knn(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), max_queries=0, query_block=64)
    return found.withColumn("distance", F.round("distance", 6))


@query
def knn_approx(spark, sf_dir):
    """Search over all vectors by an inverted file that is widened until no other list can matter."""
    stored = knn.index(_vectors(spark, sf_dir, F.lit("all")))
    asked = _vector_queries(spark, sf_dir).withColumn("target", F.lit("all"))
    found = knn.knn_approx(stored, asked)
    return found.withColumn("distance", F.round("distance", 6))


@query
def normalize_vectors(spark, sf_dir):
    doubled = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x * F.col("label")).alias("v")
    )
    return doubled.select("vec_id", F.posexplode(vectors.unit(F.col("v"))).alias("pos", "value")).withColumn(
        "value", F.round("value", 6)
    )


def _hits(spark: SparkSession, sf_dir: str, shift: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    stored, asked = _vectors(spark, sf_dir), _vector_queries(spark, sf_dir, shift)
    found = knn.knn(stored, asked).join(asked.select("query_id", "target"), "query_id")
    return scale.stage(found, "hits"), stored, asked


@query
def knn_response(spark, sf_dir):
    hits, stored, asked = _hits(spark, sf_dir, shift=1)
    out = retrieve.to_response(retrieve.attach_documents(hits, stored), asked)
    sources = F.transform("metadatas", lambda m: F.coalesce(m["source_url"], F.lit("-")))
    return out.select(
        "query_id", F.array_join("documents", "|").alias("documents"), F.array_join(sources, "|").alias("sources"),
        F.round(F.aggregate("distances", F.lit(0.0), lambda a, d: a + d), 5).alias("total_distance"),
    )


@query
def knn_context(spark, sf_dir):
    hits, stored, asked = _hits(spark, sf_dir, shift=1)
    return retrieve.format_context(retrieve.attach_documents(hits, stored), asked, stored.select("target"))


@query
def attach_raw(spark, sf_dir):
    hits, _, _ = _hits(spark, sf_dir)
    raw = (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
        .select(
            F.concat(F.lit("label_"), F.coalesce("label", F.lit(-1))).alias("target"), F.col("doc_id").cast("string").alias("chunk_id"),
            "text", F.col("source").alias("header"),
        )
    )
    return retrieve.attach_raw_text(hits, raw).select(
        "query_id", "rank", "chunk_id", "header", F.md5("text").alias("text_md5")
    )


@query
def embed_hash(spark, sf_dir):
    docs = landed.spread(table(spark, sf_dir, "documents")).select("doc_id", F.lower("text").alias("document"))
    return encode.embed(docs, encode.hashing_encoder(64)).select(
        "doc_id", F.posexplode("embedding").alias("pos", "value")
    ).withColumn("value", F.round(F.col("value").cast("double"), 5))


@query
def pack_search(spark, sf_dir):
    """Packs of all pages, searched by every page's title within its host."""
    encoder = encode.hashing_encoder()
    stored = scale.stage(build.build_pack(_page_documents(spark, sf_dir), encoder)["vectors"], "vectors")
    titled = html.extract_metadata(_pages(spark, sf_dir)).select(
        F.col("page_id").alias("query_id"), urls.netloc(F.col("url")).alias("target"),
        F.col("metadata.title").alias("query_text"),
    )
    hits = answer.search(stored, titled, encoder, 3, clean_query=True)
    return hits.select("query_id", "rank", F.round("distance", 4).alias("distance"))


@query
def query_packs(spark, sf_dir):
    """Response lists for every page title against published packs of the same encoder."""
    encoder, root = encode.hashing_encoder(), _scratch(spark, "queried")
    packs.publish_pack(build.build_pack(_page_documents(spark, sf_dir), encoder, encoder.model_name, "1"), root, "1")
    titled = html.extract_metadata(_pages(spark, sf_dir)).select(
        F.col("page_id").alias("query_id"), urls.netloc(F.col("url")).alias("target"), F.col("metadata.title").alias("query_text"),
    )
    found = answer.query_packs(
        packs.load_packs(spark, root), titled, encoder, 3, clean_query=True, metadata=packs.load_packs(spark, root, "metadata")
    )
    each = found.select("query_id", F.posexplode(F.arrays_zip("documents", "distances")).alias("pos", "hit"))
    return each.select("query_id", (F.col("pos") + 1).alias("rank"), F.round("hit.distances", 4).alias("distance"))


@query
def pack_context(spark, sf_dir):
    """Answer context for every page title against the packs; rows only, ties depend on rounding."""
    encoder = encode.hashing_encoder()
    stored = scale.stage(build.build_pack(_page_documents(spark, sf_dir), encoder)["vectors"], "vectors")
    titled = html.extract_metadata(_pages(spark, sf_dir)).select(
        F.col("page_id").alias("query_id"), urls.netloc(F.col("url")).alias("target"),
        F.col("metadata.title").alias("query_text"),
    )
    return answer.answer_context(stored, titled, encoder)


# --- entities, triples, graph ----------------------------------------------

_PATTERNS = {
    "targets": {
        lang: {"patterns": [
            {"label": "NAME", "pattern": r"(?:^|[ \n])([A-Z][a-z]{4,}) "},
            {"label": "CLOSE", "pattern": r" ([a-z]{6,})\.(?: |$)"},
        ]}
        for lang in ("en", "de", "es", "fr")
    }
}
_LABELS = ["NAME"]


def _capitalised() -> Callable[[list[str]], list[list[tuple[str, str]]]]:
    name = re.compile(r"([A-Z][a-z]{2,})[,.]")
    return lambda texts: [[(m, "NAME") for m in name.findall(t)] + [("dropped", "OTHER")] for t in texts]


def _graph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.graph_chunks(_documents(spark, sf_dir))


def _rule_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.rule_entities(_graph_chunks(spark, sf_dir), targets.patterns_df(spark, _PATTERNS))


def _word_triples(chunks: DataFrame) -> DataFrame:
    """The words of every chunk but the first, three by three, as triples."""
    found = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    n = F.floor((F.size("_w") - 1) / 3).cast("int")
    triple = lambda i: F.struct(*[F.element_at("_w", i * 3 + j).alias(c) for j, c in enumerate(("subject", "predicate", "object"), 2)])
    return (
        chunks.withColumn("_w", found)
        .filter(F.size("_w") >= 4)
        .select("target", "doc_ord", "chunk_idx", "chunk_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), triple)).alias("pos", "_t"))
        .select("target", "doc_ord", "chunk_idx", "chunk_id", "pos", "_t.*")
    )


@query
def rule_entities(spark, sf_dir):
    return _rule_mentions(spark, sf_dir).select("target", "doc_ord", "chunk_id", "entity", "label")


@query
def rule_entities_many(spark, sf_dir):
    """Five thousand patterns, one for each of the most frequent words of a length, on every text of their language."""
    chunks = _graph_chunks(spark, sf_dir)
    words = chunks.select("target", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("word"))
    often = words.groupBy("target", "word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target", "word").limit(5000)
    pattern = F.concat(F.lit("(?:^|[^A-Za-z])("), "word", F.lit(")(?![A-Za-z])"))
    label = F.when(F.length("word") % 2 == 0, "EVEN").otherwise("ODD")
    patterns = scale.stage(often.select("target", label.alias("label"), pattern.alias("pattern")), "patterns")
    return graph.rule_entities(chunks, patterns).select("target", "doc_ord", "entity", "label")


@query
def recognized_entities(spark, sf_dir):
    found = graph.recognize_entities(_graph_chunks(spark, sf_dir), _capitalised, _LABELS)
    return found.select("target", "doc_ord", "entity", "label")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies made of all words of a turn: system turns malformed, user turns without marker."""
    word = lambda i: F.coalesce(F.try_element_at(F.col("_w"), i), F.lit("none"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(F.size("_w") / 2).cast("int")) - 1),
        lambda k: F.concat(
            F.lit('{"subject": "'), word(k * 2 + 2), F.lit('", "predicate": 7, "object": "'), word(k * 2 + 3), F.lit('"}')
        ),
    )
    body = F.concat(
        F.lit('{"triples": [{"subject": " '), F.col("role"), F.lit('", "predicate": "says", "object": "'), word(F.lit(1)),
        F.lit('"}, {"subject": "incomplete"}, '), F.array_join(pairs, ", "),
        F.when(F.col("role") == "system", F.lit(" }")).otherwise(F.lit("]}")),
    )
    lead = F.when(F.col("role") == "user", F.lit("no marker ")).otherwise(F.lit("prompt<|assistant|> reply "))
    turns = table(spark, sf_dir, "conversations").withColumn("_w", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return turns.select("conv_id", "turn", F.concat(lead, F.lit("```json\n"), body, F.lit("\n```\nend")).alias("raw"))


@query
def parse_triples(spark, sf_dir):
    return triples.parse_triples(_replies(spark, sf_dir), "raw")


@query
def parse_marked_triples(spark, sf_dir):
    return triples.parse_triples(_replies(spark, sf_dir), "raw", marked=True)


@query
def extraction_prompt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "target")
    ontology = docs.groupBy("target").agg(
        F.array(F.min("source"), F.concat(F.max("source"), F.lit(" é😀"))).alias("entity_types"),
        F.when(F.col("target") == "de", F.array().cast("array<string>")).otherwise(F.array(F.lit("says"), F.lit('is "a"'))).alias("predicates"),
    )
    ready = triples.with_ontology(docs.select("doc_id", "target", "text"), ontology)
    return triples.extraction_prompt(ready).select("doc_id", F.md5("prompt").alias("prompt_md5"))


def _all_mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions, which each query reads once, the triples and the chunks that they come from."""
    chunks = scale.stage(_graph_chunks(spark, sf_dir), "graph-chunks", codec="zstd")
    facts = _word_triples(chunks)
    rules = graph.rule_entities(chunks, targets.patterns_df(spark, _PATTERNS))
    return graph.union_entities(rules, graph.triple_endpoints(facts)), facts, chunks


@query
def graph_nodes(spark, sf_dir):
    return graph.merge_nodes(_all_mentions(spark, sf_dir)[0])


@query
def graph_node_pages(spark, sf_dir):
    paged = graph.node_pages(_all_mentions(spark, sf_dir)[0], docs_per_page=100)
    return paged.select(
        "target", "text", "page", F.size("chunk_ids").alias("n"), F.md5(F.array_join("chunk_ids", ",")).alias("ids_md5")
    )


@query
def graph_edges(spark, sf_dir):
    mentions, facts, _ = _all_mentions(spark, sf_dir)
    return graph.valid_edges(graph.merge_edges(facts), graph.merge_nodes(mentions))


@query
def graph_roundtrip(spark, sf_dir):
    """Nodes and edges, written by target and read back."""
    mentions, facts, _ = _all_mentions(spark, sf_dir)
    path = _scratch(spark, "graph")
    packs.write_graph(graph.merge_nodes(mentions), graph.merge_edges(facts), path)
    nodes, edges = (spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges"))
    return nodes.select("target", F.col("text").alias("src"), F.lit(None).cast("string").alias("dst"), "label").unionByName(
        edges.select("target", "src", "dst", "label")
    )


@query
def graph_stats(spark, sf_dir):
    mentions, facts, chunks = _all_mentions(spark, sf_dir)
    return graph.graph_stats(graph.merge_nodes(mentions), graph.merge_edges(facts), chunks)


@query
def graph_provenance(spark, sf_dir):
    mentions, _, chunks = _all_mentions(spark, sf_dir)
    found = graph.node_provenance(mentions, chunks)
    return found.groupBy("target", "source_url", "header").agg(F.count(F.lit(1)).alias("n_nodes"))


def _reply_model() -> Callable[[list[str]], list[str]]:
    def run(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            words = re.findall("[A-Za-z]+", prompt.rsplit("**Text:**\n", 1)[1])
            threes = [(words[i : i + 3] + ["a", "b", "c"])[:3] for i in range(0, max(1, len(words)), 3)]
            said = [dict(zip(("subject", "predicate", "object"), t)) for t in threes]
            out.append("echo<|assistant|>\n```json\n" + json.dumps({"triples": said}) + "\n```")
        return out

    return run


@query
def graph_build(spark, sf_dir):
    """The composed graph with rules, recogniser and triple model."""
    config = {"targets": {t: {**spec, "entity_types": ["PERSON"], "predicates": ["knows"]} for t, spec in _PATTERNS["targets"].items()}}
    built = build.build_graph(
        _documents(spark, sf_dir), targets.patterns_df(spark, config), recognizer=_capitalised, labels=_LABELS,
        ontology=targets.ontology_df(spark, config), model=_reply_model,
    )
    return built["edges"]


# --- crawl -----------------------------------------------------------------

def _site(spark: SparkSession, sf_dir: str, share: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One site per document source: page n links to 2n and 2n+1, back to n/2, and off-site.

    The page limit is the ``share``-th part of a site.

    Toxic documents fail to load; low-quality ones load without content.
    """
    marks = table(spark, sf_dir, "labels").dropDuplicates(["doc_id"])
    marked = table(spark, sf_dir, "documents").select("source", "doc_id").join(marks, "doc_id", "left")
    docs = scale.number_rows(marked, ["source"], ["doc_id"], "n")
    at = lambda n: F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/p/"), n.cast("string"))
    pages = docs.select(
        "doc_id", at(F.col("n")).alias("url"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("ok"), (F.coalesce("quality", F.lit(1)) == 1).alias("has_content"),
    )
    hrefs = F.array(
        F.concat(F.lit("/p/"), F.floor(F.col("n") / 2).cast("string")), F.concat(F.lit("/p/"), (F.col("n") * 2 + 1).cast("string")),
        F.concat(F.lit("../p/"), (F.col("n") * 2).cast("string"), F.lit("#top")), F.lit("https://elsewhere.example.org/p/1"),
        F.lit("mailto:x@example.org"),
    )
    links = docs.select(at(F.col("n")).alias("src_url"), F.posexplode(hrefs).alias("pos", "href")).withColumn(
        "abs_url", urls.resolve_url(F.col("src_url"), F.col("href"))
    )
    seeds = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("source").alias("target"), at(F.lit(1)).alias("url"), F.floor(F.col("n") / share).cast("int").alias("page_limit")
    )
    return seeds, pages, links


@query
def crawl_ranks(spark, sf_dir):
    seeds, pages, links = _site(spark, sf_dir)
    return crawl_order(seeds, pages.select("url", "ok", "has_content"), links)


@query
def full_run(spark, sf_dir):
    """Crawl, cache, build and publish whole sites; the stored vectors' ids."""
    seeds, pages, links = _site(spark, sf_dir, share=1)
    anchors = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda a: F.concat(
        F.lit('<a href="'), a["href"], F.lit('">to</a> '))), "")
    menus = links.groupBy(F.col("src_url").alias("url")).agg(anchors.alias("menu"))
    body = F.concat(F.lit("<main><h1>Text</h1><p>"), F.col("text"), F.lit("</p></main>"))
    site = pages.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(menus, "url").select(
        "url",
        F.concat(F.lit("<html><body><nav>"), "menu", F.lit("</nav>"), F.when(F.col("has_content"), body).otherwise("")).alias("html"),
        F.when(F.col("ok"), 200).otherwise(500).alias("status"),
    )
    root = _scratch(spark, "run")
    build.run(spark, seeds, scale.stage(site, "site"), Settings(f"{root}/packs", f"{root}/cache"), version="2024.01.31")
    return packs.load_packs(spark, f"{root}/packs").select("target", "chunk_id", "source_url", F.size("embedding").alias("width"))


# --- streaming -------------------------------------------------------------

@query
def stream_documents(spark, sf_dir):
    """Three micro-batches, each with ids of the ones before and some twice, compacted on the way; no reader is about between them."""
    path = _scratch(spark, "stream")
    docs = table(spark, sf_dir, "documents")
    spelled = docs.select(
        F.col("lang").alias("target"), F.col("doc_id").alias("doc_ord"), F.col("text").alias("markdown"),
        F.struct(F.concat_ws("/", "source", "doc_id").alias("source_url")).alias("metadata"),
    )
    older = spelled.withColumns({"markdown": F.concat(F.lit("older "), "markdown"), "doc_ord": F.col("doc_ord") - 1})
    batches = [
        spelled.withColumn("markdown", F.concat(F.lit("first "), "markdown")),
        spelled.filter("doc_ord % 2 = 0").unionByName(older.filter("doc_ord % 4 = 0")),
        spelled.filter("doc_ord % 3 = 0").withColumn("markdown", F.concat(F.lit("third "), "markdown")).unionByName(older.filter("doc_ord % 9 = 5")),
    ]
    for batch in batches:  # what has arrived since the run before is one micro-batch, of any number of files
        batch.write.mode("append").option("compression", doc_stream.CODEC).parquet(f"{path}/arriving")
        arriving = spark.readStream.schema(spelled.schema).parquet(f"{path}/arriving")
        doc_stream.stream_documents(arriving, path, f"{path}/checkpoint", encode.hashing_encoder(), fanout=2).awaitTermination()
        doc_stream.vacuum(spark, path)
    raw = doc_stream.read_log(spark, path, "chunks").select("target", "chunk_id", F.md5("text").alias("text_md5"))
    vectors = doc_stream.read_log(spark, path).select("target", "chunk_id", "source_url", F.size("embedding").alias("width"))
    return vectors.join(raw, ["target", "chunk_id"])


@query
def stream_triggers(spark, sf_dir):
    path = _scratch(spark, "triggers")
    events = table(spark, sf_dir, "events")
    known = events.filter(F.col("event_type") != "view").groupBy(F.col("event_type").alias("target")).agg(
        F.count(F.lit(1)).cast("int").alias("page_limit")
    )
    arriving = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet").select(
        F.when(F.col("event_type") != "error", F.create_map(F.lit("target"), F.col("event_type")))
        .otherwise(F.create_map(F.lit("other"), F.col("event_type"))).alias("attributes")
    )

    def act(chosen: DataFrame, batch_id: int) -> None:
        chosen.write.mode("overwrite").parquet(f"{path}/runs/batch={batch_id}")

    triggers.stream_triggers(arriving, known, act, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/runs").select("target", "page_limit").distinct()


@query
def trigger_run(spark, sf_dir):
    """Sites named by events are built and published; the same events, come again, publish nothing."""
    path = _scratch(spark, "events")
    docs = table(spark, sf_dir, "documents")
    at = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"))
    known = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).cast("int").alias("page_limit")).select(
        F.col("source").alias("target"), at.alias("url"), "page_limit"
    )
    first = docs.join(docs.groupBy("source").agg(F.min("doc_id").alias("doc_id")), ["source", "doc_id"])
    landed_pages = first.select(at.alias("url"), F.concat(F.lit("<main><h1>T</h1><p>"), "text", F.lit("</p></main>")).alias("html"), F.lit(200).alias("status"))
    named = docs.filter(F.col("source").rlike("[02468]$")).select(F.create_map(F.lit("target"), F.col("source")).alias("attributes"))
    named.coalesce(1).write.parquet(f"{path}/named")
    settings = Settings(f"{path}/packs", f"{path}/cache")
    for turn in ("once", "again"):
        events = spark.readStream.schema("attributes map<string,string>").parquet(f"{path}/named")
        build.run_on_triggers(
            spark, events, scale.stage(known, "known"), scale.stage(landed_pages, "landed"), settings, f"{path}/{turn}", "2024.01"
        ).awaitTermination()
    told = packs.manifest.read(spark, f"{settings.output_dir}/commits", packs._COMMIT).filter("table = 'vectors'")
    published = told.groupBy("target").agg(F.countDistinct("commit").alias("commits"))
    stored = packs.load_packs(spark, settings.output_dir).groupBy("target", "version").agg(F.count(F.lit(1)).alias("chunks"))
    return stored.join(published, "target")
