"""Documents to packs and graphs, and full runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators import chunking, encode, graph, triples
from pagemill.operators.crawl import crawl_order
from pagemill.operators.html import links_of, ok_pages, parse_pages
from pagemill.operators.scale import dedupe_last, stage
from pagemill.settings import Settings
from pagemill.sources import cache, packs
from pagemill.sources.pages import with_fallback
from pagemill.sources.targets import of_targets, select_targets
from pagemill.streaming.triggers import stream_triggers


def build_vectors(chunks: DataFrame, encoder: encode.EncoderFactory) -> DataFrame:
    """Vectors of chunks whose ids are unique, so nothing is encoded in vain."""
    return encode.embed(chunks.select("target", "chunk_id", "document", "source_url"), encoder).select(
        *packs.VECTOR_COLUMNS
    )


def build_pack(
    docs: DataFrame, encoder: encode.EncoderFactory, model: str = Settings.embedding_model, version: str | None = None
) -> dict[str, DataFrame]:
    """Vectors, raw chunks and metadata of ``docs(target, doc_ord, markdown, metadata)``.

    Chunks are staged once: all three tables are derived from them.
    """
    chunks = stage(chunking.retrieval_chunks(docs), "chunks")
    unique = packs.last_chunks(chunks)
    return {
        "vectors": build_vectors(unique, encoder),
        "chunks": packs.chunk_store(unique),
        "metadata": packs.pack_metadata(docs, chunks, model, version),
    }


def build_graph(
    docs: DataFrame,
    patterns: DataFrame,
    *,
    recognizer: Callable | None = None,
    labels: list[str] | None = None,
    ontology: DataFrame | None = None,
    model: Callable | None = None,
) -> dict[str, DataFrame]:
    """Nodes, edges, node pages, mentions and chunks of the documents' graph.

    Rules always run; the recogniser and the triple model only when given.
    """
    chunks = stage(chunking.graph_chunks(docs), "graph-chunks")
    found = [graph.rule_entities(chunks, patterns)]
    if recognizer is not None:
        found.append(graph.recognize_entities(chunks, recognizer, labels or []))
    edges = None
    if model is not None and ontology is not None:
        facts = stage(triples.extract_triples(chunks, ontology, model), "triples")
        found.append(graph.triple_endpoints(facts))
        edges = graph.merge_edges(facts)
    mentions = stage(graph.union_entities(*found), "mentions")
    if edges is None:
        edges = chunks.sparkSession.createDataFrame([], "target string, src string, dst string, label string")
    return {
        "nodes": graph.merge_nodes(mentions),
        "node_pages": graph.node_pages(mentions),
        "edges": edges,
        "mentions": mentions,
        "chunks": chunks.select("target", "chunk_id", "text", "source_url", "header"),
    }


def crawl_documents(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents of each target in crawl order: (target, doc_ord, markdown, metadata).

    Pages are read and parsed once; ``html`` ends there.
    """
    parsed = stage(parse_pages(ok_pages(pages).select("url", "html")), "parsed")
    landed = parsed.select("url", F.lit(True).alias("ok"), F.col("markdown").isNotNull().alias("has_content"))
    order = stage(crawl_order(targets, landed, links_of(parsed)), "crawl-order")
    wanted = parsed.select("url", "markdown", "metadata", F.length("markdown").alias("chars")).join(order.select("url").distinct(), "url", "left_semi")
    return order.join(dedupe_last(wanted, ["url"], ["chars"]), "url").select("target", "doc_ord", "markdown", "metadata")


def scrape_and_cache(
    targets: DataFrame, pages: DataFrame, settings: Settings, force: bool = False, fallback: DataFrame | None = None
) -> None:
    """Crawl targets that are not cached yet (all of them with ``force``) and cache the documents."""
    spark = targets.sparkSession
    if not force:
        done = cache.read_scrape_cache(spark, settings.cache_dir).select("target").distinct()
        targets = targets.join(done, "target", "left_anti")
    if targets.isEmpty():
        return
    docs = stage(crawl_documents(targets, pages), "documents")
    if fallback is not None:
        docs = with_fallback(docs, of_targets(fallback, targets).select(*docs.columns), targets=targets)
    cache.write_scrape_cache(docs, settings.cache_dir, force)


def process_cached(
    spark: SparkSession, targets: DataFrame, settings: Settings, encoder: encode.EncoderFactory, version: str | None = None
) -> dict[str, DataFrame]:
    """Packs of the cached documents of the given targets."""
    docs = of_targets(cache.read_scrape_cache(spark, settings.cache_dir), targets)
    if docs.isEmpty():
        raise LookupError("no cached documents for the chosen targets")
    return build_pack(docs, encoder, getattr(encoder, "model_name", settings.embedding_model), version)


def run(
    spark: SparkSession,
    targets: DataFrame,
    pages: DataFrame,
    settings: Settings,
    *,
    name: str = "all",
    version: str,
    encoder: encode.EncoderFactory | None = None,
    fallback: DataFrame | None = None,
    force: bool = False,
    prune: bool = False,
    run_name: str | None = None,
) -> DataFrame:
    """Full run for one target or all: crawl if needed, build, upsert, publish; returns the pack metadata.

    An unknown name and targets without any document are errors.  ``run_name``
    is noted in the commit.
    """
    chosen = select_targets(targets, name)
    if chosen.isEmpty():
        raise LookupError(f"unknown target: {name}")
    scrape_and_cache(chosen, pages, settings, force, fallback)
    built = process_cached(spark, chosen, settings, encoder or encode.hashing_encoder(), version)
    packs.upsert_pack(built, settings.output_dir, version, prune, run_name)
    return built["metadata"]


def run_on_triggers(
    spark: SparkSession, events: DataFrame, targets: DataFrame, pages: DataFrame, settings: Settings, checkpoint: str, version: str, **options
) -> StreamingQuery:
    """Run the pipeline for the targets that each micro-batch of events names.

    The commits are the ledger: targets that a batch has published already are
    neither crawled nor published when the batch comes again.
    """

    def act(chosen: DataFrame, batch_id: int) -> None:
        name = f"{version}.{batch_id:06d}"
        left = chosen.join(packs.handled(spark, settings.output_dir, name), "target", "left_anti")
        if not left.isEmpty():
            run(spark, left, pages, settings, version=name, force=True, run_name=name, **options)

    return stream_triggers(events, targets, act, checkpoint)
