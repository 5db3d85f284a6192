from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagemill.functions import hashing
from pagemill.operators import chunking, encode, retrieve
from pagemill.operators.html import METADATA_FIELDS, METADATA_TYPE
from pagemill.plans import answer, build
from pagemill.settings import Settings
from pagemill.sources import cache, packs, pages, targets

CONFIG = {"targets": {"a": {"url": "http://a.com/", "page_limit": 2}, "b": {"url": "http://b.com/"}}, "pipeline": {"cache_dir": "/c"}}
DOC = f"target string, doc_ord long, markdown string, metadata {METADATA_TYPE}"


def doc(target, order, md, url=None):
    return (target, order, md, (url,) + (None,) * (len(METADATA_FIELDS) - 1))


def test_targets(spark):
    df = targets.targets_df(spark, CONFIG)
    assert {(r.target, r.page_limit) for r in df.collect()} == {("a", 2), ("b", 1000)}
    assert targets.select_targets(df, "All").count() == 2 and targets.select_targets(df, "a").count() == 1
    asked = spark.createDataFrame([("a",), ("zz",)], "target string")
    assert [r.url for r in targets.resolve_targets(asked, df).collect()] == ["http://a.com/"]
    assert [r.target for r in targets.unknown_targets(asked, df).collect()] == ["zz"]
    with pytest.raises(ValueError):
        targets.targets_df(spark, {"targets": {"../x": {}}})
    assert Settings.from_config(CONFIG) == Settings(cache_dir="/c")


def test_cache_skips_replaces_and_keeps(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache.read_scrape_cache(spark, path).count() == 0
    cache.write_scrape_cache(spark.createDataFrame([doc("a", 1, "old"), doc("b", 1, "old")], DOC), path)
    cache.write_scrape_cache(spark.createDataFrame([doc("a", 1, "new"), doc("c", 1, "new")], DOC), path)
    cache.write_scrape_cache(spark.createDataFrame([doc("b", 1, "forced"), doc("b", 2, "forced")], DOC), path, force=True)
    cache.write_scrape_cache(spark.createDataFrame([], DOC), path, force=True)
    got = sorted((r.target, r.doc_ord, r.markdown) for r in cache.read_scrape_cache(spark, path).collect())
    assert got == [("a", 1, "old"), ("b", 1, "forced"), ("b", 2, "forced"), ("c", 1, "new")]


def test_json_cache(spark, tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text(json.dumps([{"markdown": "m", "metadata": {"source_url": "u", "unknown": 1}}, {"markdown": "n", "metadata": {}}], indent=4))
    bad.write_text('[{"markdown": ')
    got = cache.read_json_cache(spark, str(good), "a").orderBy("doc_ord").collect()
    assert [(r.target, r.markdown, r.metadata.source_url) for r in got] == [("a", "m", "u"), ("a", "n", None)]
    assert cache.read_json_cache(spark, str(bad), "a").count() == 0
    assert cache.read_json_cache(spark, str(tmp_path / "none.json"), "a").count() == 0


def test_fallback_and_feed(spark):
    primary = spark.createDataFrame([("a", "p")], "target string, markdown string")
    other = spark.createDataFrame([("a", "f"), ("b", "f")], "target string, markdown string")
    assert sorted(map(tuple, pages.with_fallback(primary, other).collect())) == [("a", "p"), ("b", "f")]
    assert pages.with_fallback(primary, other, enabled=False).count() == 1
    feed = spark.createDataFrame([("m", {"title": "T", "x": "1"}), ("n", None)], "markdown string, metadata map<string,string>")
    rows = pages.normalize_feed(feed).orderBy("markdown").collect()
    assert (rows[0].metadata.title, rows[0].extra) == ("T", {"x": "1"}) and (rows[1].metadata.title, rows[1].extra) == (None, {})


def test_upsert(spark):
    existing = spark.createDataFrame([("t", "1", "old"), ("t", "2", "old"), ("u", "1", "old")], "target string, chunk_id string, document string")
    new = spark.createDataFrame(
        [("t", "2", "mid", 1, 0), ("t", "2", "new", 2, 0), ("t", "3", "new", 1, 1)], "target string, chunk_id string, document string, doc_ord long, chunk_idx int"
    )
    once = packs.upsert_vectors(existing, new)
    want = [("t", "1", "old"), ("t", "2", "new"), ("t", "3", "new"), ("u", "1", "old")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, packs.upsert_vectors(once, new).collect())) == want
    assert sorted(map(tuple, packs.upsert_vectors(existing, new, prune=True).collect())) == want[1:]


def test_pack_counts_publish_and_load(spark, tmp_path):
    docs = spark.createDataFrame(
        [doc("a", 1, "# X\nhello"), doc("a", 2, "# Y\nworld", "u"), doc("a", 3, ""), doc("a", 4, "z"), doc("b", 1, None)], DOC
    )
    built = build.build_pack(docs, encode.hashing_encoder(), "m", "2024.01.02")
    meta = {r.framework: (r.documents_scraped, r.chunks_embedded, r.embedding_model) for r in built["metadata"].collect()}
    assert meta == {"a": (4, 3, "m"), "b": (1, 0, "m")}
    # two documents without a source share the id of their first chunk: the later one stays
    assert sorted(r.text for r in built["chunks"].collect()) == ["world", "z"]
    root = str(tmp_path / "packs")
    packs.publish_pack(built, root, "2024.01.02")
    changed = {**built, "vectors": built["vectors"].withColumn("document", F.lit("v2"))}
    packs.publish_pack(changed, root, "2024.02.01")
    assert {r.document for r in packs.load_pack(spark, root, "a").collect()} == {"v2"}
    assert {r.document for r in packs.load_pack(spark, root, "a", "2024.01.02").collect()} == {"world", "z"}
    assert packs.load_packs(spark, root).count() == 2
    with pytest.raises(packs.PackNotFound):
        packs.load_pack(spark, root, "missing")
    with pytest.raises(packs.PackNotFound):
        packs.load_pack(spark, str(tmp_path / "nowhere"), "a")
    with pytest.raises(packs.PackNotFound):
        packs.publish_pack({"vectors": built["vectors"]}, root, "1")


def test_writers_and_version_stamp(spark, tmp_path):
    docs = spark.createDataFrame([doc("a", 1, "# X\nhello"), doc("a", 2, "# Y\nworld"), doc("b", 1, "z")], DOC)
    chunks = chunking.retrieval_chunks(docs)
    packs.write_chunks(chunks, str(tmp_path / "parquet"))
    packs.write_chunks(chunks, str(tmp_path / "json"), json=True)
    for stored in (spark.read.parquet(str(tmp_path / "parquet")), spark.read.json(str(tmp_path / "json"))):
        assert sorted((r.target, r.text) for r in stored.collect()) == [("a", "world"), ("b", "z")]
    packs.write_pack_metadata(packs.pack_metadata(docs, chunks, "m", "1"), str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).count() == 2
    nodes = spark.createDataFrame([("a", "n", "L", 1)], "target string, text string, label string, n_chunks long")
    edges = spark.createDataFrame([("a", "n", "n", "self")], "target string, src string, dst string, label string")
    packs.write_graph(nodes, edges, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph/edges")).first().label == "self"
    late = spark.createDataFrame([("2024-03-01 23:30:00-05:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert late.select(hashing.version_stamp(F.col("t"))).first()[0] == "2024.03.02"


def test_only_the_targets_partition_is_read(spark, tmp_path):
    built = build.build_pack(spark.createDataFrame([doc(t, 1, "text here", t) for t in "abc"], DOC), encode.hashing_encoder(), version="1")
    packs.publish_pack(built, str(tmp_path), "1")
    plan = packs.load_pack(spark, str(tmp_path), "b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(target" in plan and "(target" in plan.split("PartitionFilters")[1]


def test_full_run_and_answers(spark, tmp_path):
    site = [
        ("http://a.com/", '<title>Home</title><main><h1>Alpha</h1>apples and pears<a href="/2">n</a><a href="/3#x">m</a></main>', 200),
        ("http://a.com/2", "<main><h1>Beta</h1>bananas in boats</main>", 200),
        ("http://a.com/3", "<main>cherries</main>", 200),
        ("http://b.com/", '<nav><a href="/x">x</a></nav>', 200),
        ("http://b.com/x", "<main>gone</main>", 500),
    ]
    landed = spark.createDataFrame(site, "url string, html string, status int")
    settings = Settings(output_dir=str(tmp_path / "packs"), cache_dir=str(tmp_path / "cache"))
    backup = spark.createDataFrame([doc("a", 1, "unused"), doc("b", 1, "from the other feed")], DOC)
    chosen = targets.targets_df(spark, CONFIG)
    meta = build.run(spark, chosen, landed, settings, version="2024.01.02", fallback=backup)
    assert {r.framework: (r.documents_scraped, r.chunks_embedded) for r in meta.collect()} == {"a": (2, 2), "b": (1, 1)}
    stored = packs.load_packs(spark, settings.output_dir)
    queries = spark.createDataFrame(
        [(1, "a", "bananas boats", 1), (2, "b", "feed", 5), (3, "zz", "x", 1)], "query_id long, target string, query_text string, n_results int"
    )
    answers = {r.query_id: r for r in answer.query_packs(stored, queries, encode.hashing_encoder()).collect()}
    assert [m.source_url for m in answers[1].metadatas] == ["http://a.com/2"] and answers[1].documents == ["bananas in boats"]
    assert answers[3].documents == [] and answers[3].distances == []
    texts = {r.query_id: r.context for r in answer.answer_context(stored, queries, encode.hashing_encoder()).collect()}
    assert texts[1].startswith("Source: http://a.com/2\nContent: bananas in boats\n\n---\n\nSource: http://a.com/\n")
    assert texts[2] == "Source: N/A\nContent: from the other feed" or texts[2].startswith("Source: unknown")
    assert texts[3] == "Error: The knowledge base for the target 'zz' does not exist. Please try a different target."
    raw = packs.load_packs(spark, settings.output_dir, "chunks")
    hits = stored.filter("target = 'a'").select("target", "chunk_id")
    assert {r.header for r in retrieve.attach_raw_text(hits, raw).collect()} == {"Alpha", "Beta"}


def test_names_that_look_like_numbers(spark, tmp_path):
    for version in ("2024.9", "2024.10"):
        rows = spark.createDataFrame([("007", f"c{version}", [1.0], "d", "u")], "target string, chunk_id string, embedding array<float>, document string, source_url string")
        meta = spark.createDataFrame([("007", version, 1, 1, "m")], "framework string, version string, documents_scraped long, chunks_embedded long, embedding_model string")
        packs.publish_pack({"vectors": rows, "chunks": rows.drop("embedding"), "metadata": meta}, str(tmp_path), version)
    got = packs.load_pack(spark, str(tmp_path), "007", "2024.10").collect()
    assert [(r.target, r.version, r.chunk_id) for r in got] == [("007", "2024.10", "c2024.10")]
    assert {(r.target, r.version) for r in packs.load_packs(spark, str(tmp_path)).collect()} == {("007", "2024.10")}  # targets are texts, versions are compared part by part


def _landed(spark, bodies):
    rows = [(f"http://h/{n}", f"<main><h1>T</h1><p>{b}</p></main>" + "".join(f'<a href="/{m}">l</a>' for m in bodies), 200) for n, b in bodies.items()]
    return spark.createDataFrame(rows, "url string, html string, status int")


def test_a_second_run_upserts_prunes_and_names_its_encoder(spark, tmp_path):
    chosen = targets.targets_df(spark, {"targets": {"t": {"url": "http://h/1", "page_limit": 9}}})
    words = "one two three four five six seven eight"
    settings = Settings(str(tmp_path / "packs"), str(tmp_path / "cache"), "some-other-model")

    def texts(version, bodies, **options):
        meta = build.run(spark, chosen, _landed(spark, bodies), settings, version=version, force=True, **options)
        assert [r.embedding_model for r in meta.collect()] == ["hashing-64"]
        stored = packs.load_pack(spark, settings.output_dir, "t", version)
        return sorted(r.document.split()[-1] for r in stored.collect())

    assert texts("2024.01.01", {"1": f"{words} a", "2": f"{words} b"}) == ["a", "b"]
    assert texts("2024.01.02", {"1": f"{words} c", "3": f"{words} d"}) == ["b", "c", "d"]
    assert texts("2024.01.03", {"1": f"{words} e"}, prune=True) == ["e"]
    with pytest.raises(LookupError, match="unknown target"):
        build.run(spark, chosen, _landed(spark, {"1": words}), settings, name="nope", version="2024.01.04")
    empty = targets.targets_df(spark, {"targets": {"u": {"url": "http://none/", "page_limit": 9}}})
    with pytest.raises(LookupError, match="no cached documents"):
        build.run(spark, empty, _landed(spark, {"1": words}), settings, version="2024.01.05")


def test_the_page_limit_holds_for_the_fallback(spark):
    primary = spark.createDataFrame([("a", 1)], "target string, doc_ord long")
    other = spark.createDataFrame([(t, i) for t in "abc" for i in range(10, 15)], "target string, doc_ord long")
    limits = spark.createDataFrame([("a", 2), ("b", 2), ("c", None)], "target string, page_limit int")
    got = sorted(map(tuple, pages.with_fallback(primary, other, targets=limits).collect()))
    assert got == [("a", 1), ("b", 10), ("b", 11)] + [("c", i) for i in range(10, 15)]


def test_events_run_the_pipeline(spark, tmp_path):
    chosen = targets.targets_df(spark, {"targets": {t: {"url": f"http://h/{t}", "page_limit": 9} for t in "12"}})
    landed = _landed(spark, {"1": "one two three four five six seven", "2": "eight nine ten eleven twelve thirteen"})
    spark.createDataFrame([({"target": "2"},), ({"other": "1"},)], "attributes map<string,string>").write.parquet(str(tmp_path / "events"))
    events = spark.readStream.schema("attributes map<string,string>").parquet(str(tmp_path / "events"))
    settings = Settings(str(tmp_path / "packs"), str(tmp_path / "cache"))
    build.run_on_triggers(spark, events, chosen, landed, settings, str(tmp_path / "checkpoint"), "2024.01.01").awaitTermination()
    assert {(r.target, r.version) for r in packs.load_packs(spark, settings.output_dir).collect()} == {("2", "2024.01.01.000000")}


def _tables(spark, rows, version):
    """Pack tables of (target, chunk_id, text) rows."""
    df = spark.createDataFrame(rows, "target string, chunk_id string, document string")
    vectors = df.select("target", "chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding"), "document", F.lit("u").alias("source_url"))
    chunks = df.select("target", "chunk_id", F.lit(0).alias("chunk_idx"), F.col("document").alias("text"), F.lit("u").alias("source_url"), F.lit("h").alias("header"))
    meta = df.groupBy(F.col("target").alias("framework")).agg(F.count(F.lit(1)).alias("documents_scraped")).selectExpr(
        "framework", f"'{version}' AS version", "documents_scraped", "documents_scraped AS chunks_embedded", "'m' AS embedding_model")
    return {"vectors": vectors, "chunks": chunks, "metadata": meta}


def test_a_publish_that_stops_between_tables_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    packs.publish_pack(_tables(spark, [("a", "1", "old"), ("b", "1", "old")], "1"), root, "1")
    real = packs._write

    def stops(rows, root, name, publication):
        if name == "chunks":
            raise OSError("lost")
        return real(rows, root, name, publication)

    monkeypatch.setattr(packs, "_write", stops)
    for publish in (packs.publish_pack, packs.upsert_pack):
        with pytest.raises(OSError):
            publish(_tables(spark, [("a", "1", "new"), ("c", "1", "new")], "2"), root, "2")
    monkeypatch.undo()
    for table, column in (("vectors", "document"), ("chunks", "text")):
        assert {(r.target, r.version, r[column]) for r in packs.load_packs(spark, root, table).collect()} == {("a", "1", "old"), ("b", "1", "old")}
    with pytest.raises(packs.PackNotFound):
        packs.load_pack(spark, root, "c")
    # the same version again, whole: its last commit counts
    packs.publish_pack(_tables(spark, [("a", "1", "mid"), ("a", "2", "mid")], "2"), root, "2")
    packs.publish_pack(_tables(spark, [("a", "1", "end")], "2"), root, "2")
    assert [(r.chunk_id, r.document) for r in packs.load_pack(spark, root, "a").collect()] == [("1", "end")]


def test_upserts_rewrite_touched_parts_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packs, "PART_ROWS", 10)
    root = str(tmp_path)
    old = [(t, str(i), "old") for t, n in (("big", 95), ("small", 3), ("rest", 20)) for i in range(n)]
    packs.publish_pack(_tables(spark, old, "1"), root, "1")
    first = {(r.target, r.table, r.part): r.publication for r in packs.latest(spark, root).collect()}
    assert len({k for k in first if k[:2] == ("big", "chunks")}) > 5
    packs.upsert_pack(_tables(spark, [("big", "7", "new"), ("big", "7x", "new"), ("fresh", "1", "new")], "2"), root, "2")
    entries = {(r.target, r.table, r.part): (r.version, r.publication) for r in packs.latest(spark, root).collect()}
    moved = {k for k, (_, p) in entries.items() if first.get(k) != p}
    assert {k[0] for k in moved} == {"big", "fresh"} and len({k for k in moved if k[:2] == ("big", "vectors")}) <= 2
    assert {v for (t, _, _), (v, _) in entries.items() if t in ("small", "rest")} == {"1"}
    got = {(r.target, r.chunk_id): r.document for r in packs.load_packs(spark, root).collect()}
    want = {(t, i): d for t, i, d in old} | {("big", "7"): "new", ("big", "7x"): "new", ("fresh", "1"): "new"}
    assert got == want and {(r.target, r.chunk_id): r.text for r in packs.load_packs(spark, root, "chunks").collect()} == want
    touched = packs.latest(spark, root).filter("target = 'big' and table = 'vectors' and part = 3")
    plan = packs._rows_of(packs._table(spark, f"{root}/vectors"), touched)._jdf.queryExecution().executedPlan().toString()
    assert "target" in plan.split("PartitionFilters: [")[1] and packs._rows_of(packs._table(spark, f"{root}/vectors"), touched).inputFiles()
    # many more rows than before are dealt over more parts, the old ones with them
    packs.upsert_pack(_tables(spark, [("small", f"n{i}", "new") for i in range(70)], "3"), root, "3")
    assert packs.load_pack(spark, root, "small").count() == 73
    packs.upsert_pack(_tables(spark, [("small", "only", "new")], "4"), root, "4", prune=True)
    assert [r.chunk_id for r in packs.load_pack(spark, root, "small").collect()] == ["only"]


def test_queries_must_be_encoded_as_the_packs(spark):
    meta = spark.createDataFrame([("a", "hashing-64"), ("b", "other")], "framework string, embedding_model string")
    asked = spark.createDataFrame([(1, "a", "x")], "query_id long, target string, query_text string")
    answer.check_encoder(meta, asked, encode.hashing_encoder())
    with pytest.raises(ValueError, match="b \\(other\\)"):
        answer.check_encoder(meta, asked.withColumn("target", F.lit("b")), encode.hashing_encoder())


def test_rows_equal_in_order_have_one_winner(spark):
    page = "<main><h1>T</h1><p>{}</p></main>"
    rows = [("http://h/1", page.format(b), 200) for b in ("aaaa", "bbbb")] * 2
    chosen = targets.targets_df(spark, {"targets": {"t": {"url": "http://h/1", "page_limit": 9}}})
    landed = spark.createDataFrame(rows, "url string, html string, status int")
    found = {build.crawl_documents(chosen, landed.repartition(n, "html" if n > 1 else "url")).first().markdown for n in (1, 3, 7)}
    assert len(found) == 1 and build.crawl_documents(chosen, landed).count() == 1


def test_every_chunk_is_encoded_once(spark, tmp_path):
    # counting the rows of a table must not make them
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def run(texts):
            seen.add(len(texts))
            return [[1.0, float(len(t))] for t in texts]

        return run

    for n, publish in enumerate((packs.publish_pack, packs.upsert_pack, packs.upsert_pack), 1):
        tables = _tables(spark, [("a", str(i), "x" * i) for i in range(50 * n)], str(n))
        vectors = encode.embed(tables["vectors"].drop("embedding"), factory)
        publish({**tables, "vectors": vectors.select(*tables["vectors"].columns)}, str(tmp_path), str(n))
        assert seen.value == 50 * n
        assert packs.load_packs(spark, str(tmp_path)).count() == 50 * n
        seen.value = 0
