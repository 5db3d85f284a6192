from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import chunking, encode, scale
from pagemill.operators.html import METADATA_TYPE
from pagemill.sources import targets
from pagemill.streaming import documents, triggers

DOC = "target string, doc_ord long, markdown string, metadata struct<source_url:string>"


def test_batches_add_up_to_the_batch_result(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("t", i, f"# H{i}\nbody {i}\n# Tail\nmore {i}", (f"u{i % 7}",)) for i in range(10)]
    for i in range(0, 10, 2):
        spark.createDataFrame(rows[i : i + 2], DOC).coalesce(1).write.mode("append").parquet(source)

    def drain():
        stream = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(source)
        documents.stream_documents(stream, out, str(tmp_path / "cp"), encode.hashing_encoder()).awaitTermination()

    drain()
    batch = chunking.retrieval_chunks(spark.createDataFrame(rows, DOC))
    ids = {r.chunk_id for r in batch.select("chunk_id").collect()}
    state = documents.read_log(spark, out)
    assert {r.chunk_id for r in state.collect()} == ids and state.count() == len(ids)
    assert spark.read.parquet(f"{out}/vectors").select("run").distinct().count() == len(documents.live_runs(spark, out)) == 5

    spark.createDataFrame([("t", 99, "# H\nrewritten", ("u0",))], DOC).coalesce(1).write.mode("append").parquet(source)
    drain()
    latest = {r.chunk_id: r.document for r in documents.read_log(spark, out).collect()}
    assert set(latest) == ids and "rewritten" in latest.values()
    raw = documents.read_log(spark, out, "chunks")
    assert raw.count() == len(ids) and raw.filter(F.col("text") == "rewritten").count() == 1


def test_compaction_merges_level_by_level(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(9):
        rows = [("7", i, f"# H\nfirst {i}", (f"u{i % 4}",)), ("7", i, f"# H\nagain {i}", (f"u{i % 4}",)), ("7", 50 + i, f"# H\nonly {i}", (f"v{i}",))]
        spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(source)
    documents.stream_documents(stream, out, str(tmp_path / "cp"), encode.hashing_encoder()).awaitTermination()

    def state(table):
        return sorted((r.target, r.chunk_id, r[3 if table == "vectors" else 3]) for r in documents.read_log(spark, out, table).collect())

    before = {t: state(t) for t in documents.TABLES}
    assert len(before["chunks"]) == 13 and {x[0] for x in before["chunks"]} == {"7"}
    assert documents.compact(spark, out, 3) == [(0, 8)]
    assert {t: state(t) for t in documents.TABLES} == before
    runs = {r.run for r in spark.read.parquet(f"{out}/vectors").select("run").distinct().collect()}
    assert {"b0-2", "b3-5", "b6-8", "b0-8"} <= runs
    # a merge whose record is missing does not count, nor does a batch without one
    documents.write_by_target(documents.read_log(spark, out).limit(1).withColumn("run", F.lit("b9-9")), f"{out}/vectors", "run")
    assert {t: state(t) for t in documents.TABLES} == before


def test_compaction_while_streaming(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(5):
        spark.createDataFrame([("t", i, f"# H\ntext {i}", ("u",))], DOC).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(source)
    documents.stream_documents(stream, out, str(tmp_path / "cp"), encode.hashing_encoder(), fanout=2).awaitTermination()
    assert documents.live_runs(spark, out) == [(0, 3), (4, 4)]
    assert documents.read_log(spark, out).count() == 1


def test_disk_holds_live_runs_and_nothing_staged(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    monkeypatch.setattr(scale, "staging_root", lambda spark: str(tmp_path / "shared"))
    for i in range(5):
        rows = [(t, j, f"# H\ntext {i}", (f"u{j}",)) for t in ("a", None) for j in range(i, 8)]
        spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(source)
    documents.stream_documents(stream, out, str(tmp_path / "cp"), encode.hashing_encoder(), fanout=2).awaitTermination()
    assert not list((tmp_path / "shared").glob("*/stream-chunks*"))

    def state(table):
        return sorted(map(str, documents.read_log(spark, out, table).collect()))

    def folders():
        return {(p.parts[-3], p.name[4:]) for p in (tmp_path / "out").glob("*/target=*/run=*")}

    before = {t: state(t) for t in documents.TABLES}
    assert len(before["chunks"]) == 16 and sum("text 4" in x for x in before["chunks"]) == 8
    documents.write_by_target(documents.read_log(spark, out).limit(1).withColumn("run", F.lit("b5-5")), f"{out}/vectors", "run")
    documents.vacuum(spark, out)
    assert folders() == {(t, run) for t in documents.TABLES for run in ("b0-3", "b4-4")} | {("vectors", "b5-5")}
    assert {t: state(t) for t in documents.TABLES} == before and documents.live_runs(spark, out) == [(0, 3), (4, 4)]


def test_reading_moves_no_row_of_the_newest_run(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def drain():
        stream = spark.readStream.schema(DOC).parquet(source)
        documents.stream_documents(stream, out, str(tmp_path / "cp"), encode.hashing_encoder()).awaitTermination()

    for text in ("first", "second"):
        spark.createDataFrame([("t", 1, text, ("u",)), ("t", 2, text, (text,))], DOC).coalesce(1).write.mode("append").parquet(source)
        drain()
    found = documents.read_log(spark, out, "chunks")
    assert sorted(r.text for r in found.collect()) == ["first", "second", "second"]
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    # 7 and 07 are told apart when written, but their folders are read as one number
    spark.createDataFrame([("7", 1, "a", ("w",)), ("07", 2, "b", ("w",))], DOC).coalesce(1).write.parquet(str(tmp_path / "more"))
    stream = spark.readStream.schema(DOC).parquet(str(tmp_path / "more"))
    documents.stream_documents(stream, str(tmp_path / "numbers"), str(tmp_path / "cp2"), encode.hashing_encoder()).awaitTermination()
    assert [r.target for r in documents.read_log(spark, str(tmp_path / "numbers")).collect()] == ["7"]


def test_large_shares_of_a_target_are_written_where_they_are(spark, tmp_path, monkeypatch):
    rows = spark.range(40).select(F.lit("t").alias("target"), "id")
    table = scale.stage(rows, "rows")
    assert not documents._balanced(table)
    monkeypatch.setattr(documents, "FILE_ROWS", 1)
    assert documents._balanced(table)
    documents._write(table, str(tmp_path / "log"), "b0-0", True)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 40


def test_triggers_resolve_targets(spark, tmp_path):
    schema = "attributes map<string,string>"
    source = str(tmp_path / "events")
    rows = [({"target": "a"},), ({"target": "a"},), ({"target": "zz"},), ({"target": ""},), ({"x": "y"},), (None,)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    known = targets.targets_df(spark, {"targets": {"a": {"url": "http://a/"}, "b": {"url": "http://b/"}}})
    ran: list = []
    triggers.stream_triggers(
        spark.readStream.schema(schema).parquet(source), known, lambda df, _: ran.extend(r.target for r in df.collect()), str(tmp_path / "cp")
    ).awaitTermination()
    assert ran == ["a"] and METADATA_TYPE.startswith("struct")


def test_batches_of_the_query_arrive_in_many_files(spark, tmp_path, monkeypatch):
    from pagemill.plans import catalog

    rows = [(i, f"# H{i}\nsome words of text number {i}", "en", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.repartition(4).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    monkeypatch.setattr(catalog, "_scratch", lambda spark, label: str(tmp_path / label))
    found = catalog.queries()["stream_documents"](spark, str(tmp_path / "in"))
    assert found.count() == 40
    assert len(list((tmp_path / "stream" / "arriving").glob("*.parquet"))) > 3
    assert len(list((tmp_path / "stream" / "checkpoint" / "commits").glob("[0-9]*"))) == 3


def test_the_query_keeps_no_run_that_a_merge_replaced(spark, tmp_path, monkeypatch):
    from pagemill.plans import catalog

    rows = [(i, f"# H{i}\nsome words of text number {i}", "en", "s") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "in" / "documents.parquet"))
    monkeypatch.setattr(catalog, "_scratch", lambda spark, label: str(tmp_path / label))
    assert catalog.queries()["stream_documents"](spark, str(tmp_path / "in")).count() == 20
    assert {p.name for p in (tmp_path / "stream").glob("*/target=*/run=*")} == {"run=b0-1", "run=b2-2"}
