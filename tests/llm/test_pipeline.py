from __future__ import annotations

import re

import corpus_pipeline
from pagemill.operators.scale import stage
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, first = docs.columns, {r.doc_id: r for r in docs.collect()}
    seen = []
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        seen.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    known, single, cut, clean, tokens = seen
    assert {r.doc_id for r in known} == {i for i, r in first.items() if re.search(r"[^\W\d_]", r.text or "")}
    fps = [plain_fingerprint(r.text) for r in known]
    groups = plain_components(fps, [r.doc_id for r in known], 2)
    assert {r.doc_id for r in single} == {root for _, root in groups} and len(single) == len({root for _, root in groups})
    assert {r.doc_id for r in cut} == {r.doc_id for r in single}
    assert all(r.n_chars == len(r.text) for r in cut if r.text != first[r.doc_id].text)
    runs = {}
    for r in cut:
        w = re.findall(r"[^\W_]+", r.text.lower())
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(r.doc_id)
    assert all(len(s) == 1 for s in runs.values())
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r.doc_id for r in cut if any(" ".join(i) in " ".join(re.findall(r"[^\W_]+", r.text.lower())) for i in items)}
    assert held and held.isdisjoint(r.doc_id for r in clean)
    assert len(clean) >= len(cut) - 2 * len(held)
    assert {r.doc_id for r in tokens} == {r.doc_id for r in clean} and all(r.round_trip for r in tokens)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 0
