from __future__ import annotations

import random
import re

import pytest

from pagemill.llm import paragraphs as P
from pagemill.llm import queries


def prose(rng, n, name="w"):
    return " ".join(f"{name}{rng.randrange(10**7)}" + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))


def test_pasted_passages_are_found_and_cut(spark):
    rng = random.Random(4)
    passage = prose(rng, 55, "p")
    rows = [(i, prose(rng, 60 + i) + " " + passage + " " + prose(rng, 70)) for i in range(1, 12)]
    rows += [(i, prose(rng, 120)) for i in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", P.F.lit("x"))
    got = P.repeated(docs).collect()
    assert {r.doc_id for r in got} == set(range(1, 12)) and {r.kept_doc_id for r in got} == {1}
    assert {r.doc_id for r in got if r.removed} == set(range(2, 12))
    texts = dict(rows)
    for r in got:
        a, b = texts[r.doc_id][r.start : r.end], texts[r.kept_doc_id][r.kept_start :]
        assert b.startswith(a) and set(re.findall("p[0-9]+", a))
    cut = {r.doc_id: r.text for r in P.remove(docs).collect()}
    assert cut[1] == texts[1] and all(cut[i] == texts[i] for i in range(20, 30))
    middle = passage.split()[27]
    assert all(middle not in cut[i] for i in range(2, 12))
    assert all(texts[i].split()[0] in cut[i] and texts[i].split()[-1] in cut[i] for i in cut)


def plain_shingles(line):
    w = re.findall(r"[^\W_]+", line.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}, len(w)


def test_similar_lines_against_all_pairs(spark):
    rng = random.Random(6)
    base = [[f"v{rng.randrange(10**6)}" for _ in range(70)] for _ in range(12)]
    lines = []
    for words in base:
        for k in range(rng.randrange(1, 30)):  # more than a bucket holds, too
            changed = list(words)
            for _ in range(k % 4):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(10**6)}"
            lines.append(" ".join(changed))
    rng.shuffle(lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = P.stage(P.paragraphs(docs), "t")
    whole = {r.content: r.doc_id for r in found.filter(P.F.size("keys") == P.BANDS).collect()}
    got = {tuple(sorted((whole[r.a], whole[r.b]))) for r in P._near(docs, found, "text", "doc_id").collect() if r.a in whole and r.b in whole}
    sets = {i: plain_shingles(t)[0] for i, t in enumerate(lines)}
    want = {(i, j) for i in whole.values() for j in whole.values() if i < j and lines[i] != lines[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert got <= want
    classes = {r.doc_id: r.component_id for r in P.repeated(docs).collect() if r.end - r.start == len(lines[r.doc_id])}
    assert all(classes[i] == classes[j] for i, j in want)


def test_odd_rows(spark):
    long = " ".join(f"a{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "a b"), (None, long), (None, long), (4, long.upper()), (5, f"{long}\n{long}"), (6, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) n_chars", "1 AS content")
    got = P.repeated(docs).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(None, 4), (4, 4), (5, 4)}
    cut = P.remove(docs)
    assert cut.columns == docs.columns and cut.count() == 8
    out = {(r.doc_id, r.text, r.n_chars) for r in cut.collect()}
    assert out == {(1, None, None), (2, "", 0), (3, "a b", 3), (None, "", 0), (4, long.upper(), len(long)), (5, "", 0), (6, "x" * 100_000, 100_000)}
    assert P.repeated(docs.limit(0)).count() == 0 and P.remove(docs.limit(0)).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(8)
    text = prose(rng, 4000)
    whole = P._block([(0, 0, text)])
    monkeypatch.setattr(P.W, "BLOCK", 9000)
    monkeypatch.setattr(P.W.pieces, "__defaults__", (9000,))
    monkeypatch.setattr(P.W, "OVERLAP", 2000)
    cut = P.pd.concat([P._block(parts) for parts in P.W.parts([text, None, text])])
    for n in (0, 2):
        mine = cut[cut["text"] == n]
        assert set(zip(whole["start"], whole["end"], whole["content"])) <= set(zip(mine["start"], mine["end"], mine["content"]))


def test_query_catches_shared_passages(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op1_substring_dedup(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    flagged = {r.doc_id for r in got}
    runs = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(i)
    assert {i for s in runs.values() if len(s) > 1 for i in s} <= flagged


def joined(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    classes = {}
    for x in list(root):
        classes.setdefault(find(x), set()).add(x)
    return {frozenset(c) for c in classes.values()}


@pytest.mark.parametrize("block", [1 << 18, 20_000])
def test_crowds_that_resemble_only_their_original(spark, monkeypatch, block):
    """A line and 600 copies of it, each with its own changes: links go through the original, in one block or many."""
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(11)
    words = [f"v{i}" for i in range(200)]
    lines = [" ".join(words)]
    for i in range(600):
        changed = list(words)
        for j in rng.sample(range(200), 4):
            changed[j] = f"x{i}y{j}"
        lines.append(" ".join(changed))
    rng.shuffle(lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = P.stage(P.paragraphs(docs), "t")
    whole = {r.content: r.doc_id for r in found.filter(P.F.size("keys") == P.BANDS).collect()}
    got = [(whole[r.a], whole[r.b]) for r in P._near(docs, found, "text", "doc_id").collect()]
    sets = [plain_shingles(t)[0] for t in lines]
    want = [(i, j) for i in range(601) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in want}
    big = max(joined(want), key=len)
    assert len(big) > 500 and len(max(joined(got), key=len)) >= 0.99 * len(big)


def test_forest_joins_what_all_pairs_join():
    rng = random.Random(12)
    for _ in range(30):
        base = rng.sample(range(10**6), rng.randrange(5, 60))
        sets = []
        for _ in range(rng.randrange(2, 80)):
            one = set(base if rng.random() < 0.8 else rng.sample(range(10**6), 20))
            for x in rng.sample(sorted(one), rng.randrange(0, 1 + len(one) // 4)):
                one.remove(x)
                if rng.random() < 0.7:
                    one.add(rng.randrange(10**6))
            sets.append(one)
        n = range(len(sets))
        want = [(i, j) for i in n for j in n if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        got = P._forest(P.np.arange(len(sets)), [P.np.array(sorted(x)) for x in sets])
        assert {tuple(sorted(p)) for p in got} <= set(want) and joined(got) == joined(want)


def test_copied_passages_go_whole(spark):
    """Nothing of a passage of 52 words and more stays in a copy, neither at its edges nor between runs."""
    rng = random.Random(13)
    rows = []
    for k, n in enumerate((52, 75, 120, 300)):
        passage = prose(rng, n, "p")
        rows += [(10 * k + i, f"{prose(rng, 40 + i, 'f')} {passage} {prose(rng, 60, 'f')}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut, texts = {r.doc_id: r.text for r in P.remove(docs).collect()}, dict(rows)
    for i, t in cut.items():
        kept = t if i % 10 == 0 else " ".join(re.findall("f[0-9]+", texts[i]))
        assert re.findall("[pf][0-9]+", t) == re.findall("[pf][0-9]+", kept)


def test_clashing_columns(spark):
    long = " ".join(f"a{i}" for i in range(60))
    head, tail = (" ".join(f"{c}{i}" for i in range(50)) for c in "ht")
    docs = spark.createDataFrame([(1, long, 5, 6, 7, 8), (2, f"{head} {long} {tail}", 5, 6, 7, 8)], "doc_id long, text string, _doc int, _spans int, _start int, `_cut` int")
    got = {r.doc_id: r for r in P.remove(docs).collect()}
    assert P.remove(docs).columns == docs.columns and got[1].text == long and got[2].text == f"{head} {tail}" and (got[2]._doc, got[2]._cut) == (5, 8)


def test_bands_dealt_over_blocks_are_not_broadcast(spark):
    bands = spark.createDataFrame([(1, 7, 20, 10 * P.BLOCK)], "content long, key long, n long, weight long")
    sets = spark.createDataFrame([(1, [1, 2])], "content long, shingles array<long>")
    plan = P._crowded(bands, sets)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [content" in plan and "BroadcastHashJoin" not in plan
