from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pagemill.operators import graph, triples
from pagemill.plans import build
from pagemill.sources import targets

CHUNK = "target string, doc_ord long, chunk_idx int, chunk_id string, text string"


def mention(*rows):
    return [(t, d, i, f"c{d}{i}", e, label, p) for t, d, i, e, label, p in rows]


MENTION = "target string, doc_ord long, chunk_idx int, chunk_id string, entity string, label string, priority int"


def test_nodes_keep_first_label_and_chunk_order(spark):
    rows = mention(
        ("t", 2, 0, "X", "LATE", 0), ("t", 1, 3, "X", "MODEL", 1), ("t", 1, 3, "X", "RULE", 0), ("t", 1, 0, "Y", "B", 0),
        ("t", 1, 0, "Y", "A", 0), ("u", 1, 0, "X", "OTHER", 2), ("t", 1200, 0, "X", "Z", 0),
    )
    df = graph.union_entities(spark.createDataFrame(rows, MENTION), spark.createDataFrame(rows, MENTION))
    nodes = {(r.target, r.text): (r.label, r.n_chunks) for r in graph.merge_nodes(df).collect()}
    assert nodes == {("t", "X"): ("RULE", 3), ("t", "Y"): ("A", 1), ("u", "X"): ("OTHER", 1)}
    pages = {(r.target, r.text, r.page): r.chunk_ids for r in graph.node_pages(df, 1000).collect()}
    assert pages[("t", "X", 0)] == ["c13", "c20"] and pages[("t", "X", 1)] == ["c12000"]


def test_edges_keep_last_predicate(spark):
    rows = [
        ("t", 1, 0, "c", 0, " a ", "first", "b"), ("t", 2, 0, "d", 0, "a", "early", "b"), ("t", 2, 0, "d", 1, "a", " last ", "b "),
        ("t", 2, 0, "d", 2, "b", "back", "a"), ("t", 2, 0, "d", 3, "  ", "blank", "a"),
    ]
    facts = spark.createDataFrame(
        rows, "target string, doc_ord long, chunk_idx int, chunk_id string, pos int, subject string, predicate string, object string"
    )
    edges = graph.merge_edges(facts)
    assert {(r.src, r.dst, r.label) for r in edges.collect()} == {("a", "b", "last"), ("b", "a", "back")}
    only_a = spark.createDataFrame([("t", "a")], "target string, text string")
    assert graph.valid_edges(edges, only_a).count() == 0
    ends = graph.triple_endpoints(facts)
    assert {(r.chunk_id, r.entity, r.label) for r in ends.collect()} == {(c, e, "ENTITY") for c in "cd" for e in "ab"}


@pytest.mark.parametrize("bound", [128, 0])
def test_rules_match_python(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "_MAX_LITERAL_PATTERNS", bound)
    config = {"targets": {
        "t": {"patterns": [{"label": "CLS", "pattern": r"class (\w+)"}, {"label": "OPT", "pattern": r"(?:key=(\w*))|skip"}]},
        "u": {"patterns": [{"label": "NUM", "pattern": r"(\s*\d+\s*)"}]},
    }}
    texts = ["class A and class A, class B", "key=k skip key= class C", " 12 and 7"]
    chunks = [(t, i, 0, f"{t}{i}", x) for t in ("t", "u", "v") for i, x in enumerate(texts)]
    got = graph.rule_entities(spark.createDataFrame(chunks, CHUNK), targets.patterns_df(spark, config)).collect()
    want = {
        (c, m.group(1).strip(), p["label"])
        for t, _, _, c, x in chunks for p in config["targets"].get(t, {}).get("patterns", []) for m in re.finditer(p["pattern"], x)
        if m.group(1) and m.group(1).strip()
    }
    assert sorted((r.chunk_id, r.entity, r.label) for r in got) == sorted(want)
    nothing = graph.rule_entities(spark.createDataFrame(chunks, CHUNK), targets.patterns_df(spark, {}))
    assert nothing.count() == 0 and nothing.columns == graph.MENTION


REPLIES = {
    "no fence": [],
    "```json\n{bad\n```": [],
    '```json\n{"triples": null}\n```': [],
    '```json\n{"triples": [{"subject": "a", "predicate": "b"}, {"subject": "a", "predicate": "b", "object": "c"}]}\n```': [("a", "b", "c")],
    '```json {"triples": [{"subject": 1, "predicate": "b", "object": null}, {"subject": 1, "predicate": "b", "object": true}]} ``` x ```json {"triples": []} ```': [("1", "b", "true")],
    '```json\n[1]\n```': [],
    '```json\n{"other": 1}\n```': [],
}


def test_replies(spark):
    rows = list(enumerate(REPLIES))
    df = spark.createDataFrame(rows, "i int, raw string")
    got: dict = {}
    for r in triples.parse_triples(df).orderBy("i", "pos").collect():
        got.setdefault(r.i, []).append((r.subject, r.predicate, r.object))
    for i, raw in rows:
        assert got.get(i, []) == REPLIES[raw], raw
    marks = spark.createDataFrame([("p<|assistant|> one <|assistant|>two",), ("none",)], "raw string")
    assert [r[0] for r in marks.select(triples.reply(F.col("raw"))).collect()] == ["one", ""]


def test_graph_build(spark):
    docs = spark.createDataFrame(
        [("t", 1, "# H\nthe class Foo extends class Bar here", ("u1",)), ("t", 2, "short one", ("u2",)), ("v", 1, "a class Foo in another target", ("u3",))],
        "target string, doc_ord long, markdown string, metadata struct<source_url:string>",
    )
    config = {"targets": {"t": {"patterns": [{"label": "CLS", "pattern": r"class (\w+)"}], "entity_types": ["C"], "predicates": ["extends"]}, "v": {}}}

    def model():
        return lambda batch: [
            'x<|assistant|>```json {"triples": [{"subject": "Foo", "predicate": "extends", "object": "Baz"}]} ```' if '["C"]' in p else "" for p in batch
        ]

    def recognizer():
        return lambda batch: [[("Bar", "ORG"), ("here", "OTHER")] for _ in batch]

    built = build.build_graph(
        docs, targets.patterns_df(spark, config), recognizer=recognizer, labels=["ORG"], ontology=targets.ontology_df(spark, config), model=model
    )
    nodes = {(r.target, r.text): r.label for r in built["nodes"].collect()}
    assert nodes == {("t", "Foo"): "CLS", ("t", "Bar"): "CLS", ("t", "Baz"): "ENTITY", ("v", "Bar"): "ORG"}
    assert [tuple(r) for r in built["edges"].collect()] == [("t", "Foo", "Baz", "extends")]
    assert built["chunks"].count() == 2
    stats = {r.target: (r.nodes, r.edges, r.chunks) for r in graph.graph_stats(built["nodes"], built["edges"], built["chunks"]).collect()}
    assert stats == {"t": (3, 1, 1), "v": (1, 0, 1)}
    origin = graph.node_provenance(built["mentions"], built["chunks"]).filter("entity = 'Foo'").collect()
    assert [(r.source_url, r.header) for r in origin] == [("u1", "H")]


def test_null_patterns_change_nothing_on_either_side_of_the_bound(spark, monkeypatch):
    chunks = spark.createDataFrame([("t", 1, 0, "c", "see Alpha and Beta")], "target string, doc_ord long, chunk_idx int, chunk_id string, text string")
    rows = [("t", "N", r"\b(Alpha|Beta)\b"), ("t", "N", None), (None, "N", "(see)"), ("t", None, "(see)")]
    patterns = spark.createDataFrame(rows, "target string, label string, pattern string")
    for bound in (128, 0):
        monkeypatch.setattr(graph, "_MAX_LITERAL_PATTERNS", bound)
        assert sorted(r.entity for r in graph.rule_entities(chunks, patterns).collect()) == ["Alpha", "Beta"]


def test_required_literals():
    cases = {
        "abc": "abc", "a(bcd)e": "bcd", "ab?cde": "cde", "ab+cd": "ab", "x(?:long|er)yz": "yz", "(a|b)": "", "a|b": "", "[a-z]+ing": "ing", "foo\\.bar": "foo.bar",
        "foo\\dbarbar": "barbar", "(?i)abc": "", "abc{0,3}de": "ab", "abcd{2}e": "abcd", "(word)?rest": "rest", "(word)+r": "word", "(?=look)ahead": "ahead",
        "(?<!no)yes": "yes", "[]x]abc": "abc", "[^\\]]abc": "abc", "\\Qa.b\\E": "", "a.*?bcd": "bcd", "^start$": "start", "(unclosed": "", "é日本 x": "é日本 x", "": "",
        "(?:^|[^A-Za-z])(word)(?![A-Za-z])": "word", "ab??cd": "cd", "\\u0041bc": "", "[a&&[b]]c": "",
    }
    assert {p: graph.required_literal(p) for p in cases} == cases


def test_matches_hold_the_required_literal():
    import random
    import re

    rng = random.Random(6)
    parts = ["a", "b", "c", "ab", "x?", "b+", "[ab]", "(ab)", "(?:a|b)", "(c)?", ".", "\\\\.", "a{2}", "b{0,1}", "(a(b)c)", "^", "c*?"]
    seen = 0
    for _ in range(3000):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
        literal = graph.required_literal(pattern)
        for _ in range(10):
            found = re.search(pattern, "".join(rng.choice("abcx.") for _ in range(12)))
            if found:
                assert literal in found[0], pattern
                seen += bool(literal)
    assert seen > 1000


def test_many_patterns_by_each_way(spark, monkeypatch):
    texts = [("t", i, 0, f"c{i}", f"word{i} other{i % 7} Zeta.{i} plain") for i in range(60)] + [("u", 99, 0, "u", "word1 Zeta.1"), ("none", 1, 0, "n", "word1"), ("t", 98, 0, "e", "")]
    chunks = spark.createDataFrame(texts, "target string, doc_ord long, chunk_idx int, chunk_id string, text string")
    rules = [("t", "W", f"\\b(word{i})\\b") for i in range(0, 60, 2)] + [("t", "O", "(other\\d)"), ("t", "O", "(other[0-3])"), ("t", "Z", "(?i)(zeta\\.\\d+)"), ("u", "Z", "(Zeta)"), ("u", None, "x"), ("t", "P", "(p)lain|(q)")]
    patterns = spark.createDataFrame(rules, "target string, label string, pattern string")
    answers = []
    for limit, small in ((1000, True), (3, True), (3, False)):
        monkeypatch.setattr(graph, "_MAX_LITERAL_PATTERNS", limit)
        monkeypatch.setattr(graph, "measured_small", lambda df, small=small: small)
        answers.append(sorted(map(tuple, graph.rule_entities(chunks, patterns).collect())))
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 30 + 60 + 60 + 1 + 60


def test_fixed_texts_are_judged_where_they_stand(spark, monkeypatch):
    texts = ["foo", "xfoo foo", "foofoo,foo1", "-foo bar-foobar", "a foo bar", "fooo ofoo", "", " foo\nbar", "aaaa", "baaa aaab", "é😀foo😀", "o.o foo.", None]
    around = ["(?:^|[^A-Za-z])({})(?![A-Za-z])", "^({})", "({})", "[a-z ]({})", "({})[^a-z]", "(?<![A-Za-z])({})(?= )", "x({})", "(?:a|^b| )({})(?:,|f)", "(?<=[^a])({})"]
    rules = [("t", "AB"[i % 2], p.replace("{}", w)) for i, p in enumerate(around) for w in ("foo", "foobar", "aa", "bar", "o foo", " ")]
    chunks = spark.createDataFrame([("t", i, 0, f"c{i}", x) for i, x in enumerate(texts)], CHUNK)
    patterns = spark.createDataFrame([*rules, ("t", "A", r"\b(fo+)"), ("t", "C", "(b)|foo")], "target string, label string, pattern string")
    answers = []
    for limit in (1000, 3):
        monkeypatch.setattr(graph, "_MAX_LITERAL_PATTERNS", limit)
        answers.append(sorted(map(tuple, graph.rule_entities(chunks, patterns).collect())))
    assert answers[0] == answers[1] and len(answers[0]) > 30
    met = graph._Rules([(n, p) for _, n, p in rules]).met("a foo bar")
    assert not any(m["patterns"] for m in met) and {"foo", "bar"} <= {x for m in met for x in m["texts"]}
    assert graph.fixed_text(r"\b(word)") is None and graph.fixed_text("(a)|b") is None and graph.fixed_text("(a)+") is None
    assert graph.fixed_text("(a+)") is None and graph.fixed_text("(a)(b)") is None and graph.fixed_text("(a)$") is None


def test_mentions_travel_by_chunk_and_not_one_by_one(spark):
    rows = mention(("t", 2, 0, "X", "B", 0), ("t", 1, 3, "X", "A", 1), ("t", None, 0, "X", "A", 1), ("t", 1, 3, "Y", "A", 2))
    rows = spark.createDataFrame([*rows, ("t", 7, 0, "c20", "X", "B", 0), (None, 7, 0, "c", "X", "B", 0)], MENTION)
    united = graph.union_entities(rows, rows)
    assert united.count() == 5 and united.columns == ["target", "doc_ord", "chunk_idx", "chunk_id", "entity", "label", "priority"]
    paged = graph.node_pages(united, 5)
    assert sorted(map(tuple, paged.collect()), key=str) == [
        ("t", "X", 0, ["c13", "c20"]), ("t", "X", None, ["cNone0"]), ("t", "Y", 0, ["c13"]), (None, "X", 1, ["c"])
    ]
    for df in (united, graph.node_chunks(united), paged):
        dealt = re.findall(r"hashpartitioning\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())
        assert dealt and not any("entity" in keys or "text" in keys for keys in dealt)
