"""Entity mentions and triples to node and edge tables.

A frequent entity occurs in most chunks, so lists of a node's chunks are never
gathered whole: nodes and their chunks are separate tables, and the list form
is paged by document order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.operators.scale import compute_once, join_dimension, measured_small, stage

MENTION = ["target", "doc_ord", "chunk_idx", "chunk_id", "entity", "label", "priority"]
# Order in which sources name a node first seen in the same chunk.
RULE, MODEL, ENDPOINT = 0, 1, 2
ENDPOINT_LABEL = "ENTITY"
_MAX_LITERAL_PATTERNS = 128
_PARTS = 4
_POSITION = ["target", "doc_ord", "chunk_idx", "chunk_id"]


def _labelled(texts: Column, label: Column) -> Column:
    """Distinct non-blank texts of a row as (entity, label).

    Distinct over strings, which are hashed; over structs Spark would compare
    all pairs.
    """
    kept = F.filter(F.transform(texts, text.strip), lambda m: m != "")
    return F.transform(F.array_distinct(kept), lambda m: F.struct(m.alias("entity"), label.alias("label")))


def _matches(pattern: Column) -> Column:
    return F.regexp_extract_all(F.col("text"), pattern, F.lit(1))


def _by_rules() -> Column:
    """Matches of the row's own ``_rules``, by label: texts found already, and patterns to be searched for."""
    texts = lambda r: F.concat(r["texts"], F.flatten(F.transform(r["patterns"], _matches)))
    return F.flatten(F.transform("_rules", lambda r: _labelled(texts(r), r["label"])))


def rule_entities(chunks: DataFrame, patterns: DataFrame) -> DataFrame:
    """First-group matches of each target's patterns, once per chunk, text and label.

    A chunk is one row, so its set is made within the row, without a shuffle.
    A pattern list of ordinary size becomes literal expressions, compiled once
    per task.  Of a longer one each text meets only the patterns whose required
    literal it holds, and those that extract a fixed text are judged where it
    stands; one too long to be told to all tasks is joined by target.
    Patterns with a null part match nothing.
    """
    patterns = patterns.filter("target is not null and label is not null and pattern is not null")
    listed = patterns.select("target", "label", "pattern").limit(_MAX_LITERAL_PATTERNS + 1).collect()
    if not listed:
        none = chunks.select(*_POSITION, F.lit("").alias("entity"), F.lit("").alias("label"))
        return _mentions(none.filter(F.lit(False)), RULE)
    if len(listed) <= _MAX_LITERAL_PATTERNS:
        rules: dict[tuple[str, str], list[str]] = {}
        for p in listed:
            rules.setdefault((p.target, p.label), []).append(p.pattern)
        found = F.concat(*[
            F.when(
                F.col("target") == target, _labelled(F.concat(*[_matches(F.lit(p)) for p in of_label]), F.lit(label))
            ).otherwise(F.array().cast("array<struct<entity:string,label:string>>"))
            for (target, label), of_label in rules.items()
        ])
        hits = compute_once(chunks, "_all", found)
    elif measured_small(patterns):
        listed = patterns.select("target", "label", "pattern").distinct().toPandas()
        met = compute_once(chunks, "_rules", _possible(listed, F.col("target"), F.col("text")))
        hits = compute_once(met, "_all", _by_rules())
    else:
        by_label = patterns.groupBy("target", "label").agg(F.collect_list("pattern").alias("patterns"))
        rules = by_label.groupBy("target").agg(F.collect_list(F.struct("label", "patterns", F.array().cast("array<string>").alias("texts"))).alias("_rules"))
        hits = compute_once(join_dimension(chunks, rules, ["target"]), "_all", _by_rules())
    return _mentions(hits.select(*_POSITION, F.explode("_all").alias("_m")).select(*_POSITION, "_m.*"), RULE)


def required_literal(pattern: str) -> str:
    """The longest text that every match of a pattern is certain to contain; empty where none is certain.

    Careful rather than clever: it knows literals, classes, groups and
    quantifiers, and is silent on flags, quotations and nested classes.
    """
    if re.search(r"\(\?[a-zA-Z-]|\\Q|\\[0-9xuUcNpPk]", pattern):
        return ""
    best, run, at = "", "", 0

    def end_run() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    while at < len(pattern):
        c = pattern[at]
        size, literal, inner = 1, None, ""
        if c == "|":
            return ""
        if c == "\\":
            size = 2
            literal = pattern[at + 1 : at + 2] if not pattern[at + 1 : at + 2].isalnum() else None
        elif c == "[":
            found = re.match(r"\[\^?\]?(?:[^\]\[\\]|\\.)*\]", pattern[at:])
            if not found:
                return ""
            size = found.end()
        elif c == "(":
            size = _group_end(pattern, at) - at
            if size <= 0:
                return ""
            body = pattern[at + 1 : at + size - 1]
            if not body.startswith("?") or body.startswith("?:"):
                inner = required_literal(body.removeprefix("?:"))
        elif c in "^$.":
            pass
        elif c in ")]{}?*+":
            return ""
        else:
            literal = c
        at += size
        count = re.match(r"[?*+]|\{(\d+)[^}]*\}", pattern[at:])
        needed = not count or count[0] == "+" or (count[1] or "0") != "0"
        if literal and needed:
            run += literal
        if count or not literal:
            end_run()
        if inner and needed:
            best = max(best, inner, key=len)
        if count:
            at += count.end()
            at += pattern[at : at + 1] in ("?", "+") and len(pattern[at : at + 1])
    end_run()
    return best


def _group_end(pattern: str, at: int) -> int:
    """Place after the bracket that closes the group opened at ``at``; 0 if none does."""
    depth, classed = 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif classed:
            classed = c != "]"
        elif c == "[":
            classed = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return 0


# Parts around the group of a pattern that extracts a fixed text: they have no
# quantifiers and mean the same to Java and Python, where ``pos`` is no start of the text.
_ONE = r"(?:[^\\\[\](){}.^$|?*+]|\[\^?(?:[A-Za-z0-9](?:-[A-Za-z0-9])?|[ _,;:!'\"/@#%=<>])+\])"
_SOME = rf"(?:{_ONE}|\^|\(\?:(?:{_ONE}|\^)+(?:\|(?:{_ONE}|\^)+)*\))"
_FIXED = re.compile(rf"((?:{_SOME}|\(\?<[=!]{_ONE}\))*)\(([^\\\[\](){{}}.^$|?*+]+)\)((?:{_SOME}|\(\?[=!]{_ONE}\))*)")


def fixed_text(pattern: str) -> tuple[str, str, str] | None:
    """What stands before, in and after the only group of a pattern that extracts one fixed text; null for any other.

    Such a pattern matches if its text stands somewhere between the two, and
    then extracts just that text.
    """
    found = _FIXED.fullmatch(pattern)
    try:
        return found and re.compile(found[1]) and re.compile(found[3]) and found.groups()
    except re.error:
        return None


class _Rules:
    """Patterns of a target by the literals that their matches hold."""

    def __init__(self, rules: list[tuple[str, str]]):
        import ahocorasick

        self.rules, self.always = rules, []
        by_literal: dict[str, tuple[list[int], dict]] = {}  # patterns to be searched for; those of a fixed text, by what stands around it
        for i, (label, pattern) in enumerate(rules):
            fixed = fixed_text(pattern)
            literal = fixed[1] if fixed else required_literal(pattern)
            if not literal:
                self.always.append(i)
                continue
            searched, judged = by_literal.setdefault(literal, ([], {}))
            if fixed:
                judged.setdefault((fixed[0], fixed[2]), []).append(label)
            else:
                searched.append(i)
        self.machine = ahocorasick.Automaton()
        around = {}
        for literal, (searched, judged) in by_literal.items():
            tests = [(around.setdefault(p, (re.compile(p[0]), len(re.findall(_ONE, p[0])), re.compile(p[1]))), labels) for p, labels in judged.items()]
            self.machine.add_word(literal, (literal, searched, tests))
        self.machine.make_automaton()
        self.known = bool(by_literal)

    def met(self, whole: str | None) -> list[dict]:
        """By label: fixed texts found in a text, and patterns that it may match."""
        searched, left, texts = set(self.always), {}, {}
        for end, (literal, patterns, tests) in self.machine.iter(whole) if self.known and whole else ():
            tests = left.setdefault(literal, tests)
            if patterns:
                searched.update(patterns)
            for test in tests:
                (before, most, after), labels = test
                first = end + 1 - len(literal)
                if after.match(whole, end + 1) and any(before.fullmatch(whole, at, first) for at in range(max(0, first - most), first + 1)):
                    for label in labels:
                        texts.setdefault(label, set()).add(literal)
                    left[literal] = [t for t in left[literal] if t is not test]
        by_label: dict[str, list[str]] = {}
        for i in sorted(searched):
            by_label.setdefault(self.rules[i][0], []).append(self.rules[i][1])
        return [{"label": n, "patterns": by_label.get(n, []), "texts": sorted(texts.get(n, ()))} for n in {**by_label, **texts}]


def _possible(patterns: pd.DataFrame, target: Column, texts: Column) -> Column:
    """Of the row's target: fixed texts found in its text, and the patterns that it can match, by a required literal or for want of one."""

    @F.pandas_udf("array<struct<label:string,patterns:array<string>,texts:array<string>>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = {name: _Rules(list(zip(rows["label"], rows["pattern"]))) for name, rows in patterns.groupby("target")}
        for names, batch in batches:
            yield pd.Series([known[name].met(whole) if name in known else [] for name, whole in zip(names, batch)])

    return run(target, texts)


def _mentions(hits: DataFrame, priority: int) -> DataFrame:
    named = hits.filter(F.coalesce(F.col("entity"), F.lit("")) != "")
    return named.withColumn("priority", F.lit(priority)).select(*MENTION)


def recognize_entities(
    chunks: DataFrame,
    recognizer: Callable[[], Callable[[list[str]], list[list[tuple[str, str]]]]],
    labels: Sequence[str],
) -> DataFrame:
    """Mentions by a pluggable recogniser from texts to (text, label) lists, allowed labels only."""

    @F.pandas_udf("array<struct<entity:string,label:string>>")
    def recognize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = recognizer()
        for batch in batches:
            found = run(batch.tolist())
            yield pd.Series([[{"entity": e, "label": n} for e, n in row] for row in found], index=batch.index)

    marked = chunks.select(*_POSITION, text.strip_markup(F.col("text")).alias("_plain"))
    found = compute_once(marked, "_found", recognize(F.col("_plain")))

    def named(label: str) -> Column:
        of_label = F.filter("_found", lambda m: m["label"] == label)
        return _labelled(F.transform(of_label, lambda m: m["entity"]), F.lit(label))

    if not labels:
        return _mentions(
            chunks.select(*_POSITION, F.lit("").alias("entity"), F.lit("").alias("label")).filter(F.lit(False)), MODEL
        )
    hits = compute_once(found, "_all", F.concat(*[named(label) for label in dict.fromkeys(labels)]))
    return _mentions(hits.select(*_POSITION, F.explode("_all").alias("_m")).select(*_POSITION, "_m.*"), MODEL)


def allow_labels(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.filter(F.col("label").isin(list(labels)))


def triple_endpoints(triples: DataFrame) -> DataFrame:
    """Subjects and objects of triples as mentions with the generic label, repeats included."""
    ends = F.explode(F.array(text.strip(F.col("subject")), text.strip(F.col("object"))))
    hits = triples.select(*_POSITION, ends.alias("entity"), F.lit(ENDPOINT_LABEL).alias("label"))
    return _mentions(hits, ENDPOINT)


def _beside(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal ``keys`` moved to the same few tasks, side by side, so that long ids are packed with their repeats.

    ``_part`` deals a key's entities over _PARTS tasks, for a key may be hot.
    An aggregate whose keys include these needs no further shuffle.  The number
    of tasks is fixed: sizes after compression say little of the rows.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("_part", F.pmod(F.xxhash64("entity"), F.lit(_PARTS))).repartition(tasks, *keys, "_part")


def union_entities(*mentions: DataFrame) -> DataFrame:
    """All mentions, once per chunk, text and label, the earliest source kept."""
    everything = reduce(DataFrame.unionByName, mentions)
    return (
        _beside(everything, "target", "chunk_id").groupBy("chunk_id", "target", "_part", "entity", "label")
        .agg(F.min(F.struct("doc_ord", "chunk_idx", "priority")).alias("_first"))
        .select("target", "_first.doc_ord", "_first.chunk_idx", "chunk_id", "entity", "label", "_first.priority")
    )


def node_chunks(mentions: DataFrame) -> DataFrame:
    """Distinct chunks of each node: (target, entity, chunk_id, doc_ord, chunk_idx, priority, label).

    (doc_ord, chunk_idx) is the first-seen order.
    """
    return (
        _beside(mentions, "target", "chunk_id").groupBy("chunk_id", "target", "_part", "entity")
        .agg(F.min(F.struct("doc_ord", "chunk_idx", "priority", "label")).alias("_first"))
        .select("target", "entity", "chunk_id", "_first.*")
    )


def merge_nodes(mentions: DataFrame) -> DataFrame:
    """One node per text: (target, text, label, n_chunks); the first-seen label wins."""
    return (
        node_chunks(mentions)
        .groupBy("target", "entity")
        .agg(
            F.min(F.struct("doc_ord", "chunk_idx", "priority", "label"))["label"].alias("label"),
            F.count(F.lit(1)).alias("n_chunks"),
        )
        .withColumnRenamed("entity", "text")
    )


def node_pages(mentions: DataFrame, docs_per_page: int = 1000) -> DataFrame:
    """Chunk ids of each node in first-seen order: (target, text, page, chunk_ids).

    A page covers a range of ``doc_ord``, which bounds its list; the pages of a
    node in order are its whole list.
    """
    ordered = F.array_sort(F.collect_list(F.struct("doc_ord", "chunk_idx", "chunk_id")))
    paged = node_chunks(mentions).withColumn("page", F.floor(F.col("doc_ord") / F.lit(docs_per_page)))
    return (
        _beside(paged.select("target", "entity", "page", "doc_ord", "chunk_idx", "chunk_id"), "target", "page")
        .groupBy("page", "target", "_part", "entity")
        .agg(F.transform(ordered, lambda c: c["chunk_id"]).alias("chunk_ids"))
        .select("target", F.col("entity").alias("text"), "page", "chunk_ids")
    )


def merge_edges(triples: DataFrame) -> DataFrame:
    """One edge per (src, dst): (target, src, dst, label); the last predicate wins."""
    cleaned = triples.select(
        *_POSITION, "pos",
        text.strip(F.col("subject")).alias("src"),
        text.strip(F.col("object")).alias("dst"),
        text.strip(F.col("predicate")).alias("label"),
    ).filter((F.col("src") != "") & (F.col("dst") != ""))
    return cleaned.groupBy("target", "src", "dst").agg(
        F.max(F.struct("doc_ord", "chunk_idx", "pos", "label"))["label"].alias("label")
    )


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes; a hub's edges are spread, not gathered.

    The nodes are made once, for both ends.
    """
    ends = stage(nodes.select("target", "text"), "edge-ends")
    with_src = join_dimension(edges, ends.withColumnRenamed("text", "src"), ["target", "src"], "left_semi")
    return join_dimension(with_src, ends.withColumnRenamed("text", "dst"), ["target", "dst"], "left_semi").select(
        *edges.columns
    )


def node_provenance(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Source chunks of each node: (target, entity, chunk_id, source_url, header)."""
    found = node_chunks(mentions).select("target", "entity", "chunk_id")
    return found.join(chunks.select("target", "chunk_id", "source_url", "header").distinct(), ["target", "chunk_id"])


def graph_stats(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Node, edge and distinct chunk counts per target."""
    counted = [
        df.groupBy("target").agg(n.alias("n"))
        .select("target", *[(F.col("n") if i == j else F.lit(0)).alias(c) for j, c in enumerate(("nodes", "edges", "chunks"))])
        for i, (df, n) in enumerate([
            (nodes, F.count(F.lit(1))),
            (edges, F.count(F.lit(1))),
            (chunks.select("target", "chunk_id").distinct(), F.count(F.lit(1))),
        ])
    ]
    return reduce(DataFrame.unionByName, counted).groupBy("target").agg(
        *[F.sum(c).alias(c) for c in ("nodes", "edges", "chunks")]
    )
