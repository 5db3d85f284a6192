"""Triples from model output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.operators.scale import compute_once, join_dimension

# The model's reply marker, its fenced JSON block, and the prompt it was trained on.
_REPLY = r"<\|assistant\|>"
_JSON_BLOCK = r"(?s)```json\s*(\{.*?\})\s*```"
_TRIPLES = "struct<triples:array<struct<subject:string,predicate:string,object:string>>>"
_PROMPT = (
    "Perform Named Entity Recognition (NER) and extract knowledge graph triplets from the text. "
    "NER identifies named entities of given entity types, and triple extraction identifies "
    "relationships between entities using specified predicates.\n\n**Entity Types:**\n",
    "\n\n**Predicates:**\n",
    "\n\n**Text:**\n",
    "\n",
)


def _escaped(json: Column) -> Column:
    """JSON text with all but ASCII characters as escapes, code unit by code unit."""
    units = F.regexp_extract_all(F.hex(F.encode(json, "UTF-16BE")), F.lit("(.{4})"))
    spelled = F.transform(units, lambda u: F.when(u < "0080", F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(u))))
    return F.when(F.octet_length(json) == F.length(json), json).otherwise(F.array_join(spelled, ""))


def _json_list(name: str, items: Column) -> Column:
    quoted = F.transform(items, lambda x: _escaped(F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")))
    return F.concat(F.lit('{"' + name + '": ['), F.array_join(quoted, ", "), F.lit("]}"))


def with_ontology(df: DataFrame, ontology: DataFrame) -> DataFrame:
    """Rows of targets whose ontology has both entity types and predicates."""
    usable = ontology.filter((F.size("entity_types") > 0) & (F.size("predicates") > 0))
    return join_dimension(df, usable.select("target", "entity_types", "predicates"), ["target"])


def extraction_prompt(df: DataFrame, col: str = "text", out: str = "prompt") -> DataFrame:
    """Add the extraction prompt for the row's ontology and text."""
    lead, between, body, end = (F.lit(p) for p in _PROMPT)
    prompt = F.concat(
        lead, _json_list("entity_types", F.col("entity_types")),
        between, _json_list("predicates", F.col("predicates")),
        body, F.col(col), end,
    )
    return df.withColumn(out, prompt)


def reply(raw: Column) -> Column:
    """Text after the first reply marker, stripped; '' without one."""
    return F.coalesce(text.strip(F.try_element_at(F.split(raw, _REPLY, -1), F.lit(2))), F.lit(""))


def json_block(raw: Column) -> Column:
    return F.regexp_extract(raw, _JSON_BLOCK, 1)


def parse_triples(df: DataFrame, raw_col: str = "raw", *, marked: bool = False) -> DataFrame:
    """One row per complete triple in the first JSON block: carried columns, pos, subject, predicate, object.

    Missing or malformed blocks give no rows.  ``marked`` first cuts the prompt
    off at the reply marker.
    """
    source = reply(F.col(raw_col)) if marked else F.col(raw_col)
    carried = [c for c in df.columns if c != raw_col]
    parsed = compute_once(df, "_parsed", F.from_json(json_block(source), _TRIPLES))
    return (
        parsed.select(*carried, F.posexplode("_parsed.triples").alias("pos", "_t"))
        .select(*carried, "pos", "_t.subject", "_t.predicate", "_t.object")
        .filter(F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull())
    )


def extract_triples(
    chunks: DataFrame, ontology: DataFrame, model: Callable[[], Callable[[list[str]], list[str]]]
) -> DataFrame:
    """Triples of each chunk by a pluggable model from prompts to raw replies.

    ``model`` is called once per task.  Prompt, reply cut and parsing are
    column expressions.
    """

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for batch in batches:
            yield pd.Series(run(batch.tolist()), index=batch.index, dtype=object)

    plain = with_ontology(chunks, ontology).withColumn("_plain", text.strip_markup(F.col("text")))
    prompted = extraction_prompt(plain, "_plain", "_prompt").withColumn("raw", generate(F.col("_prompt")))
    keep = ["target", "doc_ord", "chunk_idx", "chunk_id", "raw"]
    return parse_triples(prompted.select(*keep), marked=True)
