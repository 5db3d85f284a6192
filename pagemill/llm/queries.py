"""The operators of this package applied to the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, collocations, decontaminate, langid, paragraphs, prefixes, quality, simhash, templates, token_counts, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; small Arrow batches keep Python workers within bounds on long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encode and decode every text; ``path`` is the rank file, by default the public multilingual one."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, path, decoded="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents of the other two folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id"), 3) == 1
    model = langid.train(docs.filter(~held_out).select("text", "lang"))
    answer = langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return answer.select("doc_id", "held_out", "lang_pred", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All occurrences of repeated passages, and which of them stays."""
    return paragraphs.repeated(table(spark, sf_dir, "documents")).drop("doc")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to archives and back."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    told = warc.summary(warc.read(warc.archive(spark, pages), data=False))
    return told.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector."""
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(rows, rows.filter(F.pmod("vec_id", F.lit(50)) == 0), 5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of the other four folds."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = langid.fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs.filter(~held_out), labels.filter(~held_out))
    answer = toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return answer.select("doc_id", "held_out", "score", "predicted")


def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return templates.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


# Edits of the token count query: what a cleaning step replaces.
CLEANING = [
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[email]"),
    (r"\d{4,}", "0"),
    (r"[#$%&*]{3,}", ""),
    (r"Licensed under [^\n]*", ""),
]


def op2_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of every document before and after its cleaning edits, and how much was encoded again for them."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count(docs, path).withColumns({"n_tokens": F.col("sums")[1], "edits": token_counts.replacements(F.col("text"), CLEANING)})
    after = token_counts.apply_edits(counted, path)
    return after.select(
        "doc_id", "n_tokens", F.size("edits").cast("long").alias("n_edits"), F.col("sums")[1].alias("n_tokens_edited"),
        F.length("text").cast("long").alias("n_chars_edited"), "n_encoded",
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of the other four folds."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = langid.fold(F.col("doc_id"), 5) == 0
    model = quality.train(docs.filter(~held_out), labels.filter(~held_out))
    answer = quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return answer.select("doc_id", "held_out", "score", "predicted")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations."""
    return prefixes.trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"), least=100, longest=5, share=100, first=2000)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_token_counts, op3_warc, op4_language_id, op5_simhash, op6_templates, op7_decontaminate, op8_bpe,
        op9_toxicity, op10_topk, op11_quality, op12_prefix_trie, op13_collocations,
    )}


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT h, max(page_id) AS stored FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN stored > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN stored > page_id THEN stored END AS refers_to
FROM p LEFT JOIN r ON p.h = r.h
"""


# The given pages have one article each, of paragraphs, a heading, bold text and five kinds of references.
OP6_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS h FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS h FROM a),
d AS (SELECT page_id, url, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS h FROM t),
c AS (SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""
OP10_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE k <= 5
"""


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY j) AS s FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, s, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda u, v: list_reduce([xor(u, v)] || [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))) AS v
  FROM own),
h AS (SELECT conv_id, s, xor(v, 4294967295) % 4 AS h FROM crc),
b AS (
  SELECT h.conv_id, coalesce(o.s[1:h.h], []) || h.s[h.h + 1:] AS s
  FROM h LEFT JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, len(s) AS n, s, unnest(range(0, len(s) + 1)) AS d FROM b),
p AS (SELECT conv_id, d, n = d AS last, s[1:d] AS p FROM m),
v AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM p GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
w AS (
  SELECT v.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN v.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(v.p[v.d].x, '[^\x20\x09-\x0D]+')) END AS own
  FROM v LEFT JOIN k ON k.d = v.d AND k.p = v.p),
up AS (SELECT w.p AS path, w.own, w.n_children, unnest(range(0, w.d + 1)) AS d FROM w),
sums AS (
  SELECT path[1:d] AS p, d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens FROM up GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, sums.n_leaves,
  CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN sums ON sums.d = w.d AND sums.p = w.p LEFT JOIN v a ON a.d = w.d - 1 AND w.d > 0 AND a.p = w.p[1:w.d - 1]
"""
OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g
  FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
cuts AS (SELECT lang, k, g, a, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT u.lang, u.k, u.g, u.a, u.cut, x.a AS l, y.a AS r, n.n,
    (1000::HUGEINT * u.a * n.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts u JOIN n USING (lang) JOIN f x ON x.lang = u.lang AND x.g = u.g[1:u.cut] JOIN f y ON y.lang = u.lang AND y.g = u.g[u.cut + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, a, k, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: g[i:i + m - 1])))) AS g
  FROM c WHERE k > 2),
around AS (SELECT lang, g, max(a) AS a FROM inner_ GROUP BY lang, g),
kept AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.g = b.g
  WHERE o.a IS NULL OR 100 * o.a < 100 * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM r WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_prefix_trie": OP12_SQL, "op13_collocations": OP13_SQL, "op3_warc": OP3_SQL, "op6_templates": OP6_SQL, "op10_topk": OP10_SQL}
