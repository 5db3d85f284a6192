"""DuckDB SQL for the query catalogue, written independently of the Spark plans.

DuckDB's regex engine has no Java flags, so patterns are stated for it here.
"""

from __future__ import annotations


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _subs(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        expr = f"regexp_replace({expr}, {_q(pattern)}, {_q(replacement)}, 'g')"
    return expr


def _replaces(expr: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, {_q(old)}, {_q(new)})"
    return expr


# The character references that occur in the tables; ampersand last.
_ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
_SPACE = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\u00a0\u2028\u2029"


def _decode(expr: str) -> str:
    return _replaces(expr, _ENTITIES)


def _strip(expr: str) -> str:
    return f"trim({expr}, {_q(_SPACE)})"


_VISIBLE = [
    (r"(?s)<!--.*?(-->|\z)", ""),
    (r"(?is)<script\b[^>]*>.*?(</script\s*>|\z)|<style\b[^>]*>.*?(</style\s*>|\z)", ""),
]
_NETLOC = "regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def _host(expr: str) -> str:
    return _NETLOC.format(expr)


# --- pages -----------------------------------------------------------------

PAGE_METADATA = f"""
WITH p AS (
  SELECT page_id, url, html, {_strip(_decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS t FROM pages
)
SELECT page_id, url AS source_url,
  CASE WHEN page_id % 4 = 0 OR t = '' THEN 'OG ' || page_id ELSE t END AS title,
  'Page ' || page_id || ' > &amp; A more' AS description,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS language,
  CAST(NULL AS VARCHAR) AS keywords,
  'OG ' || page_id AS og_title,
  CAST(NULL AS VARCHAR) AS og_description, CAST(NULL AS VARCHAR) AS og_image, CAST(NULL AS VARCHAR) AS og_url,
  regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/icons/' || page_id || '.png' AS favicon
FROM p
"""

_LINKS = f"""
raw AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS origin,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '^[a-z]+:', 0) AS scheme,
    regexp_extract_all({_subs('html', _VISIBLE)}, '<a href="([^"]*)">', 1) AS found
  FROM pages
), hrefs AS (
  SELECT page_id, url, origin, path, scheme, unnest(found) AS href, generate_subscripts(found, 1) + 4 AS pos FROM raw
  UNION ALL SELECT page_id, url, origin, path, scheme, '?q=1&r=2', 0 FROM raw
  UNION ALL SELECT page_id, url, origin, path, scheme, '//cdn.example.org/a#b', 1 FROM raw
  UNION ALL SELECT page_id, url, origin, path, scheme, 'mailto:x@y.z', 2 FROM raw
  UNION ALL SELECT page_id, url, origin, path, scheme, '../up/./x#f', 3 FROM raw
  UNION ALL SELECT page_id, url, origin, path, scheme, '/many', 4 FROM raw
), links AS (
  SELECT page_id, url, CAST(pos AS INTEGER) AS pos, href,
    CASE WHEN href LIKE '?%' THEN origin || path || href
         WHEN href LIKE '//%' THEN scheme || '//cdn.example.org/a'
         WHEN href LIKE 'mailto%' THEN href
         WHEN href LIKE '..%' THEN origin || coalesce(nullif(regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', ''), ''), '/') || 'up/x'
         ELSE origin || href END AS abs_url
  FROM hrefs
)
"""
PAGE_LINKS = f"WITH {_LINKS} SELECT page_id, pos, href, abs_url FROM links"
SAME_HOST_LINKS = f"""
WITH {_LINKS}
SELECT {_host('url')} AS host, count(*) AS links FROM links WHERE {_host('url')} = {_host('abs_url')} GROUP BY 1
"""

_TO_MARKDOWN = [
    (r"[ \t\r\n\f]+", " "),
    (r"(?i)<br\b[^>]*>", "￹"),
    *[(rf"(?i)<h{n}\b[^>]*>", "\n\n" + "￺" * n + " ") for n in range(1, 7)],
    (r"(?i)<li\b[^>]*>", "\n￻ "),
    (r"(?i)</?(p|div|section|ul|ol|h[1-6])\b[^>]*>", "\n\n"),
    (r"</?[A-Za-z][^>]*>|<![^>]*>|</?[A-Za-z!][^>]*\z", ""),
]
_ESCAPE = [(r"([*_])", r"\\\1"), (r" *\n[ \n]*\n *", "\n\n"), (r"(?m)^( *)#", r"\1\\#")]
_MARKS = [("￹", "  \n"), ("￺", "#"), ("￻", "*")]
_REGION = (
    r"regexp_extract(" + _subs("html", _VISIBLE + [(r"(?is)<noscript\b[^>]*>.*?(</noscript\s*>|\z)", "")])
    + r", '(?is)<article\b[^>]*>(.*?)(</article\s*>|\z)', 1)"
)
_MARKDOWN = _strip(_replaces(_subs(_decode(_subs(_REGION, _TO_MARKDOWN)), _ESCAPE), _MARKS))
_FIRST_ARTICLE = (
    "## First A\n\nSome **bold *text*** and [a link](/x_y).\n\nNo end tag\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n"
    "```\ndef f(a):\n    return a*2  # c < d\n```\n\n> Quoted\n\n1. one\n2. two `x_y`\n\nBetween\n\n"
)
MAIN_CONTENT = f"SELECT page_id, {_strip(f'{_q(_FIRST_ARTICLE)} || {_MARKDOWN}')} AS markdown FROM pages"

_SECTIONS = (
    "\n## Details \nOn this page see [the *page*](", ") and `code` now.\n\n\n\n- item\t one\n- item two\nEdit this page on GitHub\n"
    "```\n# kept as a header by the chunker\nx = 1\n```\n###\nLast &amp; least\n\n© 2024 X all rights reserved.\n#### \n",
)
_SPACES = r"[ \t\n\r\x0b\x0c\x1c-\x1f\x{a0}]"
_DOCS = f"""
md AS (SELECT page_id, url, {_MARKDOWN} AS markdown FROM pages),
docs AS (
  SELECT page_id, {_host('url')} AS target, url AS source_url,
    'Intro of ' || page_id || chr(10) || nullif(markdown, '') || {_q(_SECTIONS[0])} || url || {_q(_SECTIONS[1])} AS markdown
  FROM md
)
"""
_CHUNKS = f"""
cut AS (
  SELECT *, regexp_extract_all(markdown, '(?m)^#{{1,6}}{_SPACES}+(.*)', 1) AS heads,
    regexp_split_to_array(markdown, '(?m)^#{{1,6}}{_SPACES}+.*') AS parts
  FROM docs WHERE markdown <> ''
), sections AS (
  SELECT *, CASE WHEN len(heads) = 0 THEN [{{'h': 'General', 't': markdown}}]
    ELSE list_concat(
      CASE WHEN parts[1] <> '' THEN [{{'h': 'Introduction', 't': {_strip('parts[1]')}}}] ELSE [] END,
      list_transform(range(1, len(heads) + 1), lambda i: {{'h': {_strip('heads[i]')}, 't': {_strip('parts[i + 1]')}}})) END AS chunks
  FROM cut
), numbered AS (
  SELECT page_id, target, source_url, unnest(range(len(chunks))) AS chunk_idx, chunks FROM sections
), chunk AS (
  SELECT page_id, target, source_url, CAST(chunk_idx AS INTEGER) AS chunk_idx,
    chunks[chunk_idx + 1].h AS header, chunks[chunk_idx + 1].t AS text,
    sha256(source_url || '-' || chunk_idx) AS chunk_id
  FROM numbered
)
"""
HEADER_CHUNKS = f"WITH {_DOCS}, {_CHUNKS} SELECT page_id, chunk_idx, header, text, chunk_id FROM chunk"

_PARKED = [("\\\\", "\ue010"), ("\\*", "\ue011"), ("\\_", "\ue012"), ("\\#", "\ue013")]
_CLEAN = [
    (r"(?s)```.*?```", ""), (r"`[^`]*`", ""), (r"\[([^\]]+)\]\([^\)]+\)", r"\1"),
]
_PLAIN = [
    (r"</?[A-Za-z][^>]*>", ""),
    (r"(?m)^ {0,3}```[^`\n]*$\n?", ""),
    (r"(?m)^ {0,3}(=+|-+)[ \t]*$", ""),
    (r"(?m)^[ \t]*>[> \t]*", ""),
    (r"(?m)^[ \t]*([-*+]|[0-9]{1,9}[.)])[ \t]+", ""),
    (r"(?m)^ {0,3}#{1,6}([ \t]+|$)", ""),
    (r"(?m)[ \t]+$", ""),
    (r"\n{2,}", "\n\ue01f\n"),
    *[("\\*([^\\s*\ue01f]([^*\ue01f]*[^\\s*\ue01f])?)\\*", r"\1")] * 3,
    *[("(^|[^\\p{L}\\p{N}_])_([^\\s_\ue01f]([^_\ue01f]*[^\\s_\ue01f])?)_($|[^\\p{L}\\p{N}_])", r"\1\2\4")] * 3,
    ("`+", ""),
    ("\n?\ue01f\n?", "\n"), (r"^\n+|\n+\z", ""),
]
_BOILER = [
    (p, "") for p in (
        "(?i)on this page", "(?i)table of contents", r"(?i)was this page helpful\?", "(?i)edit this page on.*",
        r"(?i)next\s*→", r"(?i)←\s*previous", r"(?i)© \d{4}.* All rights reserved.",
    )
]
_SPACING = [(r"[ \t]+", " "), (r"\n{3,}", "\n\n")]


def _cleaned(expr: str) -> str:
    parked = _replaces(_subs(expr, _CLEAN), _PARKED)
    plain = _subs(_decode(_subs(parked, _PLAIN)), [(r"\\([!-/:-@\[-`{-~])", r"\1")])
    restored = _replaces(plain, [(p, e[1]) for e, p in _PARKED])
    return _strip(_subs(f"lower({_subs(restored, _BOILER)})", _SPACING))


_CLEANED = f"""
clean AS (SELECT *, {_cleaned('text')} AS document FROM chunk WHERE text <> ''),
kept AS (SELECT * FROM clean WHERE document <> '')
"""
CLEAN_CHUNKS = f"WITH {_DOCS}, {_CHUNKS}, {_CLEANED} SELECT page_id, chunk_idx, document FROM kept"

_WORD_LIST = r"regexp_extract_all(text, '[^ \t\n\r\x0b\x0c\x1c-\x1f\x{a0}\x{2028}\x{2029}]+')"
MIN_WORDS = f"SELECT doc_id, CAST(len({_WORD_LIST}) AS INTEGER) AS n_words FROM documents WHERE len({_WORD_LIST}) >= 60"

# --- sources and stores ----------------------------------------------------

SELECT_TARGETS = """
WITH req AS (SELECT doc_id, source || '-' || lang AS target FROM documents),
known AS (
  SELECT r.target, CASE WHEN count(*) > 3 THEN count(*) ELSE 1000 END AS page_limit
  FROM req r JOIN labels l ON r.doc_id = l.doc_id AND l.quality = 1 GROUP BY 1
)
SELECT r.target, r.doc_id, CAST(coalesce(k.page_limit, -1) AS INTEGER) AS page_limit FROM req r LEFT JOIN known k ON r.target = k.target
"""
SOURCE_FALLBACK = """
WITH req AS (SELECT doc_id, source || '-' || lang AS target FROM documents),
prim AS (SELECT r.target, r.doc_id, 'primary' AS origin FROM req r JOIN labels l ON r.doc_id = l.doc_id WHERE l.quality = 1)
SELECT * FROM prim
UNION ALL
SELECT r.target, r.doc_id, 'fallback' FROM req r WHERE NOT EXISTS (SELECT 1 FROM prim p WHERE p.target = r.target)
"""
NORMALIZE_FEED = """
SELECT doc_id, CASE WHEN lang <> 'es' THEN source END AS title, CASE WHEN lang <> 'es' THEN lang END AS language,
  CAST(NULL AS VARCHAR) AS source_url, CASE WHEN lang <> 'es' THEN CAST(n_chars AS VARCHAR) END AS length,
  CAST(CASE WHEN lang <> 'es' THEN 1 ELSE 0 END AS INTEGER) AS n_extra
FROM documents
"""
CACHE_ROUNDTRIP = """
SELECT lang AS target, doc_id AS doc_ord,
  md5(CASE lang WHEN 'fr' THEN 'skipped unless new' WHEN 'de' THEN 'forced' ELSE text END) AS markdown_md5,
  source || '/' || doc_id AS source_url
FROM documents
"""
DEDUPE_LAST = """
SELECT md5(text) AS text_md5, doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) = 1
"""
UPSERT_VECTORS = """
SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 'label ' || label AS document, 'old' AS source_url, 64 AS width
FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'quality ' || quality, 'new', 1 FROM labels
"""
PACK_METADATA = f"""
WITH {_DOCS}, {_CHUNKS}, {_CLEANED},
n AS (SELECT target, count(*) AS chunks FROM kept GROUP BY 1)
SELECT d.target AS framework, '2024.01.31' AS version, count(*) AS documents_scraped,
  coalesce(any_value(n.chunks), 0) AS chunks_embedded, 'hashing-64' AS embedding_model
FROM docs d LEFT JOIN n ON n.target = d.target GROUP BY d.target
"""
def _doc_chunk(text: str = "text") -> str:
    return f"""
WITH told AS (SELECT doc_id, lang, source, {text} AS text FROM documents),
kept AS (
  SELECT lang AS target, sha256(source || '/' || doc_id || '-0') AS chunk_id, source || '/' || doc_id AS source_url, text,
    {_cleaned('text')} AS document
  FROM told WHERE text <> ''
)
"""


PACK_ROUNDTRIP = f"""{_doc_chunk()}
SELECT target, chunk_id, source_url, 64 AS width, md5(text) AS text_md5, 'General' AS header FROM kept WHERE document <> ''
"""
# the third batch has the last word, then the second; of an id that a batch has twice, the later document; one that stands there only as older is that
_STREAMED = """CASE WHEN doc_id % 3 = 0 THEN 'third ' || text WHEN (doc_id - 1) % 9 = 5 THEN 'older ' || text
  WHEN doc_id % 2 = 0 THEN text WHEN (doc_id - 1) % 4 = 0 THEN 'older ' || text ELSE 'first ' || text END"""
STREAM_DOCUMENTS = f"{_doc_chunk(_STREAMED)} SELECT target, chunk_id, source_url, 64 AS width, md5(text) AS text_md5 FROM kept WHERE document <> ''"
PAGE_DOCUMENTS = f"""
SELECT m.page_id, md5(d.markdown) AS markdown_md5, m.source_url, m.title
FROM ({PAGE_METADATA}) m JOIN (SELECT page_id, {_MARKDOWN} AS markdown FROM pages) d USING (page_id) WHERE d.markdown <> ''
"""
JSON_CACHE = "SELECT 'all' AS target, md5(text) AS markdown_md5, source || '/' || doc_id AS source_url FROM documents"
UNKNOWN_SOURCE = "SELECT doc_id AS doc_ord, CASE WHEN doc_id % 3 <> 0 THEN source || '/' || doc_id ELSE 'unknown' END AS source_url FROM documents"
VERSION_STAMPS = "SELECT strftime(ts, '%Y.%m.%d') AS version, count(*) AS events FROM events GROUP BY 1"
_PACKED = "SELECT lpad(CAST(label AS VARCHAR), 3, '0') AS target, CAST(vec_id AS VARCHAR) AS chunk_id, label, vec_id FROM embeddings"
REBUILD_PACK = f"""
WITH p AS (SELECT *, label % 2 = 0 AND vec_id % 3 = 0 AS new, label % 2 = 0 AS built FROM ({_PACKED}))
SELECT pruned, target, CASE WHEN built THEN '2024.10' ELSE '2024.9' END AS version, chunk_id,
  CASE WHEN new THEN 'new ' ELSE 'old ' END || vec_id AS document, CASE WHEN new THEN 'new ' ELSE 'old ' END || vec_id AS text, 64 AS width
FROM p, (VALUES (FALSE), (TRUE)) AS t(pruned) WHERE NOT (pruned AND built AND NOT new)
"""
LOAD_NUMERIC_NAMES = f"""
SELECT target, v AS version, chunk_id, v AS document FROM (SELECT *, CASE WHEN label = 7 THEN '2024.9' ELSE '2024.10' END AS v FROM ({_PACKED}))
"""
TRIGGER_RUN = """
SELECT source AS target, '2024.01.000000' AS version, CAST(1 AS BIGINT) AS chunks, CAST(1 AS BIGINT) AS commits
FROM documents WHERE regexp_matches(source, '[02468]$') GROUP BY 1
"""

# --- vectors and retrieval -------------------------------------------------


def _nearest(shift: int) -> str:
    return f"""
v AS (
  SELECT vec_id, 'label_' || label AS target, 'label_' || (label + {shift}) AS asked, CAST(vec_id AS VARCHAR) AS chunk_id,
    CAST(embedding AS DOUBLE[]) AS e, 2 + vec_id % 4 AS n_results,
    CASE WHEN vec_id % 3 <> 0 THEN 'src/' || vec_id END AS source_url
  FROM embeddings
), pairs AS (
  SELECT q.vec_id AS query_id, q.asked AS target, q.n_results, v.chunk_id, v.source_url,
    list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i]))) AS d
  FROM v q JOIN v ON q.asked = v.target
), hits AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS INTEGER) AS rank FROM pairs
  QUALIFY rank <= n_results
)
"""


KNN_EXACT = f"WITH {_nearest(0)} SELECT query_id, rank, chunk_id, round(d, 6) AS distance FROM hits"
KNN_APPROX = """
WITH v AS (
  SELECT vec_id, CAST(vec_id AS VARCHAR) AS chunk_id, CAST(embedding AS DOUBLE[]) AS e, 2 + vec_id % 4 AS n_results FROM embeddings
), pairs AS (
  SELECT q.vec_id AS query_id, q.n_results, v.chunk_id,
    list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i]))) AS d
  FROM v q, v
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS INTEGER) AS rank, chunk_id, round(d, 6) AS distance
FROM pairs QUALIFY rank <= n_results
"""
NORMALIZE_VECTORS = """
WITH d AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * label) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM d)
SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos,
  round(CASE WHEN norm > 0 THEN unnest(v) / norm ELSE unnest(v) END, 6) AS value
FROM n
"""
KNN_RESPONSE = f"""
WITH {_nearest(1)}
SELECT e.vec_id AS query_id,
  coalesce(string_agg('text of ' || chunk_id, '|' ORDER BY rank), '') AS documents,
  coalesce(string_agg(CASE WHEN chunk_id IS NOT NULL THEN coalesce(source_url, '-') END, '|' ORDER BY rank), '') AS sources,
  round(coalesce(sum(d), 0), 5) AS total_distance
FROM embeddings e LEFT JOIN hits ON hits.query_id = e.vec_id GROUP BY e.vec_id
"""
KNN_CONTEXT = f"""
WITH {_nearest(1)},
found AS (
  SELECT query_id, string_agg('Source: ' || coalesce(source_url, 'N/A') || chr(10) || 'Content: text of ' || chunk_id,
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits GROUP BY 1
)
SELECT v.vec_id AS query_id, v.asked AS target,
  coalesce(context, CASE WHEN v.asked IN (SELECT target FROM v)
    THEN 'No relevant information found in the ''' || v.asked || ''' knowledge base for your query.'
    ELSE 'Error: The knowledge base for the target ''' || v.asked || ''' does not exist. Please try a different target.' END) AS context
FROM v LEFT JOIN found ON found.query_id = v.vec_id
"""
ATTACH_RAW = f"""
WITH {_nearest(0)}
SELECT h.query_id, h.rank, h.chunk_id, d.source AS header, md5(d.text) AS text_md5
FROM hits h LEFT JOIN documents d
  ON CAST(d.doc_id AS VARCHAR) = h.chunk_id
"""


def _hashed(source: str, key: str, col: str) -> str:
    """Word counts hashed into 64 signed buckets and scaled, as (key, pos, value) for every bucket."""
    return f"""
tok AS (
  SELECT {key}, unnest(regexp_extract_all({col}, '[^ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f\\x{{a0}}\\x{{2028}}\\x{{2029}}]+')) AS w FROM {source}
), slot AS (
  SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS pos,
    CASE WHEN substr(md5(w), 9, 1) IN ('0','1','2','3','4','5','6','7') THEN 1 ELSE -1 END AS s FROM tok
), summed AS (SELECT {key}, pos, CAST(sum(s) AS DOUBLE) AS s FROM slot GROUP BY ALL
), norms AS (SELECT {key}, sqrt(sum(s * s)) AS norm FROM summed GROUP BY ALL
), hashed AS (
  SELECT d.{key.replace(', ', ', d.')}, r.pos,
    CASE WHEN norm > 0 THEN CAST(CAST(coalesce(s.s, 0) / norm AS FLOAT) AS DOUBLE) ELSE 0 END AS value
  FROM (SELECT DISTINCT {key} FROM {source}) d CROSS JOIN (SELECT unnest(range(64)) AS pos) r
  LEFT JOIN summed s USING ({key}, pos) LEFT JOIN norms USING ({key})
)
"""


EMBED_HASH = f"""
WITH lowered AS (SELECT doc_id, lower(text) AS document FROM documents), {_hashed('lowered', 'doc_id', 'document')}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(value, 5) AS value FROM hashed
"""
_TITLE = _strip(_decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
PACK_SEARCH = f"""
WITH {_DOCS}, {_CHUNKS}, {_CLEANED},
items AS (
  SELECT chunk_id AS id, target, document, FALSE AS asks FROM kept
  UNION ALL SELECT CAST(page_id AS VARCHAR), {_host('url')}, {_cleaned(_TITLE)}, TRUE FROM pages
),
{_hashed('items', 'id', 'document')},
vec AS (SELECT id, list(value ORDER BY pos) AS e FROM hashed GROUP BY 1),
pairs AS (
  SELECT q.id, list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) AS d
  FROM items q JOIN items c ON q.target = c.target AND q.asks AND NOT c.asks JOIN vec a ON a.id = q.id JOIN vec b ON b.id = c.id
)
SELECT CAST(id AS BIGINT) AS query_id, CAST(row_number() OVER (PARTITION BY id ORDER BY d) AS INTEGER) AS rank, round(d, 4) AS distance
FROM pairs QUALIFY rank <= 3
"""

# --- entities, triples, graph ----------------------------------------------

_GCHUNK = f"""
gchunk AS (
  SELECT lang AS target, doc_id, source || '/' || doc_id AS source_url, text,
    sha256(source || '/' || doc_id || '-0-General') AS chunk_id
  FROM documents WHERE len({_WORD_LIST}) >= 5
)
"""
_RULES = """
rules AS (
  SELECT DISTINCT target, doc_id, chunk_id, unnest(regexp_extract_all(text, '(?:^|[ \\n])([A-Z][a-z]{4,}) ', 1)) AS entity, 'NAME' AS label FROM gchunk
  UNION
  SELECT DISTINCT target, doc_id, chunk_id, unnest(regexp_extract_all(text, ' ([a-z]{6,})\\.(?: |$)', 1)), 'CLOSE' FROM gchunk
)
"""
_FACTS = """
word AS (SELECT target, doc_id, chunk_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM gchunk),
facts AS (
  SELECT target, doc_id, chunk_id, pos, w[2 + 3 * pos] AS subject, w[3 + 3 * pos] AS predicate, w[4 + 3 * pos] AS object
  FROM (SELECT *, unnest(range(0, (len(w) - 1) // 3)) AS pos FROM word WHERE len(w) >= 4)
),
mentions AS (
  SELECT target, doc_id, chunk_id, entity, label, 0 AS priority FROM rules
  UNION SELECT target, doc_id, chunk_id, subject, 'ENTITY', 2 FROM facts
  UNION SELECT target, doc_id, chunk_id, object, 'ENTITY', 2 FROM facts
)
"""
_EDGES = """
edges AS (
  SELECT target, subject AS src, object AS dst, predicate AS label FROM facts
  QUALIFY row_number() OVER (PARTITION BY target, subject, object ORDER BY doc_id DESC, pos DESC) = 1
)
"""
RULE_ENTITIES = f"WITH {_GCHUNK}, {_RULES} SELECT target, doc_id AS doc_ord, chunk_id, entity, label FROM rules"
RULE_ENTITIES_MANY = f"""
WITH {_GCHUNK}, w AS (SELECT target, doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM gchunk),
often AS (SELECT target, word FROM w WHERE length(word) >= 6 GROUP BY ALL ORDER BY count(*) DESC, target, word LIMIT 5000)
SELECT DISTINCT target, doc_id AS doc_ord, word AS entity, CASE WHEN length(word) % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS label
FROM w JOIN often USING (target, word)
"""
RECOGNIZED_ENTITIES = f"""
WITH {_GCHUNK}
SELECT DISTINCT target, doc_id AS doc_ord, unnest(regexp_extract_all(text, '([A-Z][a-z]{{2,}})[,.]', 1)) AS entity, 'NAME' AS label
FROM gchunk
"""
_TURNS = """
turns AS (SELECT conv_id, turn, role, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations WHERE role <> 'system')
"""


def _parsed(where: str) -> str:
    return f"""
WITH {_TURNS}
SELECT conv_id, turn, 0 AS pos, ' ' || role AS subject, 'says' AS predicate, coalesce(w[1], 'none') AS object FROM turns WHERE {where}
UNION ALL SELECT conv_id, turn, CAST(2 + k AS INTEGER), coalesce(w[2 + 2 * k], 'none'), '7', coalesce(w[3 + 2 * k], 'none')
FROM (SELECT *, unnest(range(0, greatest(1, len(w) // 2))) AS k FROM turns WHERE {where})
"""


EXTRACTION_PROMPT = """
WITH o AS (SELECT lang, [min(source), max(source) || ' \\u00e9\\ud83d\\ude00'] AS s FROM documents WHERE lang <> 'de' GROUP BY 1)
SELECT doc_id, md5(
  'Perform Named Entity Recognition (NER) and extract knowledge graph triplets from the text. NER identifies named entities of given entity types, and triple extraction identifies relationships between entities using specified predicates.'
  || chr(10) || chr(10) || '**Entity Types:**' || chr(10) || '{"entity_types": ["' || array_to_string(s, '", "') || '"]}'
  || chr(10) || chr(10) || '**Predicates:**' || chr(10) || '{"predicates": ["says", "is \\"a\\""]}'
  || chr(10) || chr(10) || '**Text:**' || chr(10) || text || chr(10)) AS prompt_md5
FROM documents d JOIN o ON o.lang = d.lang
"""
_MENTIONED = f"WITH {_GCHUNK}, {_RULES}, {_FACTS}"
GRAPH_NODES = f"""{_MENTIONED}
SELECT target, entity AS text, arg_min(label, (doc_id, priority, label)) AS label, count(DISTINCT chunk_id) AS n_chunks
FROM mentions GROUP BY 1, 2
"""
GRAPH_NODE_PAGES = f"""{_MENTIONED},
once AS (SELECT DISTINCT target, entity, doc_id, chunk_id FROM mentions)
SELECT target, entity AS text, doc_id // 100 AS page, CAST(count(*) AS INTEGER) AS n, md5(string_agg(chunk_id, ',' ORDER BY doc_id)) AS ids_md5
FROM once GROUP BY 1, 2, 3
"""
GRAPH_EDGES = f"{_MENTIONED}, {_EDGES} SELECT target, src, dst, label FROM edges"
GRAPH_ROUNDTRIP = f"""{_MENTIONED}, {_EDGES}
SELECT target, entity AS src, CAST(NULL AS VARCHAR) AS dst, arg_min(label, (doc_id, priority, label)) AS label FROM mentions GROUP BY 1, 2
UNION ALL SELECT target, src, dst, label FROM edges
"""
GRAPH_STATS = f"""{_MENTIONED}, {_EDGES}
SELECT g.target, (SELECT count(DISTINCT entity) FROM mentions m WHERE m.target = g.target) AS nodes,
  (SELECT count(*) FROM edges e WHERE e.target = g.target) AS edges, count(DISTINCT chunk_id) AS chunks
FROM gchunk g GROUP BY g.target
"""
GRAPH_PROVENANCE = f"""{_MENTIONED}
SELECT m.target, g.source_url, 'General' AS header, count(DISTINCT m.entity) AS n_nodes
FROM mentions m JOIN gchunk g USING (target, chunk_id) GROUP BY 1, 2
"""
GRAPH_BUILD = f"""
WITH {_GCHUNK}, word AS (SELECT target, doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM gchunk),
facts AS (
  SELECT target, doc_id, k, coalesce(w[1 + 3 * k], 'a') AS src, coalesce(w[2 + 3 * k], CASE len(w) - 3 * k WHEN 1 THEN 'a' ELSE 'b' END) AS label,
    coalesce(w[3 + 3 * k], CASE len(w) - 3 * k WHEN 2 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END) AS dst
  FROM (SELECT *, unnest(range(0, greatest(1, (len(w) + 2) // 3))) AS k FROM word)
)
SELECT target, src, dst, label FROM facts
QUALIFY row_number() OVER (PARTITION BY target, src, dst ORDER BY doc_id DESC, k DESC) = 1
"""

# --- crawl and streaming ---------------------------------------------------

CRAWL_RANKS = """
WITH RECURSIVE site AS (
  SELECT d.source, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS n,
    coalesce(l.toxic, 0) = 0 AS ok, coalesce(l.quality, 1) = 1 AS has_content
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), reached AS (
  SELECT source, n, ok, has_content, 0 AS depth FROM site WHERE n = 1
  UNION ALL
  SELECT s.source, s.n, s.ok, s.has_content, r.depth + 1 FROM reached r JOIN site s ON s.source = r.source AND s.n // 2 = r.n AND s.n > 1
  WHERE r.ok
), sizes AS (SELECT source, max(n) AS total FROM site GROUP BY 1),
-- a page links to 2n+1 before 2n
ranked AS (
  SELECT r.source, n, depth, total, row_number() OVER (
    PARTITION BY r.source ORDER BY depth, (SELECT coalesce(string_agg(CASE WHEN (n >> i) % 2 = 1 THEN '0' ELSE '1' END, '' ORDER BY i DESC), '')
      FROM (SELECT unnest(range(0, CAST(depth AS BIGINT))) AS i))) AS doc_ord
  FROM reached r JOIN sizes z ON z.source = r.source WHERE ok AND has_content
)
SELECT source AS target, 'https://' || source || '.example.org/p/' || n AS url, CAST(depth AS INTEGER) AS depth, doc_ord
FROM ranked WHERE doc_ord <= total // 3
"""
FULL_RUN = f"""
SELECT target, sha256(url || '-0') AS chunk_id, url AS source_url, 64 AS width FROM ({CRAWL_RANKS.replace("total // 3", "total")})
"""
STREAM_TRIGGERS = """
SELECT event_type AS target, CAST(count(*) AS INTEGER) AS page_limit FROM events
WHERE event_type NOT IN ('error', 'view') GROUP BY 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "page_metadata": PAGE_METADATA,
        "page_links": PAGE_LINKS,
        "same_host_links": SAME_HOST_LINKS,
        "main_content": MAIN_CONTENT,
        "header_chunks": HEADER_CHUNKS,
        "clean_chunks": CLEAN_CHUNKS,
        "min_words": MIN_WORDS,
        "select_targets": SELECT_TARGETS,
        "source_fallback": SOURCE_FALLBACK,
        "normalize_feed": NORMALIZE_FEED,
        "cache_roundtrip": CACHE_ROUNDTRIP,
        "dedupe_last": DEDUPE_LAST,
        "upsert_vectors": UPSERT_VECTORS,
        "pack_metadata": PACK_METADATA,
        "pack_roundtrip": PACK_ROUNDTRIP,
        "page_documents": PAGE_DOCUMENTS,
        "json_cache": JSON_CACHE,
        "unknown_source": UNKNOWN_SOURCE,
        "version_stamps": VERSION_STAMPS,
        "metadata_sink": PACK_METADATA,
        "rebuild_pack": REBUILD_PACK,
        "load_numeric_names": LOAD_NUMERIC_NAMES,
        "query_packs": PACK_SEARCH,
        "graph_roundtrip": GRAPH_ROUNDTRIP,
        "trigger_run": TRIGGER_RUN,
        "knn_exact": KNN_EXACT,
        "knn_blocked": KNN_EXACT,
        "knn_approx": KNN_APPROX,
        "normalize_vectors": NORMALIZE_VECTORS,
        "knn_response": KNN_RESPONSE,
        "knn_context": KNN_CONTEXT,
        "attach_raw": ATTACH_RAW,
        "embed_hash": EMBED_HASH,
        "pack_search": PACK_SEARCH,
        "rule_entities": RULE_ENTITIES,
        "rule_entities_many": RULE_ENTITIES_MANY,
        "recognized_entities": RECOGNIZED_ENTITIES,
        "parse_triples": _parsed("TRUE"),
        "parse_marked_triples": _parsed("role <> 'user'"),
        "extraction_prompt": EXTRACTION_PROMPT,
        "graph_nodes": GRAPH_NODES,
        "graph_node_pages": GRAPH_NODE_PAGES,
        "graph_edges": GRAPH_EDGES,
        "graph_stats": GRAPH_STATS,
        "graph_provenance": GRAPH_PROVENANCE,
        "graph_build": GRAPH_BUILD,
        "crawl_ranks": CRAWL_RANKS,
        "full_run": FULL_RUN,
        "stream_documents": STREAM_DOCUMENTS,
        "stream_triggers": STREAM_TRIGGERS,
    }
