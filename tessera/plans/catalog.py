"""Every query of the library that does not belong to the llm subpackage.

Each is a function (spark, sf_dir) -> DataFrame over the given tables; ORACLES has SQL of the same
result where SQL can state it. Searches ask with every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bpe, checks, text, tokens, vectors
from ..operators import analytics, chunking, citations, context, embedding, exports, generation, index, judged, layout, retrieval, store
from ..sources import archives, files
from ..sources.shared import new_path
from ..streaming import timings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "retrieval_hybrid"
FLOAT_DIGITS = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


# Words, sentences and chunk tokens in DuckDB, of a text column x.
def _words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


def _tokens(x: str, n: str = "") -> str:
    n = n or _words(x)
    return f"(CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, {n}, least(CAST(floor(CASE WHEN length({x}) < 1000 THEN {n} * 1.33::DOUBLE ELSE ({n} * 1.3::DOUBLE + length({x}) / 4.0::DOUBLE) / 2 END) AS INT), length({x}) // 2)) END)"


# Greedy packing in DuckDB: a table u (doc_id, ord, p, n, key) to groups (doc_id, c, text).


def _grouped(units: str, size: int, name: str, by: str = "doc_id", joint: str = "' '") -> str:
    opens = f"(len(a.cs) = 0 OR a.n + x.n > {size} OR a.key <> x.key)"
    return f"""
{name}_l AS (SELECT {by}, list(struct_pack(n := n::INT, key := key::INT, c := -1::INT, cs := []::INT[]) ORDER BY ord) AS l FROM {units} GROUP BY ALL),
{name}_c AS (SELECT {by}, list_reduce(l, lambda a, x: struct_pack(n := (CASE WHEN {opens} THEN x.n ELSE a.n + x.n END)::INT, key := x.key, c := (a.c + {opens}::INT)::INT, cs := list_append(a.cs, (a.c + {opens}::INT)::INT)),
  struct_pack(n := 0::INT, key := -9::INT, c := -1::INT, cs := []::INT[])).cs AS cs FROM {name}_l),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ord) AS r FROM {units}),
{name}_u AS (SELECT {by}, unnest(cs) AS c, generate_subscripts(cs, 1) AS r FROM {name}_c),
{name} AS (SELECT {by}, c, string_agg(p, {joint} ORDER BY r) AS text FROM {name}_o JOIN {name}_u USING ({by}, r) GROUP BY ALL)"""


# --- token estimates and texts -------------------------------------------------------------------


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), w AS (SELECT *, {_words('x')} AS n FROM d)
SELECT doc_id, CAST(n AS INT) AS words, CAST({_tokens('x', 'n')} AS INT) AS chunk_tokens,
  CAST(floor(floor(n * 1.3::DOUBLE) * 1.05::DOUBLE) AS INT) AS prompt_tokens,
  CAST(greatest(10, floor(floor(floor(n * 1.8::DOUBLE) * 1.15::DOUBLE) * 1.10::DOUBLE)) AS INT) AS context_tokens,
  CAST(floor((n * 1.3::DOUBLE + length(x) / 4.0::DOUBLE) / 2) AS INT) AS clean_tokens,
  CAST(greatest(1, floor(n * 1.3::DOUBLE + len(regexp_extract_all(x, '[^\\p{{L}}\\p{{N}}_\\s]')) * 0.5::DOUBLE)) AS INT) AS punctuated_tokens
FROM w
""")
def token_estimates(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select(
        "doc_id", tokens.word_count("text").alias("words"), tokens.chunk_tokens("text").alias("chunk_tokens"), tokens.prompt_tokens("text").alias("prompt_tokens"),
        tokens.context_tokens("text").alias("context_tokens"), tokens.clean_tokens("text").alias("clean_tokens"), tokens.punctuated_tokens("text").alias("punctuated_tokens"),
    )


@query(f"""
WITH w AS (SELECT doc_id, text AS x, {_words('text')} AS n FROM documents),
p AS (SELECT *, CAST(floor(floor(n * 1.3::DOUBLE) * 1.05::DOUBLE) AS INT) AS k FROM w)
SELECT doc_id, k AS tokens, k + 1000 <= 8192 AS fits, greatest(0, 8092 - k) AS completion, round(k / 1000.0::DOUBLE * 0.002::DOUBLE, 6) AS cost,
  CASE WHEN n <= 40 THEN x ELSE array_to_string(list_slice(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''), 1, 40), ' ') END AS head,
  CASE WHEN n <= 40 THEN x ELSE array_to_string(list_slice(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''), n - 39, n), ' ') END AS tail
FROM p
""")
def token_budget(spark, sf_dir):
    k = tokens.prompt_tokens("text")
    return documents(spark, sf_dir).select("doc_id", k.alias("tokens"), tokens.fits(k).alias("fits"), tokens.completion_budget(k).alias("completion"), tokens.cost(k).alias("cost"), tokens.keep_words("text", 40).alias("head"), tokens.keep_words("text", 40, "start").alias("tail"))


_ENTITIES = (("&quot;", "chr(34)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&#39;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'"))
_BARE = "regexp_replace(html, '<[^>]+>', '', 'g')"
for _name, _sign in _ENTITIES:
    # An ampersand's name is resolved without its semicolon too; it comes last, so that nothing is resolved twice.
    _BARE = f"regexp_replace({_BARE}, '&amp;?', '&', 'g')" if _name == "&amp;" else f"replace({_BARE}, '{_name}', {_sign})"


@query(rf"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace({_BARE}, 'https?://[^\s]+', ' ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', ' ', 'g') AS a FROM pages),
q AS (SELECT page_id, translate(a, '“”«»‘’‹›•◦▪▫⬩▹▸►▻→', repeat(chr(34), 4) || repeat(chr(39), 4) || repeat('•', 10)) AS a FROM a)
SELECT page_id, trim(regexp_replace(regexp_replace(a, '[ \t\r\f]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), E' \t\n\r') AS text FROM q
""")
def cleaned_pages(spark, sf_dir):
    """The SQL resolves the entities that the tables have; the operator all there are."""
    return t(spark, sf_dir, "pages").select("page_id", text.clean("html", urls=True, emails=True).alias("text"))


@query("""
SELECT page_id, url LIKE 'http://%' OR url LIKE 'https://%' AS valid, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain,
  length(regexp_replace(html, '<[^>]+>', '', 'g')) AS chars
FROM pages
""")
def page_urls(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", checks.valid_url("url").alias("valid"), checks.domain("url").alias("domain"), F.length(text.without_tags("html")).alias("chars"))


@query(r"""
SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda l:
    NOT regexp_matches(trim(l), '^\d+$')
    AND NOT regexp_matches(trim(l), '^(page \d+ of \d+$|\d+/\d+$|header:|draft|confidential)', 'i')
    AND NOT regexp_matches(trim(l), '^(copyright ©|all rights reserved|footer:|\d{4} .+ inc\.)', 'i')), chr(10))) AS kept
FROM documents
""")
def boilerplate_removed(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(text.without_boilerplate("text"), 256).alias("kept"))


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
f AS (SELECT doc_id, x, min(i) AS i FROM l GROUP BY ALL)
SELECT doc_id, sha256(string_agg(x, chr(10) ORDER BY i)) AS kept, count(*) AS n_lines FROM f GROUP BY doc_id
""")
def deduplicated_lines(spark, sf_dir):
    kept = text.distinct_lines("text")
    return documents(spark, sf_dir).select("doc_id", F.sha2(kept, 256).alias("kept"), F.size(F.split(kept, "\n")).cast("long").alias("n_lines"))


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, E' \\t\\n\\r')), lambda s: s <> '')"


@query(r"""
WITH q AS (SELECT doc_id, translate(text, '“”«»‘’‹›•◦▪▫⬩▹▸►▻→', repeat(chr(34), 4) || repeat(chr(39), 4) || repeat('•', 10)) AS a FROM documents)
SELECT doc_id, sha256(a) AS normalised, length(regexp_replace(a, '[^a-zA-Z0-9\s.,!?;:''\-]', '', 'g')) AS plain_chars,
  sha256(regexp_replace(trim(regexp_replace(a, '[ \t\r]+', ' ', 'g'), E' \t\n\r'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')) AS squeezed
FROM q
""")
def normalised_text(spark, sf_dir):
    a = text.plain_bullets(text.plain_quotes("text"))
    return documents(spark, sf_dir).select("doc_id", F.sha2(a, 256).alias("normalised"), F.length(text.without_special(a)).alias("plain_chars"), F.sha2(text.clean("text", html=False), 256).alias("squeezed"))


@query(f"""
WITH w AS (SELECT doc_id, text AS x, {_words('text')} AS n FROM documents)
SELECT doc_id, n >= 3 AND length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) >= 3 AS meaningful, length(trim(x)) >= 50 AND regexp_matches(x, '[.!?]') AS sufficient,
  length(trim(x)) >= 1 AND length(x) <= 1000 AND n >= 1 AND length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) >= 3 AS valid_query,
  CASE WHEN length(x) <= 100 THEN x WHEN instr(substr(x, 2, 96), ' ') > 0 THEN regexp_extract(substr(x, 1, 97), '(?s)^(.*) [^ ]*$', 1) || '...' ELSE substr(x, 1, 97) || '...' END AS short
FROM w
""")
def text_checks(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", checks.meaningful("text").alias("meaningful"), checks.sufficient("text").alias("sufficient"), checks.valid_query("text").alias("valid_query"), text.truncated("text", 100).alias("short"))


@query(f"""
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS lines, length(text) AS chars, CAST({_words('text')} AS INT) AS words,
  round(length(replace(text, chr(10), '')) / len(string_split(text, chr(10)))::DOUBLE, 4) AS mean_line,
  CAST(greatest(1, length(text) // 3000) AS INT) AS pages, trim(text) = '' AS blank
FROM documents
""")
def text_measures(spark, sf_dir):
    return files.text_measures(documents(spark, sf_dir))


@query(r"""
WITH l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
m AS (SELECT doc_id, sha256(string_agg(CASE WHEN upper(trim(x)) = trim(x) AND lower(trim(x)) <> trim(x) AND length(trim(x)) < 100 THEN '[HEADER] ' || x WHEN regexp_matches(trim(x), '^[\d•\-*]\s') THEN '[LIST] ' || x ELSE x END, chr(10) ORDER BY i)) AS marked FROM l GROUP BY doc_id),
p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda p: trim(p)), lambda p: p <> '') AS ps FROM documents),
u AS (SELECT doc_id, generate_subscripts(ps, 1) AS ord, unnest(ps) AS p FROM p), u2 AS (SELECT *, length(p) + 2 AS n, 0 AS key FROM u),""" + _grouped("u2", 504, "g", joint="'. '") + """,
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT doc_id, marked, CAST(coalesce(n, 0) AS INT) AS sections FROM m LEFT JOIN s USING (doc_id)
""")
def marked_structure(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(text.marked_structure("text"), 256).alias("marked"), F.size(text.sections("text", 500)).alias("sections"))


# --- chunking ------------------------------------------------------------------------------------


@query(r"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '(?m)^[a-z]\)\s+[A-Z]')) > 2 AS project_headers, len(regexp_extract_all(text, '[●❖]')) > 5 AS bullets,
  len(regexp_extract_all(text, '(?m)^\d+\.\s+[A-Z]')) > 2 AS numbered, len(regexp_extract_all(text, '(?m)^●\s+\w+.*:')) > 3 AS subsections,
  len(list_filter(string_split(text, chr(10)), lambda l: l LIKE '   %' OR l LIKE chr(9) || '%')) > len(string_split(text, chr(10))) * 0.2 AS indented FROM documents)
SELECT *, (project_headers::INT + bullets::INT + numbered::INT + subsections::INT + indented::INT) / 5.0::DOUBLE AS structure_score,
  project_headers::INT + bullets::INT + numbered::INT + subsections::INT + indented::INT >= 2 AS has_structure FROM c
""")
def document_structure(spark, sf_dir):
    return chunking.structure(documents(spark, sf_dir))


def _sentences_of(x: str) -> str:
    held = x
    for word in text.ABBREVIATIONS:
        held = f"replace({held}, '{word}', replace('{word}', '.', chr(2)))"
    split = f"string_split(regexp_replace({held}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"list_filter(list_transform({split}, lambda s: trim(replace(s, chr(2), '.'), E' \\t\\n\\r')), lambda s: s <> '')"


def _packed(source: str, size: int, name: str, by: str = "doc_id") -> str:
    """Sentences of source (doc_id, text) packed to size."""
    return f"""
{name}_s AS (SELECT {by}, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT {by}, {_sentences_of("text")} AS ss FROM {source})),
{name}_n AS (SELECT *, {_tokens("s")} AS n FROM {name}_s),
{name}_p AS (SELECT {by}, i, CASE WHEN n > {size} THEN i ELSE -1 END AS key, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM (
  SELECT *, CASE WHEN n > {size} THEN list_filter(list_transform(string_split(replace(s, ';', ','), ','), lambda p: trim(p)), lambda p: p <> '') ELSE [s] END AS ps FROM {name}_n)),
{name}_q AS (SELECT {by}, i * 100000 + j AS ord, p, {_tokens("p")} AS n, key FROM {name}_p),{_grouped(f"{name}_q", size, name, by)}"""


_CLEAN_CHUNK = r"trim(regexp_replace(regexp_replace(text, '\[PAGE \d+\]|\[HEADER\]|\[FOOTER\]|\[TABLE \d+\]', '', 'g'), '\s+', ' ', 'g'))"


def _fixed(size: int, least: int, name: str = "k") -> str:
    return f"""{_packed("documents", size, f"{name}0")},
{name}1 AS (SELECT doc_id, c AS chunk_index, {_CLEAN_CHUNK} AS text FROM {name}0),
{name} AS (SELECT *, CAST({_tokens("text")} AS INT) AS token_count FROM {name}1 WHERE {_tokens("text")} >= {least})"""


_CHUNK_ID = "'chunk_' || doc_id || '_' || chunk_index AS chunk_id"


@query(f"WITH {_fixed(512, 100)} SELECT doc_id, chunk_index, text, token_count, {_CHUNK_ID} FROM k")
def chunks_fixed(spark, sf_dir):
    return chunking.fixed(documents(spark, sf_dir), 512, 100)


def _lent(t: str, n: str, tokens: int, end: bool) -> str:
    size = f"CAST(trunc(length({t}) * {tokens} / greatest(1, {n})::DOUBLE) AS INT)"
    cut = f"right({t}, greatest(1, {size}))" if end else f"regexp_replace(left({t}, {size}), '\\s+\\S*$', '')"
    return f"CASE WHEN {n} <= {tokens} THEN {t} ELSE {cut} END"


_OVERLAPPING = f"""{_fixed(256, 50)},
v AS (SELECT *, lag(text) OVER w AS pt, lag(token_count) OVER w AS pn, lead(text) OVER w AS nt, lead(token_count) OVER w AS nn FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
o AS (SELECT doc_id, chunk_index, concat_ws(' ', {_lent("pt", "pn", 25, True)}, text, {_lent("nt", "nn", 25, False)}) AS text FROM v)"""


@query(f"WITH {_OVERLAPPING} SELECT doc_id, chunk_index, text, CAST({_tokens('text')} AS INT) AS token_count, {_CHUNK_ID} FROM o")
def chunks_overlapping(spark, sf_dir):
    return chunking.fixed(documents(spark, sf_dir), 256, 50, 25)


@query(f"""
WITH {_fixed(256, 0)},
w AS (SELECT doc_id, chunk_index, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS a FROM k),
p AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS b FROM w),
s AS (SELECT doc_id, len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE * 100 AS share FROM p WHERE b IS NOT NULL),
o AS (SELECT doc_id, count(share) AS pairs, round(avg(share), 4) AS mean_share, round(min(share), 4) AS least_share, round(max(share), 4) AS most_share FROM s GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens, round(avg(token_count), 4) AS mean_tokens, min(token_count) AS least_tokens, max(token_count) AS most_tokens, CAST(sum(length(text)) AS BIGINT) AS chars FROM k GROUP BY doc_id)
SELECT * FROM c LEFT JOIN o USING (doc_id)
""")
def chunk_statistics(spark, sf_dir):
    return chunking.all_statistics(chunking.fixed(documents(spark, sf_dir), 256, 0))


@query(f"WITH {_fixed(256, 50)} SELECT doc_id, count(*) AS n_chunks, min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AND count(DISTINCT chunk_index) = count(*) AS contiguous, count(*) FILTER (trim(text) = '') AS blank, count(*) FILTER (token_count = 0) AS without_tokens FROM k GROUP BY doc_id")
def chunks_validated(spark, sf_dir):
    return chunking.validated(chunking.fixed(documents(spark, sf_dir), 256, 50))


@query(f"""
WITH {_fixed(128, 0)}, u AS (SELECT doc_id, chunk_index AS ord, text AS p, token_count AS n, 0 AS key FROM k),{_grouped("u", 512, "g")},
m AS (SELECT doc_id, c AS chunk_index, {_CLEAN_CHUNK} AS text FROM g) SELECT *, CAST({_tokens('text')} AS INT) AS token_count FROM m
""")
def chunks_merged(spark, sf_dir):
    return chunking.merged(chunking.fixed(documents(spark, sf_dir), 128, 0), 512)


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, len(w), 384)) AS b FROM w),
c AS (SELECT doc_id, CAST(b // 384 AS INT) AS chunk_index, array_to_string(list_slice(w, b + 1, b + 384), ' ') AS text FROM i),
m AS (SELECT doc_id, chunk_index, {_CLEAN_CHUNK} AS text FROM c) SELECT *, CAST({_tokens('text')} AS INT) AS token_count FROM m
""")
def chunks_without_boundaries(spark, sf_dir):
    return chunking.without_boundaries(documents(spark, sf_dir), 512)


_SECTIONED = f"""
l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
h AS (SELECT *, (regexp_matches(trim(x), '^[a-z]\\)\\s+[A-Z]') OR regexp_matches(trim(x), '^●.*:') OR regexp_matches(trim(x), '^\\d+\\.\\s+[A-Z\\s&]+:')) AND i > 1 AS b FROM l),
g AS (SELECT *, CAST(sum(b::INT) OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS section FROM h),
y AS (SELECT doc_id, section, arg_min(x, i) AS head, string_agg(x, chr(10) ORDER BY i) AS text FROM g GROUP BY ALL),
z AS (SELECT *, {_tokens('text')} <= 768 AS whole, contains(text, '❖') AS items,
  CASE WHEN regexp_matches(trim(head), '^[a-z]\\)\\s+[A-Z]') OR regexp_matches(trim(head), '^●.*:') OR regexp_matches(trim(head), '^\\d+\\.\\s+[A-Z\\s&]+:') THEN trim(head) END AS title FROM y),
f AS (SELECT doc_id * 100000 + section AS sid, text FROM z WHERE NOT whole AND NOT items),{_packed('f', 512, 'k0', 'sid')},
e AS (SELECT doc_id * 100000 + section AS sid, unnest(ps) AS p, generate_subscripts(ps, 1) AS ord FROM (SELECT *, list_filter(string_split(replace(text, '❖', chr(1) || '❖'), chr(1)), lambda p: trim(p) <> '') AS ps FROM z WHERE NOT whole AND items)),
e2 AS (SELECT *, {_tokens('p')} AS n, 0 AS key FROM e),{_grouped('e2', 512, 'e3', 'sid')},
r AS (SELECT doc_id, section, title, 0 AS part, text FROM z WHERE whole UNION ALL SELECT doc_id, section, title, c, k0.text FROM k0 JOIN z ON sid = doc_id * 100000 + section UNION ALL SELECT doc_id, section, title, c, e3.text FROM e3 JOIN z ON sid = doc_id * 100000 + section),
m AS (SELECT doc_id, section, title, CAST(part AS INT) AS part, {_CLEAN_CHUNK} AS text FROM r),
n AS (SELECT *, CAST({_tokens('text')} AS INT) AS token_count FROM m)"""


@query(f"""
WITH {_SECTIONED}
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS INT) AS chunk_index FROM n WHERE token_count >= 50
""")
def chunks_by_section(spark, sf_dir):
    return chunking.by_section(documents(spark, sf_dir), 512, 50)


# Sentences stand with given vectors, those of the table in turns; every ninth document lacks one and falls back on sizes.
_SEMANTIC = f"""
t AS MATERIALIZED (SELECT doc_id, {_sentences_of("text")} AS ss FROM documents),
s0 AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS pos FROM t), nv AS (SELECT count(*) AS n FROM embeddings),
sv AS MATERIALIZED (SELECT s0.*, e.embedding::DOUBLE[] AS v FROM s0 CROSS JOIN nv LEFT JOIN embeddings e ON e.vec_id = (s0.doc_id * 31 + pos * 7) % nv.n AND NOT (s0.doc_id % 9 = 0 AND pos = 1)),
sm AS (SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY pos) AS w, bool_or(v IS NULL) OVER (PARTITION BY doc_id) AS fell_back FROM sv),
sc AS (SELECT *, CASE WHEN w IS NOT NULL AND v IS NOT NULL THEN list_inner_product(v, w) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(w, w))) END AS similarity FROM sm),
sl AS (SELECT *, quantile_cont(similarity, 1 - 0.8::DOUBLE) OVER (PARTITION BY doc_id) AS cut FROM sc),
sg AS MATERIALIZED (SELECT doc_id, pos, s, fell_back, CASE WHEN fell_back THEN 0 ELSE CAST(coalesce(sum((coalesce(similarity < cut, false))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) END AS segment FROM sl),
sw AS (SELECT doc_id, segment, string_agg(s, ' ' ORDER BY pos) AS text FROM sg WHERE NOT fell_back GROUP BY ALL),
big AS (SELECT doc_id, segment FROM sw WHERE {_tokens("text")} > 768),
su AS (SELECT doc_id * 100000 + segment AS sid, pos AS ord, s AS p, {_tokens("s")} AS n, 0 AS key FROM sg JOIN big USING (doc_id, segment)),{_grouped("su", 512, "sp", "sid")},
fd AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM sg WHERE fell_back)),{_packed("fd", 512, "fp")},
sr AS (SELECT doc_id, false AS fell_back, segment, 0 AS part, text FROM sw WHERE {_tokens("text")} <= 768 UNION ALL SELECT sid // 100000, false, CAST(sid % 100000 AS INT), c, text FROM sp UNION ALL SELECT doc_id, true, 0, c, text FROM fp),
sk AS (SELECT doc_id, fell_back, segment, CAST(part AS INT) AS part, {_CLEAN_CHUNK} AS text FROM sr),
st AS (SELECT *, CAST({_tokens("text")} AS INT) AS token_count FROM sk)"""


@query(f"""
WITH {_SEMANTIC}
SELECT doc_id, segment, fell_back, part, text, token_count, CASE WHEN fell_back THEN part ELSE CAST(row_number() OVER (PARTITION BY doc_id ORDER BY segment, part) - 1 AS INT) END AS chunk_index FROM st WHERE token_count >= 50
""")
def chunks_semantic(spark, sf_dir):
    return chunking.semantic(documents(spark, sf_dir), None, 512, 0.80, 50, _sentence_vectors(spark, sf_dir))


def _sentence_vectors(spark, sf_dir) -> DataFrame:
    d, e = documents(spark, sf_dir), t(spark, sf_dir, "embeddings")
    n = e.count()
    places = d.select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "s")).select("doc_id", "pos", ((F.col("doc_id") * 31 + F.col("pos") * 7) % n).alias("vec_id"))
    return places.where(~((F.col("doc_id") % 9 == 0) & (F.col("pos") == 1))).join(e.select("vec_id", "embedding"), "vec_id")


def _family(parent: int, child: int, least: int) -> str:
    return f"""{_packed("documents", parent, "p0")}, p1 AS (SELECT doc_id * 10000 + c AS pid, doc_id, c AS parent_index, text FROM p0), f AS (SELECT pid, text FROM p1),{_packed("f", child, "c0", "pid")},
c1 AS (SELECT p1.doc_id, p1.parent_index, c0.c AS part, c0.text AS text, p1.text AS body FROM c0 JOIN p1 USING (pid)),
c2 AS (SELECT doc_id, parent_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY parent_index, part) - 1 AS INT) AS chunk_index, {_CLEAN_CHUNK} AS text, {_CLEAN_CHUNK.replace("text", "body")} AS body FROM c1),
h AS (SELECT doc_id, 'child' AS kind, parent_index, chunk_index, text, CAST({_tokens("text")} AS INT) AS token_count, sha256(body) AS parent_text FROM c2 WHERE {_tokens("text")} >= {least})"""


_FAMILY = _family(1024, 256, 50)


@query(f"WITH {_FAMILY} SELECT * FROM h")
def chunks_hierarchical(spark, sf_dir):
    return chunking.with_parents(documents(spark, sf_dir), 1024, 256, 50).withColumn("parent_text", F.sha2("parent_text", 256))


@query(f"WITH {_FAMILY} SELECT doc_id, parent_index, array_to_string(list(chunk_index ORDER BY chunk_index), ',') AS children, CAST(count(*) AS INT) AS n_children FROM h GROUP BY ALL")
def chunk_families(spark, sf_dir):
    return chunking.family(chunking.hierarchical(documents(spark, sf_dir), 1024, 256, 50)).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


_OF_SIZE = f"(SELECT *, {_tokens('text')} AS n FROM documents)"
_HEADED = r"""len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^[a-z]\)\s+[A-Z]') OR regexp_matches(trim(x), '^●.*:') OR regexp_matches(trim(x), '^\d+\.\s+[A-Z\s&]+:')
  OR upper(trim(x)) = trim(x) AND lower(trim(x)) <> trim(x) AND length(trim(x)) > 15 AND NOT starts_with(trim(x), '●'))) > 0"""


def _routed(which: str, made: str, chosen: str) -> str:
    return f"SELECT * FROM (WITH documents AS (SELECT doc_id, text FROM {_OF_SIZE} WHERE {which}), {made} {chosen})"


@query(" UNION ALL ".join([
    _routed("n <= 1000", _fixed(512, 100), "SELECT doc_id, chunk_index, text, token_count, 'fixed' AS strategy FROM k"),
    _routed(f"n > 1000 AND n <= 4000 AND {_HEADED}", _SECTIONED, "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS INT), text, token_count, 'section' FROM n WHERE token_count >= 100"),
    _routed(f"n > 1000 AND n <= 4000 AND NOT {_HEADED}", _SEMANTIC, "SELECT doc_id, CASE WHEN fell_back THEN part ELSE CAST(row_number() OVER (PARTITION BY doc_id ORDER BY segment, part) - 1 AS INT) END, text, token_count, 'semantic' FROM st WHERE token_count >= 100"),
    _routed("n > 4000", _family(2048, 512, 100), "SELECT doc_id, chunk_index, text, token_count, 'hierarchical' FROM h"),
]))
def chunks_adaptive(spark, sf_dir):
    return chunking.adaptive(documents(spark, sf_dir), None, 1000, 4000, vectors=_sentence_vectors(spark, sf_dir))


@query(f"""
WITH k AS (SELECT {_tokens('text')} AS n FROM documents)
SELECT CASE WHEN n <= 1000 THEN 'fixed' WHEN n <= 500000 THEN 'semantic' ELSE 'hierarchical' END AS strategy, count(*) AS documents, CAST(sum(greatest(1, n // 512)) AS BIGINT) AS chunks
FROM k GROUP BY 1
""")
def chunking_strategies(spark, sf_dir):
    return analytics.strategy_counts(chunking.strategy(documents(spark, sf_dir)))


@query(fr"""
WITH c AS (SELECT doc_id, text, {_tokens('text')} AS n,
    (len(regexp_extract_all(text, '(?m)^[a-z]\)\s+[A-Z]')) > 2)::INT + (len(regexp_extract_all(text, '[●❖]')) > 5)::INT + (len(regexp_extract_all(text, '(?m)^\d+\.\s+[A-Z]')) > 2)::INT + (len(regexp_extract_all(text, '(?m)^●\s+\w+.*:')) > 3)::INT
    + (len(list_filter(string_split(text, chr(10)), lambda l: l LIKE '   %' OR l LIKE chr(9) || '%')) > len(string_split(text, chr(10))) * 0.2)::INT >= 2 AS has_structure FROM documents),
p AS (SELECT *, CASE WHEN n <= 1000 THEN 'fixed' WHEN n <= 500000 THEN 'semantic' ELSE 'hierarchical' END AS picked FROM c),
k AS (SELECT * FROM (VALUES ('fixed', 512, 'Small documents, homogeneous content'), ('semantic', 1024, 'Medium documents, structured content'), ('hierarchical', 512, 'Large documents, complex structure')) AS t(chunker, per, recommended_for))
SELECT doc_id, chunker, recommended_for, CAST(greatest(1, n // per) AS INT) AS chunks, picked = chunker AS selected, has_structure FROM p, k
""")
def chunker_recommendations(spark, sf_dir):
    return chunking.recommendations(documents(spark, sf_dir))


@query("""
WITH e AS (SELECT label AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT doc_id, pos, v, lead(v) OVER (PARTITION BY doc_id ORDER BY pos) AS w FROM e),
c AS (SELECT doc_id, pos, CASE WHEN w IS NULL THEN NULL ELSE list_inner_product(v, w) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(w, w))) END AS similarity FROM s),
l AS (SELECT *, quantile_cont(similarity, 0.2) OVER (PARTITION BY doc_id) AS cut FROM c)
SELECT doc_id, CAST(pos AS INT) AS pos, round(similarity, 6) AS similarity,
  CAST(coalesce(sum((coalesce(similarity < cut, false))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS segment
FROM l
""")
def semantic_breaks(spark, sf_dir):
    from pyspark.sql.window import Window

    e = t(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("pos"), "embedding")
    return chunking.breakpoints(e).select("doc_id", "pos", F.round("similarity", 6).alias("similarity"), "segment")


# --- retrieval -----------------------------------------------------------------------------------

_TERMS = r"list_filter(list_transform(regexp_split_to_array(lower({x}), '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda w: length(w) BETWEEN 2 AND 50)"
_ASKED = "SELECT doc_id AS query_id, string_split(text, chr(10))[1] AS text FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT -1 - item_id, text FROM benchmark WHERE item_id % 50 = 0"
_BM25 = f"""
d AS (SELECT doc_id, {_TERMS.format(x="text")} AS terms FROM documents),
n AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM d),
p AS (SELECT doc_id, len(terms) AS length, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM p GROUP BY term),
r AS MATERIALIZED (SELECT *, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM f, n),
e AS MATERIALIZED (SELECT avg(raw) AS mean_raw FROM r),
i AS (SELECT term, df, total_tf, CASE WHEN raw < 0 THEN mean_raw * 0.25::DOUBLE ELSE raw END AS idf FROM r, e),
asked AS ({_ASKED}),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TERMS.format(x="text")}) AS term FROM asked) GROUP BY ALL),
h AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score FROM p JOIN i USING (term) JOIN q USING (term), n GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h WHERE score > 0)"""


@query(f"""
WITH t AS MATERIALIZED (SELECT doc_id, {_TERMS.format(x="text")} AS terms FROM documents), o AS (SELECT doc_id, unnest(terms) AS term FROM t), p AS (SELECT doc_id, term, count(*) AS tf FROM o GROUP BY ALL),
f AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM p GROUP BY term), n AS MATERIALIZED (SELECT count(*) AS n FROM documents),
r AS MATERIALIZED (SELECT term, df, total_tf, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM f, n), e AS MATERIALIZED (SELECT avg(raw) AS mean_raw FROM r)
SELECT term, df, CAST(total_tf AS BIGINT) AS total_tf, round(CASE WHEN raw < 0 THEN mean_raw * 0.25::DOUBLE ELSE raw END, 6) AS idf FROM r, e
""")
def bm25_terms(spark, sf_dir):
    """Terms of an index that grew in two steps, with documents that were deleted again: counts are sums over its segments."""
    return _grown(spark, sf_dir).terms().withColumn("idf", F.round("idf", 6))


def _grown(spark, sf_dir) -> index.KeywordIndex:
    d, kept = documents(spark, sf_dir), index.KeywordIndex(spark, new_path(spark))
    again = d.where("doc_id % 3 = 0").withColumn("doc_id", -2 - F.col("doc_id"))  # to go again
    kept.add(d.where("doc_id % 2 = 0").select("doc_id", "text"))
    kept.add(d.where("doc_id % 2 <> 0").select("doc_id", "text").unionByName(again.select("doc_id", "text")))
    kept.delete(again.select("doc_id"))
    return kept


def _asked(spark, sf_dir) -> DataFrame:
    """First lines of documents, and benchmark items, whose numbers are below zero here."""
    items = t(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select((-1 - F.col("item_id")).alias("query_id"), "text")
    return documents(spark, sf_dir).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.split("text", "\n")[0].alias("text")).unionByName(items)


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM b WHERE rank <= 10")
def retrieval_keywords(spark, sf_dir):
    return retrieval.bm25(documents(spark, sf_dir), _asked(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return e, e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


_NEAREST = """
a AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT q.vec_id AS query_id, a.vec_id AS doc_id, a.label, list_sum(list_transform(list_zip(q.v, a.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM a, a AS q WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), doc_id) AS rank, CASE WHEN distance <= 0 THEN 1.0 ELSE 1 / (1 + distance) END AS score FROM x)"""


@query(f"WITH {_NEAREST} SELECT query_id, doc_id, round(distance, 6) AS distance, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10")
def retrieval_vectors(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    found = retrieval.nearest(e, q, 10)
    return found.select("query_id", "doc_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {_NEAREST}, z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS m FROM k WHERE rank <= 20 AND label < 5)
SELECT query_id, doc_id, CAST(rank AS INT) AS rank FROM z WHERE m <= 10
""")
def retrieval_vectors_filtered(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    hits = retrieval.nearest(e, q, 20).join(e.select("doc_id", "label"), "doc_id")
    return retrieval.filtered(hits, F.col("label") < 5, 10).select("query_id", "doc_id", "rank")


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AS valid, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def embedding_checks(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return e.select("vec_id", checks.valid_vector("embedding", 64).alias("valid"), F.round(F.sqrt(vectors.dot("embedding", "embedding")), 6).alias("norm"))


_RRF = f"""
{_BM25}, {_NEAREST},
u AS (SELECT query_id, doc_id, 0.4::DOUBLE / (60 + rank) AS part FROM b WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 0.6::DOUBLE / (60 + rank) FROM k WHERE rank <= 20),
s AS (SELECT query_id, doc_id, sum(part) AS total FROM u GROUP BY ALL),
m AS (SELECT query_id, doc_id, total / max(total) OVER (PARTITION BY query_id) AS score FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM m)"""


def _lists(spark, sf_dir, k: int) -> list[tuple[DataFrame, float]]:
    e, q = _vectors(spark, sf_dir)
    return [(retrieval.nearest(e, q, k), 0.6), (retrieval.bm25(documents(spark, sf_dir), _asked(spark, sf_dir), k), 0.4)]


@query(f"WITH {_RRF} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM g WHERE rank <= 10")
def retrieval_hybrid(spark, sf_dir):
    return retrieval.fused(_lists(spark, sf_dir, 20), 10).withColumn("score", F.round("score", 6))


@query(f"""
WITH {_BM25}, c AS (SELECT query_id, doc_id, score, max(score) OVER (PARTITION BY query_id) AS hi, min(score) OVER (PARTITION BY query_id) AS lo FROM b WHERE rank <= 20)
SELECT query_id, doc_id, round(CASE WHEN hi - lo < 1e-6 THEN 0.5 ELSE (score - lo) / (hi - lo) END, 6) AS score FROM c
""")
def scores_normalised(spark, sf_dir):
    hits = retrieval.bm25(documents(spark, sf_dir), _asked(spark, sf_dir), 20)
    return retrieval.normalised(hits).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_DISTINCT = "list_distinct({x})"
_SHARE = "CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len({a})::DOUBLE END"


@query(f"""
WITH {_BM25}, c AS (SELECT b.query_id, doc_id, rank, {_DISTINCT.format(x=_TERMS.format(x="asked.text"))} AS qt, {_TERMS.format(x="documents.text")} AS dt FROM b JOIN documents USING (doc_id) JOIN asked ON asked.query_id = b.query_id WHERE rank <= 20),
s AS (SELECT *, {_SHARE.format(a="qt", b="dt")} AS raw FROM c),
m AS (SELECT *, max(raw) OVER w AS hi, min(raw) OVER w AS lo FROM s WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT query_id, doc_id, rank, CASE WHEN hi - lo < 1e-6 THEN 0.5 ELSE (raw - lo) / (hi - lo) END AS score FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS n FROM z)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(n AS INT) AS rank FROM g WHERE n <= 10
""")
def retrieval_reranked(spark, sf_dir):
    d, q = documents(spark, sf_dir), _asked(spark, sf_dir)
    hits = retrieval.bm25(d, q, 20).join(d.select("doc_id", "text"), "doc_id").join(q.withColumnRenamed("text", "query"), "query_id")
    return retrieval.reranked(hits, retrieval.overlap_scorer("query", "text"), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {_BM25}, c AS (SELECT query_id, doc_id, source, score / max(score) OVER (PARTITION BY query_id) AS score, count(*) OVER (PARTITION BY query_id) AS n, count(*) OVER (PARTITION BY query_id, source) AS k FROM b JOIN documents USING (doc_id) WHERE rank <= 20),
z AS (SELECT query_id, doc_id, CASE WHEN n = 1 THEN score ELSE score - 0.1::DOUBLE * (k - 1) END AS score FROM c)
SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM z WHERE score > 0
""")
def retrieval_diverse(spark, sf_dir):
    from pyspark.sql.window import Window

    d = documents(spark, sf_dir)
    hits = retrieval.bm25(d, _asked(spark, sf_dir), 20).join(d.select("doc_id", F.col("source").alias("source_id")), "doc_id")
    hits = hits.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    return retrieval.diverse(hits).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _chunks(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    hits = retrieval.bm25(d, _asked(spark, sf_dir), 20)
    made = hits.join(d, "doc_id").withColumn("tokens", tokens.context_tokens("text"))
    return made.select("query_id", F.col("doc_id").alias("chunk_id"), "text", "score", "rank", "tokens", F.col("source").alias("source_id"), F.lit(None).cast("int").alias("page_number"), F.col("lang").alias("section_title"))


_SELECTED = f"""
{_BM25}, c AS (SELECT query_id, doc_id, text, source, lang, score, rank, {_words('text')} AS w FROM b JOIN documents USING (doc_id) WHERE rank <= 20),
y AS (SELECT *, greatest(10, CAST(floor(floor(floor(w * 1.8::DOUBLE) * 1.15::DOUBLE) * 1.10::DOUBLE) AS INT)) AS tokens FROM c),
z AS (SELECT *, sum(tokens + 25) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM y)"""


@query(f"WITH {_SELECTED} SELECT query_id, doc_id AS chunk_id, CAST(rank AS INT) AS rank, tokens FROM z WHERE used <= 7992")
def context_selected(spark, sf_dir):
    return context.within_budget(_chunks(spark, sf_dir), 8192).select("query_id", "chunk_id", "rank", "tokens")


@query(f"""
WITH {_SELECTED},
w2 AS (SELECT query_id, doc_id::VARCHAR AS chunk_id, CAST(rank AS INT) AS rank, tokens, false AS partial FROM z WHERE used <= 1848),
cut_at AS (SELECT *, 1848 - (used - tokens - 25) - 25 AS left_over FROM z WHERE used > 1848 AND used - tokens - 25 <= 1848 AND 1848 - (used - tokens - 25) - 25 >= 200),
pieces AS (SELECT query_id, doc_id, rank, left_over, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM (SELECT *, string_split(text, '. ') AS ss FROM cut_at)),
summed AS (SELECT *, sum(greatest(10, CAST(floor(floor(floor({_words('s')} * 1.8::DOUBLE) * 1.15::DOUBLE) * 1.10::DOUBLE) AS INT))) OVER (PARTITION BY query_id, doc_id ORDER BY i) AS so_far FROM pieces),
kept AS (SELECT query_id, doc_id, rank, string_agg(s, '. ' ORDER BY i) AS text FROM summed WHERE so_far <= left_over GROUP BY ALL)
SELECT * FROM w2 UNION ALL SELECT query_id, doc_id::VARCHAR || '_partial', CAST(rank AS INT), greatest(10, CAST(floor(floor(floor({_words('text')} * 1.8::DOUBLE) * 1.15::DOUBLE) * 1.10::DOUBLE) AS INT)), true FROM kept WHERE text <> ''
""")
def context_partial(spark, sf_dir):
    return context.within_budget(_chunks(spark, sf_dir), 2048, tokens.context_tokens).select("query_id", "chunk_id", "rank", "tokens", "partial")


@query(f"""
WITH {_SELECTED}
SELECT query_id, sha256(string_agg('[' || (rank::INT)::VARCHAR || '] (Section: ' || lang || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context FROM z WHERE used <= 7992 GROUP BY query_id
""")
def context_text(spark, sf_dir):
    return context.assembled(context.within_budget(_chunks(spark, sf_dir), 8192)).select("query_id", F.sha2("context", 256).alias("context"))


@query(f"""
WITH {_SELECTED}
SELECT query_id, count(*) AS n_chunks, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT source) AS n_sources, round(sum(tokens) / 8192.0::DOUBLE * 100, 4) AS utilisation
FROM z WHERE used <= 7992 GROUP BY query_id
""")
def context_statistics(spark, sf_dir):
    return context.statistics(context.within_budget(_chunks(spark, sf_dir), 8192), 8192)


# --- answers -------------------------------------------------------------------------------------


def _answers(spark, sf_dir) -> DataFrame:
    """Turns of conversations as answers that cite their own and neighbouring turns."""
    c = t(spark, sf_dir, "conversations")
    cite = lambda x: F.concat(F.lit(" ["), x.cast("string"), F.lit("]"))
    answer = F.concat(F.col("text"), cite(F.col("turn") + 2), cite(F.col("turn") + 1), cite(F.col("turn") + 2), F.lit(" [99]"))
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), answer.alias("answer"), F.lit(3).alias("n_sources"))


_ANSWERS = "a AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS answer_id, text || ' [' || (turn + 2)::VARCHAR || '] [' || (turn + 1)::VARCHAR || '] [' || (turn + 2)::VARCHAR || '] [99]' AS answer FROM conversations), c AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: TRY_CAST(x AS INT)))) AS cited FROM a)"


@query(f"""
WITH {_ANSWERS}
SELECT answer_id, CAST(len(cited) AS INT) AS cited, CAST(len(regexp_extract_all(answer, '\\[\\d+\\]')) AS INT) AS mentions, len(list_filter(cited, lambda n: n < 1 OR n > 3)) = 0 AS valid,
  round(len(cited) / greatest(1, {_words('answer')})::DOUBLE, 6) AS density
FROM c
""")
def citation_statistics(spark, sf_dir):
    return citations.statistics(_answers(spark, sf_dir))


@query(f"WITH {_ANSWERS} SELECT number, count(*) AS answers FROM (SELECT unnest(cited) AS number FROM c) GROUP BY number")
def citation_usage(spark, sf_dir):
    return citations.usage(_answers(spark, sf_dir))


@query(f"""
WITH {_ANSWERS}, g AS (SELECT *, list_filter(cited, lambda n: n BETWEEN 1 AND 3) AS good FROM c),
s AS (SELECT answer_id, CASE WHEN len(good) < 1 THEN answer ELSE replace(answer, '[' || good[1] || ']', '[1]') END AS answer, good FROM g),
s2 AS (SELECT answer_id, CASE WHEN len(good) < 2 THEN answer ELSE replace(answer, '[' || good[2] || ']', '[2]') END AS answer, good FROM s)
SELECT answer_id, regexp_replace(CASE WHEN len(good) < 3 THEN answer ELSE replace(answer, '[' || good[3] || ']', '[3]') END, '\\[(\\d+)\\]', '(\\1)', 'g') AS answer FROM s2
""")
def citations_renumbered(spark, sf_dir):
    return _answers(spark, sf_dir).select("answer_id", citations.styled(citations.renumbered(F.col("answer"), F.col("n_sources")), "academic").alias("answer"))


_KINDS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(q, '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in generation.PROMPT_WORDS.items()) + " ELSE 'qa' END"


@query(f"""
WITH c AS (SELECT conv_id, turn, lower(text) AS q, {_words('text')} AS n FROM conversations)
SELECT conv_id, turn, {_KINDS} AS kind,
  CASE WHEN q = '' THEN 0.5 WHEN contains(q, 'compare') OR contains(q, 'contrast') OR contains(q, 'difference') THEN 0.8 WHEN (contains(q, 'why') OR contains(q, 'how') OR contains(q, 'explain')) AND n > 15 THEN 0.7 WHEN n > 20 THEN 0.6 ELSE 0.3 END::DOUBLE AS complexity
FROM c
""")
def query_kinds(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", generation.prompt_type(F.col("text")).alias("kind"), generation.complexity(F.col("text")).alias("complexity"))


_CONTEXT = f"""{_SELECTED},
held AS (SELECT query_id, string_agg('[' || (rank::INT)::VARCHAR || '] (Section: ' || lang || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM z WHERE used <= 7992 GROUP BY query_id),
questions AS (SELECT query_id, asked.text AS query, lower(asked.text) AS q, context, {_words('asked.text')} AS qw, {_words('context')} AS cw FROM held JOIN asked USING (query_id)),
kinds AS (SELECT *, {_KINDS} AS kind FROM questions)"""
_SHIFTS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in generation.TEMPERATURE_SHIFT.items()) + " ELSE 0.0 END::DOUBLE"
_FACTUAL = " OR ".join(f"contains(q, '{w}')" for w in generation.FACTUAL)


@query(f"""
WITH {_CONTEXT},
hardness AS (SELECT *, CASE WHEN contains(q, 'compare') OR contains(q, 'contrast') OR contains(q, 'difference') THEN 0.8 WHEN (contains(q, 'why') OR contains(q, 'how') OR contains(q, 'explain')) AND qw > 15 THEN 0.7 WHEN qw > 20 THEN 0.6 ELSE 0.3 END::DOUBLE AS hard,
  len(regexp_extract_all(context, '\\.')) AS stops, least(cw / 500.0::DOUBLE, 1) AS long, least(len(regexp_extract_all(context, '\\[')) / 5.0::DOUBLE, 1) AS cited FROM kinds),
qualities AS (SELECT *, CASE WHEN stops > 0 THEN (long + cited + 1 - least(abs(cw / stops::DOUBLE - 20) / 50.0::DOUBLE, 1)) / 3 ELSE (long + cited) / 2 END AS quality FROM hardness),
shifted AS (SELECT *, round(greatest(0.1, least(0.1::DOUBLE + {_SHIFTS} + CASE WHEN hard > 0.7 THEN 0.1 WHEN hard < 0.3 THEN -0.1 ELSE 0.0 END::DOUBLE + CASE WHEN quality < 0.5 THEN 0.15 ELSE 0.0 END::DOUBLE, 0.8)), 2) AS adaptive FROM qualities)
SELECT query_id, kind, round(quality, 6) AS quality, adaptive, (CASE WHEN kind = 'creative' THEN 0.8 WHEN kind = 'analytical' THEN 0.3 WHEN kind = 'qa' AND ({_FACTUAL}) THEN 0.1 WHEN kind = 'qa' THEN 0.4 WHEN kind = 'summary' THEN 0.2 ELSE 0.1 END)::DOUBLE AS progressive,
  (CASE WHEN adaptive < 0.3 THEN 0.95 WHEN adaptive > 0.7 THEN 0.7 ELSE 0.9 END)::DOUBLE AS top_p FROM shifted
""")
def temperatures(spark, sf_dir):
    made = context.assembled(context.within_budget(_chunks(spark, sf_dir), 8192)).join(_asked(spark, sf_dir), "query_id")
    kind = generation.prompt_type(F.col("text"))
    adaptive = generation.temperature(F.col("text"), F.col("context"), kind)
    return made.select("query_id", kind.alias("kind"), F.round(generation.context_quality(F.col("context")), 6).alias("quality"), adaptive.alias("adaptive"), generation.progressive_temperature(F.col("text"), kind).alias("progressive"), generation.sampling(adaptive)["top_p"].alias("top_p"))


_SYSTEM = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in generation.INSTRUCTIONS.items()) + " END"
_MOST = "CASE kind " + " ".join(f"WHEN '{k}' THEN {int(8192 * v)}" for k, v in generation.CONTEXT_SHARE.items()) + " END"
_PROMPT = "CAST(floor(floor({n} * 1.3::DOUBLE) * 1.05::DOUBLE) AS INT)"


@query(f"""
WITH {_CONTEXT}, systems AS (SELECT *, {_SYSTEM} AS system FROM kinds),
rooms AS (SELECT *, least(7092 - {_PROMPT.format(n=_words('system'))} - {_PROMPT.format(n='qw')}, {_MOST}) AS room FROM systems),
cuts AS (SELECT query_id, kind, system, query, CASE WHEN {_PROMPT.format(n='cw')} <= room THEN context ELSE array_to_string(list_slice(list_filter(regexp_split_to_array(context, '\\s+'), lambda w: w <> ''), 1, greatest(0, CAST(floor(room / 1.365::DOUBLE) AS INT))), ' ') END AS c FROM rooms),
users AS (SELECT query_id, kind, system, 'Context:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || query AS usr FROM cuts),
measured AS (SELECT *, {_PROMPT.format(n=_words('system'))} + {_PROMPT.format(n=_words('usr'))} AS tokens FROM users)
SELECT query_id, kind, system, sha256(usr) AS "user", tokens, tokens + 1000 <= 8192 AS fits FROM measured
""")
def prompts(spark, sf_dir):
    made = context.assembled(context.within_budget(_chunks(spark, sf_dir), 8192)).join(_asked(spark, sf_dir).withColumnRenamed("text", "query"), "query_id")
    return generation.prompts(made).withColumn("user", F.sha2("user", 256))


# --- analytics and store -------------------------------------------------------------------------


@query("""
WITH s AS (SELECT user_id, ts, value, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS pos, max(ts) OVER (PARTITION BY user_id) AS newest FROM events)
SELECT user_id, count(*) AS n, CAST(trunc(round(avg(value), 6)) AS BIGINT) AS mean_ms, CAST(trunc(min(value)) AS BIGINT) AS least_ms, CAST(trunc(max(value)) AS BIGINT) AS most_ms, CAST(trunc(round(quantile_cont(value, 0.5), 6)) AS BIGINT) AS median_ms,
  CASE WHEN count(*) > 10 THEN CAST(trunc(max(value) FILTER (pos = floor(n * 0.95::DOUBLE))) AS BIGINT) ELSE 0 END AS p95_ms, count(*) FILTER (ts > newest - INTERVAL 1 HOUR) AS last_hour
FROM s GROUP BY user_id
""")
def performance(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "ts", F.col("value").alias("duration_ms"), F.col("event_id").alias("id"))
    return analytics.performance(e, "user_id")


@query("""
WITH r AS (SELECT event_type, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT event_type, id FROM r WHERE n <= 100
""")
def recent_timings(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_type", "ts", F.col("event_id").alias("id"))
    return analytics.recent(e, "event_type", 100).select("event_type", "id")


@query("""
SELECT conv_id AS session_id, count(*) AS messages, count(*) FILTER (role = 'user') AS questions, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text,
  round(avg(length(text)), 4) AS mean_chars, round(coalesce(stddev_samp(length(text)), 0), 4) AS sd_chars
FROM conversations GROUP BY conv_id
""")
def sessions(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    return analytics.sessions(c.withColumnRenamed("conv_id", "session_id"))


def _evaluated(spark, sf_dir) -> DataFrame:
    """Each document's second line as the answer to its first one, in front of the whole document."""
    d = documents(spark, sf_dir)
    lines = F.split("text", "\n")
    return d.select(F.col("doc_id").alias("id"), lines[0].alias("query"), F.get(lines, F.lit(1)).alias("answer"), F.col("text").alias("context"), "lang").fillna("", ["answer"])


_EVALUATED = f"""
l AS (SELECT doc_id AS id, lang, string_split(text, chr(10)) AS s, text FROM documents),
w AS (SELECT id, lang, list_distinct({_TERMS.format(x="s[1]")}) AS q, list_distinct({_TERMS.format(x="coalesce(s[2], '')")}) AS a, list_distinct({_TERMS.format(x="text")}) AS c FROM l),
e AS (SELECT id, lang, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, a)) / len(q)::DOUBLE END, 6) AS answer_relevancy, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, c)) / len(a)::DOUBLE END, 6) AS faithfulness,
  round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, c)) / len(q)::DOUBLE END, 6) AS context_relevancy, round(CASE WHEN len(c) = 0 THEN 0 ELSE len(list_intersect(c, a)) / len(c)::DOUBLE END, 6) AS context_utilisation FROM w)"""


@query(f"WITH {_EVALUATED} SELECT id, answer_relevancy, faithfulness, context_relevancy, context_utilisation FROM e")
def evaluations(spark, sf_dir):
    return analytics.lexical_evaluation(_evaluated(spark, sf_dir)).drop("overall")


_METRICS = ("answer_relevancy", "faithfulness", "context_relevancy", "context_utilisation", "overall")


@query(f"""
WITH {_EVALUATED}, o AS (SELECT *, round((0.4::DOUBLE * answer_relevancy + 0.3::DOUBLE * faithfulness + 0.1::DOUBLE * context_relevancy + 0.2::DOUBLE * context_utilisation) / 1.0::DOUBLE, 3) AS overall FROM e)
SELECT lang, count(*) AS n, {", ".join(f"round(avg({m}), 3) AS mean_{m}, round(coalesce(stddev_samp({m}), 0), 3) AS sd_{m}" for m in _METRICS)}, min(overall) AS least, max(overall) AS most FROM o GROUP BY lang
""")
def evaluation_statistics(spark, sf_dir):
    rows = _evaluated(spark, sf_dir)
    return analytics.evaluation_statistics(analytics.lexical_evaluation(rows).join(rows.select("id", "lang"), "id"), "lang")


@query("""
WITH u AS (SELECT doc_id, 0 AS seq, source, n_chars FROM documents UNION ALL SELECT doc_id, 1, 'revised', n_chars + 1 FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS k FROM u)
SELECT doc_id, seq, source, n_chars FROM r WHERE k = 1
""")
def upserted(spark, sf_dir):
    old = t(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("seq"), "source", "n_chars")
    good = t(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    new = old.join(good, "doc_id").select("doc_id", F.lit(1).alias("seq"), F.lit("revised").alias("source"), (F.col("n_chars") + 1).alias("n_chars"))
    return store.upsert(old, new, ["doc_id"], "seq")


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def chunk_lookup(spark, sf_dir):
    return store.with_documents(t(spark, sf_dir, "documents").select("doc_id", "source"), t(spark, sf_dir, "labels"))


@query("SELECT source AS doc_id, arg_min(lang, doc_id) AS metadata, count(*) AS n_chunks FROM documents GROUP BY source")
def document_rows(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), F.col("lang").alias("metadata"))
    return store.document_rows(d)


@query("""
SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY ALL
""")
def timing_windows(spark, sf_dir):
    return timings.windowed(t(spark, sf_dir, "events"))


@query(ORACLES["timing_windows"])
def timing_windows_stream(spark, sf_dir):
    """The same, as a stream over what is there now: state, watermark and checkpoint included."""
    made = timings.windowed(timings.source(spark, f"{sf_dir}/events.parquet"))
    return timings.run_complete(made, new_path(spark), new_path(spark))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def distinct_events_stream(spark, sf_dir):
    made = timings.distinct_events(timings.source(spark, f"{sf_dir}/events.parquet"), ["event_id"], late="1000 days")
    return timings.run_once(made, new_path(spark), new_path(spark)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("SELECT input_type, count(*) AS n, count(*) FILTER (ok) AS succeeded FROM (SELECT 'text' AS input_type, trim(text) <> '' AS ok FROM documents UNION ALL SELECT 'url', true FROM pages) GROUP BY input_type")
def inputs(spark, sf_dir):
    d, p = t(spark, sf_dir, "documents"), t(spark, sf_dir, "pages")
    made = files.inputs(spark, d.select(F.col("doc_id").alias("id"), "text"), p.select(F.col("page_id").alias("id"), "html"))
    return made.groupBy("input_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("succeeded"))


@query(ORACLES["retrieval_keywords"])
def index_search(spark, sf_dir):
    """An index on disk, built in steps and with documents deleted, gives what a search over all documents gives."""
    return _grown(spark, sf_dir).search(_asked(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25} SELECT (SELECT n FROM n) AS documents, round((SELECT mean FROM n), 6) AS mean_length, count(*) AS postings, count(DISTINCT term) AS terms FROM p")
def index_statistics(spark, sf_dir):
    kept = index.KeywordIndex(spark, new_path(spark))
    kept.add(documents(spark, sf_dir))
    return kept.statistics()


@query("""
SELECT a.conv_id AS session_id, a.turn, a.text AS query, b.text AS response, length(b.text) AS chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'
""")
def chat_export(spark, sf_dir):
    return exports.chat_rows(t(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id"))


@query("SELECT conv_id AS session_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 5)")
def sessions_removed(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id").select("session_id", "turn")
    return exports.without_session(c, c.groupBy("session_id").count().where("count > 5"))


@query(r"""
WITH d AS (SELECT doc_id, w, unnest(range(0, len(w), 12)) AS b FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)),
l AS (SELECT doc_id, b // 12 AS line, list_slice(w, b + 1, b + 12) AS ws FROM d),
k AS (SELECT doc_id, line, len(ws) > 6 AND line % 3 = 0 AS gap, array_to_string(ws, ' ') AS plain, array_to_string(ws, ' | ') AS cells FROM l),
x AS (SELECT doc_id, CASE WHEN gap THEN 'table' WHEN regexp_matches(trim(plain), '^([•●▪◦*\-–]|\d+[.):]|[a-z][.):])\s') THEN 'bullet'
  WHEN length(regexp_replace(plain, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(plain, '[^\p{Lu}]', '', 'g')) / length(regexp_replace(plain, '[^\p{L}]', '', 'g'))::DOUBLE > 0.7 THEN 'heading' ELSE 'text' END AS kind FROM k)
SELECT doc_id AS page_id, kind, count(*) AS n_lines FROM x GROUP BY ALL
""")
def page_layout(spark, sf_dir):
    """Words of documents as boxes of a page, 12 a line, with one wide gap in every third line."""
    d = documents(spark, sf_dir).select("doc_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("i", "text"))
    row, col = F.floor(F.col("i") / 12), F.col("i") % 12
    x0 = col * 60.0 + F.when((row % 3 == 0) & (col > 5), 100.0).otherwise(0.0)
    boxes = d.select(F.col("doc_id").alias("page_id"), "text", F.lit(0.9).alias("confidence"), (x0 + 25).alias("cx"), (row * 30.0).alias("cy"), x0.alias("x0"), (x0 + 50).alias("x1"), F.lit(12.0).alias("height"))
    return layout.lines(boxes).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n_lines"))


@query("""
WITH u AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id) + 1 AS total FROM events),
m AS (SELECT user_id, max(done) AS done, max(total) AS total, floor(epoch(max(ts))) - floor(epoch(min(ts))) AS seconds FROM u GROUP BY user_id)
SELECT user_id AS task_id, CAST(done AS INT) AS done, total, round(100.0::DOUBLE * done / total, 4) AS percent, CAST(seconds AS BIGINT) AS seconds, round((total - done) * seconds::DOUBLE / done, 4) AS seconds_left, 'running' AS status FROM m
""")
def task_progress(spark, sf_dir):
    from pyspark.sql.window import Window

    by = Window.partitionBy("user_id")
    e = t(spark, sf_dir, "events")
    u = e.select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.row_number().over(by.orderBy("ts", "event_id")).alias("done"), (F.count(F.lit(1)).over(by) + 1).alias("total"))
    return analytics.task_progress(u)


@query("SELECT source, round(least(0.9, 0.7 + 0.1 * m), 3)::DOUBLE AS relevancy, round(least(0.95, 0.8 + 0.05 * m), 3)::DOUBLE AS faithfulness, round(least(0.85, 0.6 + 0.1 * m), 3)::DOUBLE AS context FROM (SELECT source, avg(n)::DOUBLE AS m FROM (SELECT source, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source)")
def quality_estimates(spark, sf_dir):
    per = documents(spark, sf_dir).groupBy("source", "lang").count().groupBy("source").agg(F.avg("count").alias("m"))
    q = analytics.quality_estimates(F.col("m"))
    return per.select("source", q["relevancy"].alias("relevancy"), q["faithfulness"].alias("faithfulness"), q["context"].alias("context"))


@query("""
WITH v AS (SELECT label, coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: isnan(x))) = 0, false) AS ok FROM embeddings)
SELECT label, count(*) AS n, count(*) FILTER (ok) AS valid, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS share, count(*) FILTER (ok) >= 0.9::DOUBLE * count(*) AS enough FROM v GROUP BY label
""")
def embedding_validity(spark, sf_dir):
    return embedding.validity(t(spark, sf_dir, "embeddings"), 64, "label")


@query("SELECT lang, count(*) AS texts, count(*) FILTER (trim(text) <> '') AS embedded, round(100.0::DOUBLE * count(*) FILTER (trim(text) <> '') / count(*), 4) AS rate FROM documents GROUP BY lang")
def embedding_rate(spark, sf_dir):
    made = embedding.once_per_text(documents(spark, sf_dir), vectors.hashing_embedder())
    return embedding.processing(made, "lang")


# --- exact tokens, files, answers, tasks ---------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS restored, sha256(text) AS joined, true AS head_begins, true AS fits FROM documents")
def tokens_exact(spark, sf_dir):
    """Ids lead back to the text, whole and in windows; a text cut at a token begins the text, and has no more tokens than asked for."""
    head = F.col("b.head")
    d = documents(spark, sf_dir).withColumn("ids", bpe.ids("text")).withColumn("b", bpe.boundary("text", 100))
    whole = F.regexp_replace(head, "\ufffd+$", "")
    return d.select("doc_id", F.sha2(bpe.text_of("ids"), 256).alias("restored"), F.sha2(F.array_join(bpe.windows("text", 100), ""), 256).alias("joined"), F.startswith("text", whole).alias("head_begins"), (bpe.count(whole) <= 100).alias("fits"))


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), w AS (SELECT *, {_words('x')} AS n FROM d), k AS (SELECT *, {_tokens('x', 'n')} AS k FROM w)
SELECT doc_id, CAST(k AS INT) AS tokens, CAST(length(x) AS INT) AS chars, CAST(n AS INT) AS words, CASE WHEN k > 0 THEN round(length(x) / k::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS chars_per_token, CASE WHEN n > 0 THEN round(k / n::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS tokens_per_word FROM k
""")
def token_statistics(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in tokens.token_stats("text").items()])


@query(f"""
WITH m AS (SELECT conv_id, CAST(floor(floor({_words('text')} * 1.3::DOUBLE) * 1.05::DOUBLE) AS INT) + CAST(floor(floor({_words('role')} * 1.3::DOUBLE) * 1.05::DOUBLE) AS INT) + 5 AS n FROM conversations)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS tokens FROM m GROUP BY conv_id
""")
def message_tokens(spark, sf_dir):
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(tokens.message_tokens("text", "role")).alias("tokens"))


@query(r"SELECT page_id, url LIKE '%.pdf' AS pdf, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '’', chr(39)), '‘', chr(39)), '“', chr(34)), '”', chr(34)), '—', '-'), '–', '-'), '…', '...'), 'l ', 'I '), '[\s ]+', ' ', 'g'))) AS folded FROM pages")
def recognised_text(spark, sf_dir):
    p = t(spark, sf_dir, "pages")
    return p.select("page_id", (checks.media_type("url") == "application/pdf").alias("pdf"), F.sha2(text.ocr_folded("html"), 256).alias("folded"))


def _made_files(spark, sf_dir, *kinds: str) -> DataFrame:
    """Documents as files of those of several kinds, made by Spark from the table: plain text in four encodings, word files with a table, archives of two."""

    def run(frames):
        rows = ((f"/{i}.{ext}", f"{i}.{ext}", kind, data) for f in frames for i, body, lang in zip(f.doc_id, f.text, f.lang, strict=True) for ext, kind, data in files.samples(int(i), body or "", lang or "") if kind in kinds)
        return files.in_slices(rows, ["path", "name", "kind", "content"])

    return documents(spark, sf_dir).select("doc_id", "text", "lang").mapInPandas(run, "path string, name string, kind string, content binary")


_MADE = """
f AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, doc_id % 4 AS m FROM documents)"""


_ROMAN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYRILLIC = "абцдефгхийклмнопярстувщжызАБЦДЕФГХИЙКЛМНОПЯРСТУВЩЖЫЗ"


@query(f"""
WITH x AS (SELECT doc_id, doc_id % 6 AS m, CASE WHEN doc_id % 6 < 3 THEN coalesce(text, '') WHEN doc_id % 6 = 3 THEN regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F\\xA0-\\xFF]', '?', 'g')
  ELSE translate(regexp_replace(lower(coalesce(text, '')), '[^\\x00-\\x7F]', '?', 'g'), '{_ROMAN}', '{_CYRILLIC}') END AS text FROM documents)
SELECT doc_id, CASE WHEN m = 1 THEN 'utf-8-sig' WHEN m = 2 THEN 'utf-16' WHEN m = 0 OR regexp_full_match(text, '[\\x00-\\x7F]*') THEN 'utf-8' WHEN m = 3 THEN 'latin-1' WHEN m = 4 THEN 'windows-1251' ELSE 'koi8-r' END AS encoding, sha256(text) AS text FROM x
""")
def files_encoded(spark, sf_dir):
    """Texts in six encodings, two of them Cyrillic ones of one byte a letter, told by their bytes alone. Cyrillic texts
    are in small letters: of capitals alone, the two encodings differ in little but how common the letters are."""
    import pandas as pd

    m, held = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    shown = F.when(m < 3, held).when(m == 3, F.regexp_replace(held, "[^\\x00-\\x7F\\xA0-\\xFF]", "?")).otherwise(F.translate(F.regexp_replace(F.lower(held), "[^\\x00-\\x7F]", "?"), _ROMAN, _CYRILLIC))

    def run(frames):
        for f in frames:
            names = [("utf-8", "utf-8-sig", "utf-16", "latin-1", "windows-1251", "koi8-r")[i % 6] for i in f.doc_id]
            yield pd.DataFrame({"path": f.doc_id.astype(str), "name": f.doc_id.astype(str) + ".txt", "kind": "txt", "content": [x.encode(name) for x, name in zip(f.text, names, strict=True)]})

    found = documents(spark, sf_dir).select("doc_id", shown.alias("text")).mapInPandas(run, "path string, name string, kind string, content binary")
    told = files.properties(found).select(F.col("path").cast("long").alias("doc_id"), "encoding")
    return told.join(files.parsed(found).select(F.col("path").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text")), "doc_id")


@query(f"""
WITH {_MADE}
SELECT '/' || doc_id || '.txt' AS path, CASE m WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' ELSE 'utf-16' END AS encoding, sha256(text) AS text FROM f WHERE m < 3
""")
def files_decoded(spark, sf_dir):
    found = _made_files(spark, sf_dir, "txt")
    return files.properties(found).select("path", "encoding").join(files.documents(files.parsed(found)).select("path", F.sha2("text", 256).alias("text")), "path")


@query(f"""
WITH {_MADE}, l AS (SELECT doc_id, text, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\n\\r') <> '') AS ls FROM f)
SELECT '/' || doc_id || '.docx' AS path, 'Document ' || doc_id AS title, lang AS author, CAST(len(ls) + 1 AS INT) AS paragraphs, 1 AS sections, CAST(greatest(1, (len(ls) + 1) // 50) AS INT) AS pages,
  sha256('[HEADING 1] Text' || chr(10) || array_to_string(list_transform(ls, lambda x: x || chr(10)), '') || '[TABLE 1]' || chr(10) || 'lang | ' || lang || chr(10) || 'id | ' || doc_id) AS text FROM l
""")
def files_word(spark, sf_dir):
    """Word files: properties, paragraphs, headings and tables."""
    found = _made_files(spark, sf_dir, "docx")
    held = files.properties(found).select("path", "title", F.coalesce("author", F.lit("")).alias("author"), "paragraphs", "sections", "pages")
    return held.join(files.documents(files.parsed(found)).select("path", F.sha2("text", 256).alias("text")), "path")


@query(f"""
WITH {_MADE}, z AS (SELECT * FROM f WHERE m = 3)
SELECT '/' || doc_id || '.zip' AS path, 2::BIGINT AS members, CAST(2 * octet_length(encode(text)) AS BIGINT) AS bytes, sha256('[FILE: a.txt]' || chr(10) || text || chr(10) || '[FILE: b.md]' || chr(10) || text) AS text FROM z
""")
def files_archived(spark, sf_dir):
    """Archives: their members by name without unpacking, and their texts."""
    found = _made_files(spark, sf_dir, "archive")
    names = files.listed(found).where("NOT name LIKE '__MACOSX%'").groupBy("path").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"))
    return names.join(files.documents(files.parsed(found)).select("path", F.sha2("text", 256).alias("text")), "path")


@query(f"""
WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS s, text FROM documents), q AS (SELECT id, s[1] AS query, coalesce(s[2], '') AS answer, text AS context FROM l),
w AS (SELECT *, {_words('answer')} AS aw, {_words('context')} AS cw, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '')) AS qs, list_distinct(list_filter(regexp_split_to_array(lower(answer), '\\s+'), lambda x: x <> '')) AS ans FROM q)
SELECT id, CAST(aw AS INT) AS answer_words, CAST(length(answer) AS INT) AS answer_chars, CAST(len(regexp_extract_all(answer, '\\[\\d+\\]')) AS INT) AS citations, round(least(1.0, aw / greatest(1, cw)::DOUBLE), 6)::DOUBLE AS context_use,
  round(len(list_intersect(qs, ans)) / greatest(1, len(qs))::DOUBLE, 6) AS overlap FROM w
""")
def answer_quality(spark, sf_dir):
    return analytics.answer_quality(_evaluated(spark, sf_dir))


@query("""
WITH c AS (SELECT event_type, value, event_id % 7 <> 0 AS ok FROM events)
SELECT event_type, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 4) AS success_rate, round(avg(value), 4) AS mean_ms, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM c GROUP BY event_type
""")
def generation_statistics(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 7 != 0).alias("ok"), F.col("value").alias("duration_ms"), F.floor("value").alias("tokens"))
    return analytics.generation_statistics(e, "event_type")


@query("""
WITH h AS (SELECT source, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS hit FROM documents)
SELECT source, count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 4) AS hit_rate FROM h GROUP BY source
""")
def cache_hits(spark, sf_dir):
    """Documents asked for in order of their ids: a text seen before is a hit."""
    d = documents(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("key"))
    first = d.groupBy("key").agg(F.min("doc_id").alias("first"))
    return analytics.cache_statistics(d.join(first, "key").select("source", (F.col("doc_id") != F.col("first")).alias("hit")), "source")


_TASKS = """
k AS (SELECT user_id, min(ts) AS began, max(ts) AS latest, count(*) AS n FROM events GROUP BY user_id),
s AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'failed' WHEN n % 3 = 0 THEN 'active' ELSE 'completed' END AS status FROM k),
x AS (SELECT *, CASE WHEN status <> 'active' THEN latest END AS ended FROM s)"""


def _tasks(spark, sf_dir) -> DataFrame:
    k = t(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("began"), F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n"))
    s = k.withColumn("status", F.when(F.col("n") % 5 == 0, "failed").when(F.col("n") % 3 == 0, "active").otherwise("completed"))
    return s.select(F.col("user_id").alias("task_id"), "status", F.col("began").cast("timestamp").alias("began"), F.when(F.col("status") != "active", F.col("latest").cast("timestamp")).alias("ended"))


@query(f"""
WITH {_TASKS}
SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS tasks, round(100.0::DOUBLE * count(*) FILTER (status = 'completed') / count(*), 4) AS success_rate,
  round(avg(CASE WHEN status = 'completed' THEN floor(epoch(ended)) - floor(epoch(began)) END), 4) AS mean_seconds FROM x
""")
def task_totals(spark, sf_dir):
    return analytics.task_totals(_tasks(spark, sf_dir))


@query(f"WITH {_TASKS}, m AS (SELECT max(latest) AS now FROM k) SELECT user_id AS task_id, status FROM x, m WHERE ended IS NULL OR ended > now - INTERVAL 24 HOUR")
def tasks_kept(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    now = t(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    return analytics.unfinished_or_recent(tasks.join(F.broadcast(now)), F.col("now")).select("task_id", "status")


@query(f"""
WITH {_fixed(512, 0)}, d AS (SELECT count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents), c AS (SELECT count(*) AS chunks FROM k), m AS (SELECT count(DISTINCT conv_id) AS sessions, count(*) AS messages FROM conversations)
SELECT *, round(chunks / documents::DOUBLE, 2) AS chunks_per_document, round(messages / sessions::DOUBLE, 2) AS messages_per_session FROM d, c, m
""")
def overview(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    chunks = chunking.fixed(documents(spark, sf_dir), 512, 0)
    return analytics.overview(d.select("doc_id", F.col("n_chars").alias("size")), chunks.select("doc_id"), t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")))


_PDF_DATE = "printf('2024%02d%02d%02d0405', 1 + doc_id % 12, 1 + doc_id % 28, doc_id % 24)"


@query(f"""
WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\s\x0B\x1C-\x1F\x85\xA0]')) AS ls FROM documents),
p AS (SELECT *, greatest(1, (len(ls) + 39) // 40) AS n FROM l),
t AS (SELECT *, list_transform(range(1, n + 1), lambda i: array_to_string(list_slice(ls, i * 40 - 39, i * 40), chr(10))) AS pages FROM p)
SELECT '/' || doc_id || '.pdf' AS path, 'Document ' || doc_id AS title, 'Tessera' AS author, strftime(strptime({_PDF_DATE}, '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') AS created, CAST(n AS BIGINT) AS pages,
  list_sum(list_transform(list_slice(pages, 1, 3), lambda x: length(trim(x)))) / least(n, 3) < 100 AS scanned, sha256(array_to_string(list_transform(pages, lambda x, i: '[PAGE ' || i || ']' || chr(10) || x), chr(10))) AS text FROM t
""")
def files_pdf(spark, sf_dir):
    """Documents as PDF files of three builds, read back: properties, dates, pages in order, and whether they look scanned."""
    from . import pdf_samples

    def run(frames):
        rows = ((f"/{i}.pdf", f"{i}.pdf", "pdf", pdf_samples.made(int(i), body or "", f"D:{at}+01'00'")) for f in frames for i, body, at in zip(f.doc_id, f.text, f["at"], strict=True))
        return files.in_slices(rows, ["path", "name", "kind", "content"])

    i = F.col("doc_id")
    at = F.format_string("2024%02d%02d%02d0405", 1 + i % 12, 1 + i % 28, i % 24)
    found = documents(spark, sf_dir).select("doc_id", "text", at.alias("at")).mapInPandas(run, "path string, name string, kind string, content binary")
    held = files.properties(found).select("path", "title", "author", F.date_format(exports.pdf_time("created"), "yyyy-MM-dd HH:mm:ss").alias("created"))
    at = new_path(spark)  # pages are read three times, files are parsed once
    files.parsed(found).write.parquet(at)
    parts = spark.read.parquet(at)
    texts = files.documents(parts).select("path", F.sha2("text", 256).alias("text"))
    return held.join(files.page_counts(parts), "path").join(files.scanned(parts), "path").join(texts, "path")


@query("""
SELECT lang, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(sum(('0x' || substr(md5(line), 1, 8))::BIGINT) AS BIGINT) AS content, true AS described
FROM (SELECT coalesce(lang, 'none') AS lang, replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), ' | ') AS line FROM documents) GROUP BY lang
""")
def files_scanned(spark, sf_dir):
    """A folder of text files, written by Spark from the table and read through the scan of files: kinds by names and first bytes, sizes, hashes, and texts."""
    at = new_path(spark)
    line = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")), "\n", " | ")
    documents(spark, sf_dir).select(F.coalesce("lang", F.lit("none")).alias("lang"), line.alias("line")).write.partitionBy("lang").option("compression", "none").option("maxRecordsPerFile", 1000).text(at)
    found = files.files(spark, at, "*.txt")
    sound = (F.col("kind") == "txt") & (F.col("size") == F.octet_length("content")) & (F.col("sha256") == F.sha2("content", 256)) & F.col("modified").isNotNull() & F.endswith("path", "name")
    told = found.select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), sound.alias("sound")).groupBy("lang").agg(F.bool_and("sound").alias("described"))
    lines = files.parsed(found).select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))
    mark = F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("long")
    return lines.groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"), F.sum(mark).alias("content")).join(told, "lang")


@query("""
SELECT 'batch-' || doc_id // 200 || CASE WHEN doc_id // 200 % 2 = 0 THEN '.zip' ELSE '.tar' END AS archive, doc_id || '.txt' AS member, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS text FROM documents
""")
def files_in_archives(spark, sf_dir):
    """Documents in archives on disk, 200 a file, zip and tar in turns, read back by lots of members; other members stay out."""
    import io
    import tarfile
    import zipfile

    import pandas as pd

    at = new_path(spark)

    def write(f: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        number, out = int(f.doc_id.iloc[0]) // 200, io.BytesIO()
        rows = [(f"{i}.txt", (body or "").encode()) for i, body in zip(f.doc_id, f.text, strict=True)] + [("notes.bin", b"no text"), ("__MACOSX/x.txt", b"")]
        if number % 2 == 0:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, data in rows:
                    z.writestr(name, data)
        else:
            with tarfile.open(fileobj=out, mode="w") as tar:
                for name, data in rows:
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        name = f"batch-{number}.{'tar' if number % 2 else 'zip'}"
        system, inner = fs.FileSystem.from_uri(at if "://" in at else f"file://{at.removeprefix('file:')}")
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/{name}") as to:  # a second attempt writes the same file again
            to.write(out.getvalue())
        return pd.DataFrame({"name": [name]})

    documents(spark, sf_dir).select("doc_id", "text").groupBy(F.floor(F.col("doc_id") / 200)).applyInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    found = archives.members(spark, at, ["*.txt", "*.md"], "batch-*", lot_bytes=200_000)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return archives.texts(found).select(name.alias("archive"), "member", "size", F.sha2("text", 256).alias("text"))


@query(f"""
WITH {_ANSWERS}, s AS (SELECT answer_id, list_filter(cited, lambda n: n BETWEEN 1 AND 3) AS good FROM c)
SELECT answer_id, CASE WHEN len(good) = 0 THEN '' ELSE 'References:' || chr(10) || array_to_string(list_transform(good, lambda n, i: '(' || i || ') file' || n || '.txt'), chr(10)) END AS refs FROM s
""")
def reference_sections(spark, sf_dir):
    sources = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.struct(F.concat(F.lit("file"), n.cast("string"), F.lit(".txt")).alias("file_name")))
    return _answers(spark, sf_dir).select("answer_id", citations.reference_section(sources, citations.extracted(F.col("answer")), "academic").alias("refs"))


@query(f"WITH {_ANSWERS} SELECT answer_id, replace(replace(answer, '[1]', '(first)'), '[2]', '(second)') AS answer FROM a")
def markers_replaced(spark, sf_dir):
    numbers = F.create_map(F.lit(1), F.lit("(first)"), F.lit(2), F.lit("(second)"))
    return _answers(spark, sf_dir).select("answer_id", citations.replaced(F.col("answer"), numbers).alias("answer"))


@query(f"""
WITH {_NEAREST}, p AS (SELECT query_id, doc_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10) SELECT * FROM p
""")
def index_lists(spark, sf_dir):
    """Vectors in lists by their centroids; all lists being read, the exact neighbours come back."""
    e, q = _vectors(spark, sf_dir)
    kept = index.ListIndex(spark, new_path(spark), probes=16)
    kept.build(e.where("doc_id % 2 = 0"), 16)
    kept.add(e.where("doc_id % 2 <> 0"))
    return kept.search(q, 10).select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "rank")


@query("SELECT 'lists' AS kind, count(*) AS vectors FROM embeddings")
def index_notes(spark, sf_dir):
    kept = index.ListIndex(spark, new_path(spark))
    kept.build(t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), 8)
    held = index.notes(spark, kept.path)
    return spark.range(1).select(F.lit(held["kind"]).alias("kind"), F.lit(int(held["vectors"])).cast("long").alias("vectors"))


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id = 7")
def document_found(spark, sf_dir):
    return store.document(t(spark, sf_dir, "documents"), 7).select("doc_id", "source", "lang")


@query(f"""
WITH {_BM25}, k AS (SELECT query_id, count(*) AS n FROM b WHERE rank <= 20 GROUP BY query_id),
s AS (SELECT query_id, asked.text AS q, coalesce(n, 0) AS n FROM asked LEFT JOIN k USING (query_id))
SELECT query_id, CASE WHEN contains(lower(q), 'the') THEN 'general' ELSE 'rag' END AS kind, n FROM s
""")
def questions_routed(spark, sf_dir):
    """Each question as a classifier's reply sorts it, with the hits it would be answered from."""
    q = _asked(spark, sf_dir)
    reply = F.when(F.lower("text").contains("the"), '```json\n{"type": "general", "confidence": 0.9}\n```').otherwise("It needs the documents: rag.")
    hits = retrieval.bm25(documents(spark, sf_dir), q, 20).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return q.withColumn("kind", generation.query_class(reply)["type"]).join(hits, "query_id", "left").select("query_id", "kind", F.coalesce("n", F.lit(0)).alias("n"))


_SHARED = """CAST(coalesce(list_max(list_filter(list_filter(range(1, least(len({a}), len({b})) + 1), lambda k: {a}[len({a}) - k + 1] = {b}[1]), lambda k: list_slice({b}, 1, k) = list_slice({a}, len({a}) - k + 1, len({a})))), 0) AS INT)"""
_LENT_ALL = f"""{_fixed(256, 0)},
v AS (SELECT *, lag(text) OVER w AS pt, lag(token_count) OVER w AS pn, lead(text) OVER w AS nt, lead(token_count) OVER w AS nn FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
o AS (SELECT doc_id, chunk_index, regexp_split_to_array(concat_ws(' ', {_lent("pt", "pn", 25, True)}, text, {_lent("nt", "nn", 25, False)}), '\\s+') AS w FROM v),
n AS (SELECT *, lag(w) OVER b AS before, lead(w) OVER b AS after FROM o WINDOW b AS (PARTITION BY doc_id ORDER BY chunk_index))"""


@query(f"""
WITH {_LENT_ALL}, c AS (SELECT *, coalesce({_SHARED.format(a="before", b="w")}, 0) AS front, coalesce({_SHARED.format(a="w", b="after")}, 0) AS back FROM n)
SELECT doc_id, chunk_index, sha256(array_to_string(list_slice(w, front + 1, len(w)), ' ')) AS without_front, sha256(array_to_string(list_slice(w, 1, len(w) - back), ' ')) AS without_back FROM c
""")
def overlaps_removed(spark, sf_dir):
    lent = chunking.with_overlap(chunking.fixed(documents(spark, sf_dir), 256, 0), 25).drop("chunk_id")
    return chunking.without_either(lent).withColumns({c: F.sha2(c, 256) for c in ("without_front", "without_back")})


@query(f"""
WITH {_fixed(256, 0)}, w AS (SELECT *, regexp_split_to_array(text, '\\s+') AS w FROM k), n AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS after FROM w),
s AS (SELECT *, coalesce({_SHARED.format(a="w", b="after")}, 0) AS shared FROM n),
h AS (SELECT *, array_to_string(list_slice(w, greatest(1, len(w) - shared + 1), len(w) - shared + shared), ' ') AS common FROM s),
m AS (SELECT *, CASE WHEN shared = 0 THEN 0 ELSE {_tokens("common")} END AS have FROM h),
r AS (SELECT doc_id, chunk_index, CASE WHEN after IS NULL OR abs(have - 30) <= 10 THEN text WHEN have < 30 THEN concat_ws(' ', text, array_to_string(list_slice(after, shared + 1, shared + CAST(floor((30 - have) / 1.33::DOUBLE) AS INT)), ' '))
  ELSE array_to_string(list_slice(w, 1, greatest(1, len(w) - CAST(floor((have - 30) / 1.33::DOUBLE) AS INT))), ' ') END AS text FROM m)
SELECT doc_id, chunk_index, sha256(text) AS adjusted, CAST({_tokens("text")} AS INT) AS token_count FROM r
""")
def overlaps_adjusted(spark, sf_dir):
    made = chunking.overlap_adjusted(chunking.fixed(documents(spark, sf_dir), 256, 0), 30)
    return made.select("doc_id", "chunk_index", F.sha2("text", 256).alias("adjusted"), "token_count")


@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
SELECT doc_id, CAST(i AS INT) AS chunk_index, CASE WHEN i % 5 = 2 THEN CAST(i AS INT) WHEN i < 2 THEN NULL ELSE CAST((i - 2) // 5 * 5 + 3 AS INT) END AS page_number FROM l
""")
def chunk_pages(spark, sf_dir):
    """Lines as chunks, every fifth with two page marks: the first is its own page, the last that of the chunks after it."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    mark = lambda n: F.concat(F.lit("[PAGE "), n.cast("string"), F.lit("] "))
    marked = F.when(F.col("chunk_index") % 5 == 2, F.concat(mark(F.col("chunk_index")), mark(F.col("chunk_index") + 1), "line")).otherwise(F.col("line"))
    return chunking.page_numbers(lines.select("doc_id", "chunk_index", marked.alias("text"))).select("doc_id", "chunk_index", "page_number")


@query(f"""
WITH {_BM25}, k AS (SELECT query_id, count(*) AS n FROM b WHERE rank <= 20 GROUP BY query_id)
SELECT query_id, CASE WHEN length(text) % 4 = 0 THEN 'general' ELSE 'rag' END AS kind, CAST(CASE WHEN length(text) % 4 <> 0 AND n > 0 THEN 2 ELSE 0 END AS INT) AS cited FROM asked LEFT JOIN k USING (query_id)
""")
def responses_made(spark, sf_dir):
    """Questions answered by a stand-in for a model, which cites two sources; those sorted as talk get a stock reply."""
    asked = _asked(spark, sf_dir).withColumnRenamed("text", "query")
    chunks = _chunks(spark, sf_dir).withColumn("text", F.substring("text", 1, 400)).withColumn("tokens", tokens.context_tokens("text"))
    classify = lambda q: F.when(F.length(q) % 4 == 0, '{"type": "general"}').otherwise('{"type": "rag"}')
    return generation.responses(asked, chunks, classify, lambda prompts: ["See [2] and [1]." for _ in prompts]).select("query_id", "kind", "cited")


def _word_judge(prompts: list[str]) -> list[str]:
    """A judge that goes by words: a statement is borne out if half its words are in the context, a context useful if a fifth of the
    question's are; the questions made back are the answer's first lines."""
    import json
    from functools import lru_cache

    # A context comes with each of its statements.
    words = lru_cache(64)(lambda x: set(filter(None, x.replace("\n", " ").split(" "))))
    out = []
    for p in map(json.loads, prompts):
        if p["task"] == "questions":
            out.append(json.dumps({"questions": p["answer"].split("\n")[:3]}))
            continue
        asked = words(p.get("statement", p.get("query", "")))
        share = len(asked & words(p["context"])) / max(1, len(asked))
        out.append(f'```json\n{{"verdict": {int(share >= (0.5 if "statement" in p else 0.2))}}}\n```')
    return out


def _letters(x):
    """A text's counts of letters, as a vector."""
    return F.array(*((F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"))


_LETTERS = "[" + ", ".join("(length({x}) - length(replace({x}, '" + c + "', '')))::DOUBLE" for c in "abcdefghijklmnopqrstuvwxyz") + "]"
_JUDGED_WORDS = "list_distinct(list_filter(string_split(replace({x}, chr(10), ' '), ' '), lambda w: w <> ''))"
_COSINE = "CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 0.0 ELSE list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END"


@query(f"""
WITH l AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
r AS (SELECT id, ls[1] AS query, coalesce(array_to_string(ls[2:4], chr(10)), '') AS answer, ls[4:6] AS contexts, coalesce(ls[3], '') AS truth FROM l),
f AS (SELECT *, CASE WHEN len(contexts) = 0 THEN 'Not a RAG response' WHEN trim(query) = '' OR trim(answer) = '' THEN 'Missing query or answer' END AS reason FROM r),
o AS (SELECT *, array_to_string(contexts, chr(10)) AS context FROM f WHERE reason IS NULL),
s AS (SELECT id, 'answer' AS kind, context, unnest({_sentences_of("answer")}) AS x FROM o UNION ALL SELECT id, 'truth', context, unnest({_sentences_of("truth")}) FROM o),
w AS (SELECT id, kind, {_JUDGED_WORDS.format(x="x")} AS ws, {_JUDGED_WORDS.format(x="context")} AS cs FROM s),
v AS (SELECT id, kind, (len(list_intersect(ws, cs)) / greatest(1, len(ws))::DOUBLE >= 0.5)::INT AS v FROM w),
a AS (SELECT id, avg(v) FILTER (kind = 'answer') AS faithfulness, avg(v) FILTER (kind = 'truth') AS context_recall FROM v GROUP BY id),
c0 AS (SELECT id, query, unnest(contexts) AS part, generate_subscripts(contexts, 1) AS i FROM o),
c1 AS (SELECT id, i, {_JUDGED_WORDS.format(x="query")} AS ws, {_JUDGED_WORDS.format(x="part")} AS cs FROM c0),
c2 AS (SELECT id, i, (len(list_intersect(ws, cs)) / greatest(1, len(ws))::DOUBLE >= 0.2)::INT AS v FROM c1),
c3 AS (SELECT *, sum(v) OVER (PARTITION BY id ORDER BY i) / i::DOUBLE AS at_i FROM c2),
c AS (SELECT id, avg(v) AS context_relevancy, CASE WHEN sum(v) = 0 THEN 0.0 ELSE sum(v * at_i) / sum(v) END AS context_precision FROM c3 GROUP BY id),
q0 AS (SELECT id, query, unnest(string_split(answer, chr(10))[1:3]) AS question FROM o),
q1 AS (SELECT id, {_LETTERS.format(x="query")} AS a, {_LETTERS.format(x="question")} AS b FROM q0),
q AS (SELECT id, greatest(0.0, avg({_COSINE.format(a="a", b="b")})) AS answer_relevancy FROM q1 GROUP BY id)
SELECT f.id, reason IS NULL AS evaluated, reason, round(faithfulness, 6) AS faithfulness, round(context_relevancy, 6) AS context_relevancy, round(context_precision, 6)::DOUBLE AS context_precision, round(context_recall, 6) AS context_recall, round(answer_relevancy, 6) AS answer_relevancy,
  CASE WHEN reason IS NULL THEN round((RELEVANCY * coalesce(answer_relevancy, 0) + FAITHFULNESS * coalesce(faithfulness, 0) + CONTEXT * coalesce(context_relevancy, 0) + EXTRA * context_precision) / (RELEVANCY + FAITHFULNESS + CONTEXT + EXTRA), 3) END AS overall
FROM f LEFT JOIN a USING (id) LEFT JOIN c USING (id) LEFT JOIN q USING (id)
""".replace("RELEVANCY", str(analytics.RELEVANCY)).replace("FAITHFULNESS", str(analytics.FAITHFULNESS)).replace("CONTEXT +", f"{analytics.CONTEXT} +").replace("CONTEXT *", f"{analytics.CONTEXT} *").replace("EXTRA", str(analytics.EXTRA)))
def evaluations_judged(spark, sf_dir):
    """Documents' lines as questions, answers and contexts, scored by a judge that goes by words."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), lines[0].alias("query"), F.array_join(F.slice(lines, 2, 3), "\n").alias("answer"), F.slice(lines, 4, 3).alias("contexts"), F.coalesce(F.get(lines, F.lit(2)), F.lit("")).alias("truth"))
    return judged.evaluate(rows, _word_judge, _letters).drop("asked_again")
