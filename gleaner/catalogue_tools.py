"""The queries of the tools and of page texts, with their DuckDB oracles. ``catalogue`` has all others and the two tables of queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalogue import _B, _CLAIM_SQL, _IDF, _K1, _NEGATION_SQL, _SENTENCES, ASKED, _asked, _flag, _literal, _table, _values, _words, query
from gleaner.functions import html as H
from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.operators import grounding, ranking
from gleaner.plans import tools
from gleaner.sources import corpus as C

_LINE = "chr(10)"
_CUT = 200


# --- chunks


@query(f"""
WITH RECURSIVE c AS (SELECT conv_id, string_agg(text, {_LINE} || {_LINE} ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, t, len({_words('t')}) AS n, list_filter(list_transform(string_split(t, {_LINE} || {_LINE}), lambda x : {_words('x').replace('lambda w : w', 'lambda v : v')}), lambda x : len(x) > 0) AS ps FROM c),
f AS (SELECT conv_id, 0 AS i, []::VARCHAR[] AS held, 0 AS n, 0 AS k, NULL::VARCHAR AS done FROM p WHERE floor(n * 1.3::DOUBLE) > 200
  UNION ALL SELECT conv_id, i + 1, CASE WHEN over THEN list_concat(tail, w) ELSE list_concat(held, w) END, CASE WHEN over THEN floor(len(tail) * 1.3::DOUBLE)::INT ELSE n END + more, k + over::INT, CASE WHEN over THEN array_to_string(held, ' ') END
  FROM (SELECT f.conv_id, i, held, f.n, k, ps[i + 1] AS w, floor(len(ps[i + 1]) * 1.3::DOUBLE)::INT AS more, f.n + floor(len(ps[i + 1]) * 1.3::DOUBLE)::INT > 200 AND len(held) > 0 AS over, held[greatest(1, len(held) - 19):] AS tail FROM f JOIN p USING (conv_id) WHERE i < len(ps)))
SELECT conv_id, 0::BIGINT AS chunk, t AS text FROM p WHERE floor(n * 1.3::DOUBLE) <= 200
UNION ALL SELECT conv_id, k - 1, done FROM f WHERE done IS NOT NULL
UNION ALL SELECT conv_id, k, array_to_string(held, ' ') FROM f JOIN p USING (conv_id) WHERE i = len(ps) AND len(held) > 0
""")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as paragraphs, chunked."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("t"))
    return turns.select("conv_id", F.posexplode(T.chunk_text(F.col("t"), _CUT, 20)).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("bigint"))


# --- page texts: the tables' pages have few tags, so regular expressions can take them apart

_PLAIN = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
_ONE = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_BARE = lambda x: f"regexp_replace({x}, '<[^>]*>', '', 'g')"
_LINES = lambda x: f"array_to_string(list_filter(list_transform(string_split({x}, {_LINE}), lambda l : {_ONE('l')}), lambda l : l <> ''), {_LINE})"
_TEXT = lambda x: _LINES(_PLAIN(_BARE(f"regexp_replace({x}, '<(?:br|/?(?:p|h1|div|article))\\b[^>]*>', {_LINE}, 'g')")))
# a <b> is never closed, so it holds all that is left of its article
_MARKS = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '<h1>(.*?)</h1>', {_LINE} || {_LINE} || '# \\1' || {_LINE} || {_LINE}, 'g'), '</?(?:p|div|article)\\b[^>]*>', {_LINE} || {_LINE}, 'g')"
_HALVES = lambda x: f"{_MARKS(f'string_split({x}, chr(60) || chr(98) || chr(62))[1]')} || CASE WHEN contains({x}, '<b>') THEN '**' || {_ONE(_BARE(f'substr({x}, strpos({x}, chr(60) || chr(98) || chr(62)))'))} || '**' ELSE '' END"
_TIDY = lambda x: f"trim(regexp_replace(array_to_string(list_transform(string_split({x}, {_LINE}), lambda l : trim(l)), {_LINE}), '\\n{{3,}}', {_LINE} || {_LINE}, 'g'), ' ' || {_LINE})"
_MARKDOWN = lambda x: _TIDY(_PLAIN(_HALVES(x)))
_PAGES = f"""
raw AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?s)^.*?</head>', ''), '(?s)<!--.*?-->|<nav>.*?</nav>|<footer>.*?(?:</footer>|$)|</?body>|</html>', '', 'g') AS body, {_ONE(_PLAIN("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title FROM pages),
parts AS (SELECT page_id, url, title, body, regexp_extract(body, '(?s)<article>(.*?)(?:</article>|$)', 1) AS art FROM raw),
texts AS (SELECT page_id, url, title, body, art, {_TEXT('art')} AS a, {_TEXT('body')} AS b FROM parts),
page AS (SELECT page_id, url, title, CASE WHEN length(a) >= 100 THEN a ELSE b END AS content, CASE WHEN length(a) >= 100 THEN {_MARKDOWN('art')} ELSE {_MARKDOWN('body')} END AS markdown, {_MARKDOWN('body')} AS whole FROM texts)"""


@query(f"WITH {_PAGES} SELECT page_id, title, content FROM page")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", H.extracted(F.col("html")).alias("x")).select("page_id", "x.title", "x.content")


@query(f"WITH {_PAGES} SELECT page_id, whole AS markdown FROM page")
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", H.markdown(F.col("html")).alias("markdown"))


# --- compression of any rows


def _compressed(rows: str, asked: str) -> str:
    """CTEs that end in cmp (k, content), of CTEs of texts (k, text, budget) and of the terms asked for (k, term, times)."""
    return f"""
cs AS (SELECT k, text, budget, {_SENTENCES.format(x='text')} AS s FROM {rows}),
ce AS (SELECT k, budget, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM cs), ct AS (SELECT k, budget, i, s, {_words('lower(s)')} AS w FROM ce),
cst AS (SELECT k, count(*) AS n, avg(len(w)) AS a FROM ct GROUP BY k),
ctf AS (SELECT ct.k, i, term, times, len(list_filter(w, lambda x : x = term)) AS tf, len(w) AS l FROM ct JOIN {asked} USING (k)), cdf AS (SELECT k, term, count(*) AS df FROM ctf WHERE tf > 0 GROUP BY ALL),
csc AS (SELECT k, i, sum(times * {_IDF} * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / greatest(a, 1)))) AS s FROM ctf JOIN cdf USING (k, term) JOIN cst USING (k) GROUP BY ALL),
ctop AS (SELECT k, i FROM (SELECT ct.k, ct.i, row_number() OVER (PARTITION BY ct.k ORDER BY round(coalesce(csc.s, 0), 10) DESC, ct.i) AS r FROM ct LEFT JOIN csc USING (k, i)) WHERE r <= 10),
cpick AS (SELECT k, budget, i, s, len(w) AS l FROM ct WHERE (k, i) IN (SELECT (k, i) FROM ctop) OR ((k, i - 1) IN (SELECT (k, i) FROM ctop) AND regexp_matches(s, '^(?i:{'|'.join(T.CONNECTORS)})(?:$|[^\\p{{L}}\\p{{N}}_])'))),
cfit AS (SELECT k, string_agg(s, ' ' ORDER BY i) AS c FROM (SELECT *, sum(l) OVER (PARTITION BY k ORDER BY i) AS upto FROM cpick) WHERE upto <= budget GROUP BY k),
cmp AS (SELECT k, CASE WHEN len(s) = 0 THEN substr(text, 1, budget * 4) ELSE coalesce(c, s[1]) END AS content FROM cs LEFT JOIN cfit USING (k))"""


_TOKENS = f"greatest(1, floor(len({_words('cmp.content')}) * 1.3::DOUBLE)::INT) AS token_count"


@query(f"""WITH {_PAGES}, rows AS (SELECT page_id AS k, content AS text, {_CUT} AS budget FROM page), asked AS (SELECT page_id AS k, lower(url) AS term, 1 AS times FROM page), {_compressed('rows', 'asked')}
SELECT url, title, cmp.content, markdown, 'ok' AS status, {_TOKENS} FROM page JOIN cmp ON k = page_id""")
def scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.scrape(_table(spark, sf_dir, "pages"), max_tokens=_CUT)


@query(f"""WITH {_PAGES}, once AS (SELECT * FROM page WHERE page_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1), rows AS (SELECT page_id AS k, content AS text, 100 AS budget FROM once),
asked AS (SELECT page_id AS k, unnest(['the', 'and', 'of']) AS term, 1 AS times FROM once), {_compressed('rows', 'asked')}
SELECT url, title, cmp.content, 'ok' AS status FROM once JOIN cmp ON k = page_id UNION ALL SELECT 'https://nowhere.example/', NULL, '', 'error' UNION ALL SELECT 'http://10.0.0.1/', NULL, '', 'blocked'""")
def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").filter("page_id % 3 = 0")
    wanted = pages.select("url").union(spark.createDataFrame([("https://nowhere.example/",), ("http://10.0.0.1/",)], "url string"))
    return tools.extract(pages, wanted, "the and of", 100)


_MANUAL = "Modules are files. They hold functions. Loops repeat code many times. " * 5
_LIBRARY_ROWS = [("Python", "loops", "https://docs.python.org/3/", "docs"), ("numpy", "arrays", "https://numpy.org/doc/stable/", "error"), ("nothing", "x", None, "none")]


@query(f"""WITH v AS (SELECT * FROM {_values(_LIBRARY_ROWS, "library, query, docs_url, source")}), rows AS (SELECT library AS k, 'Docs' || {_LINE} || trim({_literal(_MANUAL)}) AS text, 30 AS budget FROM v WHERE source = 'docs'),
asked AS (SELECT library AS k, unnest([lower(library), query]) AS term, 1 AS times FROM v), {_compressed('rows', 'asked')}
SELECT library, query, docs_url, source, coalesce(content, '') AS content, len({_words("coalesce(content, '')")})::INT AS token_count FROM v LEFT JOIN cmp ON k = library""")
def documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame([("https://docs.python.org/3/", f"<main><h1>Docs</h1><p>{_MANUAL}</p></main>")], "url string, html string")
    return tools.docs(spark.createDataFrame([r[:2] for r in _LIBRARY_ROWS], "library string, query string"), pages, max_tokens=30)


# --- search and validation, with an embedder that SQL can follow

_LETTERS = "etaoinshrdlu"


def letter_counts(text: Column) -> Column:
    """How often some letters occur."""
    t = F.lower(text)
    return F.array(*((F.length(t) - F.length(F.replace(t, F.lit(c)))).cast("double") for c in _LETTERS))


def letters(text: Column) -> Column:
    """An embedder: how often some letters occur, at length 1."""
    return T.let(letter_counts(text), V.unit)


_VEC = lambda x: f"list_transform({list(_LETTERS)}, lambda c : (length(lower({x})) - length(replace(lower({x}), c, '')))::DOUBLE)"
_COS = lambda a, b: f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"


def _semantic(hits: str, asked: str) -> str:
    """CTEs that end in sem (query_id, pos, semantic_score), of CTEs (query_id, pos, content) and (query_id, query)."""
    return f"""
sq AS (SELECT query_id, {_VEC('query')} AS qv FROM {asked}), ss AS (SELECT query_id, pos, content, {_SENTENCES.format(x="coalesce(content, '')")} AS s FROM {hits}),
se AS (SELECT query_id, pos, unnest(s[1:20]) AS one, generate_subscripts(s[1:20], 1) - 1 AS i FROM ss WHERE len(s) > 3), sv AS (SELECT query_id, pos, i, {_VEC('one')} AS v FROM se),
sb AS (SELECT query_id, pos, arg_max(i, (round({_COS('v', 'qv')}, 10), -i)) AS best FROM sv JOIN sq USING (query_id) GROUP BY ALL),
sn AS (SELECT query_id, pos, CASE WHEN best IS NULL THEN substr(coalesce(content, ''), 1, 500) ELSE array_to_string(CASE WHEN best > 0 THEN s[best:best + 2] ELSE s[1:2] END, ' ') END AS snippet FROM ss LEFT JOIN sb USING (query_id, pos)),
sx AS (SELECT query_id, pos, snippet, {_VEC('snippet')} AS v FROM sn), sem AS (SELECT query_id, pos, CASE WHEN trim(snippet) = '' THEN 0 ELSE round(greatest(0, {_COS('v', 'qv')}), 4) END + 0.0::DOUBLE AS semantic_score FROM sx JOIN sq USING (query_id))"""


def _agreed(hits: str) -> str:
    """CTEs that end in agr (query_id, pos, agreement_score), of a CTE (query_id, pos, content)."""
    return f"""
ah AS (SELECT query_id, pos, substr(coalesce(content, ''), 1, 300) AS h FROM {hits}), av AS (SELECT query_id, pos, {_VEC('h')} AS v FROM ah WHERE trim(h) <> ''),
ap AS (SELECT a.query_id, a.pos, avg({_COS('a.v', 'b.v')}) AS m FROM av a JOIN av b ON a.query_id = b.query_id AND a.pos <> b.pos GROUP BY ALL),
agr AS (SELECT query_id, pos, round(greatest(0, coalesce(m, 0)), 4) + 0.0::DOUBLE AS agreement_score FROM ah LEFT JOIN ap USING (query_id, pos))"""


def _ranked(asked: str, most: int) -> str:
    """CTEs that end in ranked (query_id, pos, doc_id, source, content, bm25_score): retrieval and rank of a CTE (query_id, query, intent, wanted)."""
    return f"""
ra AS (SELECT query_id, intent, term, count(*) AS times FROM (SELECT query_id, intent, unnest({_words('lower(query)')}) AS term FROM {asked}) GROUP BY ALL),
rd AS (SELECT doc_id, source, text, {_words('lower(text)')} AS t FROM documents), rf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM rd) WHERE term IN (SELECT term FROM ra) GROUP BY ALL),
rs AS (SELECT query_id, doc_id, count(*) AS held, sum(tf) AS tf FROM ra JOIN rf USING (term) GROUP BY ALL),
rh AS (SELECT query_id, doc_id, p FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY held DESC, tf DESC, doc_id) - 1 AS p FROM rs) JOIN {asked} USING (query_id) WHERE p < wanted AND p < {most}),
rp AS (SELECT query_id, count(*) AS n, avg(len(t)) AS a FROM rh JOIN rd USING (doc_id) GROUP BY query_id), rdf AS (SELECT query_id, term, count(*) AS df FROM rh JOIN ra USING (query_id) JOIN rf USING (doc_id, term) GROUP BY ALL),
rb AS (SELECT query_id, doc_id, sum(times * {_IDF} * tf * (({_K1}) + 1) / (tf + ({_K1}) * (1 - ({_B}) + ({_B}) * l / greatest(a, 1)))) AS s FROM rh JOIN ra USING (query_id) JOIN rf USING (doc_id, term) JOIN rdf USING (query_id, term) JOIN rp USING (query_id) GROUP BY ALL),
rr AS (SELECT query_id, doc_id, p, source, text AS content, round(coalesce(s, 0), 4) AS bm25_score FROM rh JOIN rd USING (doc_id) LEFT JOIN rb USING (query_id, doc_id)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, p) - 1 AS pos, doc_id, source, content, bm25_score FROM rr)"""


_NEGATED = lambda x: f"coalesce({_flag(x, _NEGATION_SQL[:4])} OR regexp_matches({x}, '(?i){_WAS}'), FALSE)"
_EDGE = "[^\\p{L}\\p{N}_\\n]"
_WAS = f"(?:^|[^\\p{{L}}\\p{{N}}_])(?:was(?:{_EDGE}(?:.*{_EDGE})?)now|antes(?:{_EDGE}(?:.*{_EDGE})?)ahora)(?:$|[^\\p{{L}}\\p{{N}}_])"
_CLAIMED = f"round(coalesce({_CLAIM_SQL.format(x='content')} / nullif(len(list_filter(string_split_regex(content, '[.!?]+'), lambda s : NOT regexp_full_match(s, '\\s*'))), 0)::DOUBLE, 0), 4)"


def _dense(hits: str) -> str:
    """CTEs that end in den (query_id, pos, density), unrounded."""
    return f"""
dt AS (SELECT query_id, pos, {_words("lower(coalesce(content, ''))")} AS t FROM {hits}), dc AS (SELECT query_id, pos, n, count(*) AS c FROM (SELECT query_id, pos, len(t) AS n, unnest(t) AS w FROM dt) GROUP BY query_id, pos, n, w),
dh AS (SELECT query_id, pos, n, -sum(c / n::DOUBLE * log2(c / n::DOUBLE)) AS h FROM dc GROUP BY ALL), den AS (SELECT query_id, pos, CASE WHEN coalesce(n, 0) < 2 THEN 0 ELSE h / log2(n) END + 0.0::DOUBLE AS density FROM dt LEFT JOIN dh USING (query_id, pos))"""


_LEVEL = "CASE WHEN c >= 0.8::DOUBLE THEN 'high' WHEN c >= 0.5::DOUBLE THEN 'medium' WHEN c >= 0.3::DOUBLE THEN 'low' ELSE 'unknown' END"
_LONG = "the thnt and ther of; le la les dans"
_REQUESTS = [(i, q, 5, "quick", 900) for i, q, _ in ASKED] + [(9, _LONG, 8, "standard", 1500)]


def _requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_REQUESTS, "query_id long, raw_query string, max_results int, depth string, max_tokens int")


@query(f"WITH asked AS (SELECT query_id, query FROM {_values(ASKED, 'query_id, query, intent')}), hits AS (SELECT doc_id % 5 AS query_id, doc_id AS pos, text AS content FROM documents), {_semantic('hits', 'asked')} SELECT * FROM sem")
def semantic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("query_id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"))
    # sums of products of counts are whole, so cosines are the SQL's to the last bit, which decides what lies between two roundings
    return grounding.semantic_score(hits, _asked(spark), letter_counts).select("query_id", "pos", (F.col("semantic_score") + F.lit(0.0)).alias("semantic_score"))


_SEARCHED = ["query_id", "url", "title", "content", "bm25_score", "semantic_score", "info_density", "claim_density", "agreement_score", "has_contradiction_markers", "confidence", "confidence_level"]


@query(f"""WITH asked AS (SELECT query_id, query, 'informational' AS intent, m AS max_results, 2 * m AS wanted FROM {_values([r[:3] for r in _REQUESTS], 'query_id, query, m')}), {_ranked('asked', 40)}, {_semantic('ranked', 'asked')}, {_agreed('ranked')}, {_dense('ranked')},
sig AS (SELECT *, {_NEGATED('content')} AS has_contradiction_markers, round(density, 4) AS info_density, {_CLAIMED} AS claim_density FROM ranked JOIN sem USING (query_id, pos) JOIN agr USING (query_id, pos) JOIN den USING (query_id, pos)),
con AS (SELECT *, least(1, greatest(0, 0.25::DOUBLE * least(bm25_score / 10, 1) + 0.2::DOUBLE * 0.4::DOUBLE + 0.2::DOUBLE * semantic_score + 0.15::DOUBLE * 0.7::DOUBLE + 0.1::DOUBLE * info_density + 0.1::DOUBLE * agreement_score)) AS c FROM sig),
few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS place FROM (SELECT * FROM con QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY pos) <= 2)),
cut AS (SELECT few.*, query_id * 100 + place AS k, query, count(*) OVER (PARTITION BY query_id) AS many FROM few JOIN asked USING (query_id) WHERE place < max_results),
rows AS (SELECT k, content AS text, CASE WHEN many = 1 THEN 3000 ELSE greatest(200, floor(3000 * (many - place) / (many * (many + 1) / 2)::DOUBLE)) END::INT AS budget FROM cut),
terms AS (SELECT k, term, count(*) AS times FROM (SELECT k, unnest({_words('lower(query)')}) AS term FROM cut) GROUP BY ALL), {_compressed('rows', 'terms')}
SELECT query_id, place AS pos, 'https://' || source || '.example/' || doc_id AS url, 'Document ' || doc_id AS title, cmp.content, bm25_score, semantic_score, info_density, claim_density, agreement_score, has_contradiction_markers, round(c, 4) AS confidence, {_LEVEL} AS confidence_level FROM cut JOIN cmp USING (k)""")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tools.search(_requests(spark), C.documents_as_corpus(_table(spark, sf_dir, "documents")), letters)
    return found.select(F.col("pos").cast("bigint").alias("pos"), *_SEARCHED)


@query(f"""WITH asked AS (SELECT query_id, query, 'informational' AS intent, 8 AS wanted FROM {_values([r[:2] for r in _REQUESTS], 'query_id, query')}), {_ranked('asked', 20)}, hits AS (SELECT * FROM ranked WHERE pos < 4), {_agreed('hits')}, {_dense('hits')},
m AS (SELECT query_id, count(*) AS n, count(*) FILTER (NOT {_NEGATED('content')}) AS good, least(arg_min(bm25_score, pos) / 10, 1) AS r, avg(density) AS d, avg(agreement_score) AS a FROM hits JOIN agr USING (query_id, pos) JOIN den USING (query_id, pos) GROUP BY query_id),
s AS (SELECT query_id, query, n, good, 0.25::DOUBLE * coalesce(r, 0) + 0.2::DOUBLE * CASE WHEN n > 0 THEN 0.4::DOUBLE ELSE 0 END + 0.15::DOUBLE * 0.7::DOUBLE + 0.1::DOUBLE * coalesce(d, 0) + 0.1::DOUBLE * coalesce(a, 0) AS c FROM asked LEFT JOIN m USING (query_id))
SELECT query_id, query AS claim, {_NEGATED('query')} AS has_negation_markers, {_CLAIM_SQL.format(x='query')}::INT AS verifiable_claims, coalesce(n, 0) AS sources_checked, coalesce(good, 0) AS sources_supporting, round(c, 4) AS overall_confidence, {_LEVEL} AS confidence_level FROM s""")
def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _requests(spark).select("query_id", F.col("raw_query").alias("claim"), F.lit(4).alias("max_sources"))
    return tools.validate(claims, C.documents_as_corpus(_table(spark, sf_dir, "documents")), letters)[0]


# Sub-queries have number 10 * query_id + place; the last request alone falls into several.
_PARTS = [(10 * i, q, 8) for i, q, _ in ASKED] + [(90 + i, q, 12) for i, q in enumerate(["the thnt", "ther of", "le la les dans"])]
_SHOWN = ["query_id", "url", "content", "bm25_score", "rrf_score", "info_density", "claim_density", "agreement_score", "confidence", "confidence_level", "result_count"]


def _named(prefix: str, ctes: str) -> str:
    """The CTEs with another name each, so that they can be used again."""
    names = "|".join(re.findall(r"(\w+) AS \(SELECT", ctes))
    return re.sub(rf"\b({names})\b", rf"{prefix}\1", ctes)


def _enriched(prefix: str, hits: str) -> str:
    """CTEs that end in {prefix}_rich: a CTE of hits (query_id, pos, source, content, bm25_score, ...) with signals and confidence c."""
    return f"""{_named(prefix, _agreed(hits))}, {_named(prefix, _dense(hits))},
{prefix}_sig AS (SELECT *, round(density, 4) AS info_density, {_CLAIMED} AS claim_density FROM {hits} JOIN {prefix}agr USING (query_id, pos) JOIN {prefix}den USING (query_id, pos)),
{prefix}_rich AS (SELECT *, least(1, greatest(0, 0.25::DOUBLE * least(bm25_score / 10, 1) + 0.2::DOUBLE * 0.4::DOUBLE + 0.15::DOUBLE * 0.7::DOUBLE + 0.1::DOUBLE * info_density + 0.1::DOUBLE * agreement_score)) AS c FROM {prefix}_sig)"""


@query(f"""WITH q AS (SELECT query_id, query, CASE query_id WHEN 9 THEN 12 ELSE 8 END AS wanted, budget FROM {_values([(r[0], r[1], r[4]) for r in _REQUESTS], 'query_id, query, budget')}),
parts AS (SELECT query_id, query, 'informational' AS intent, wanted FROM {_values(_PARTS, 'query_id, query, wanted')}), {_named('x', _ranked('parts', 20))},
lists AS (SELECT query_id // 10 AS query_id, query_id % 10 AS list, pos, doc_id, source, content, bm25_score FROM xranked),
fused AS (SELECT query_id, doc_id, any_value(source) AS source, any_value(content) AS content, arg_min(bm25_score, (list, pos)) AS bm25_score, sum(1 / (1 + 0.2::DOUBLE * list) / (61 + pos)) AS score, min((list, pos)) AS first FROM lists GROUP BY query_id, doc_id),
found AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) - 1 AS pos, doc_id, source, content, bm25_score, CASE WHEN query_id = 9 THEN round(score, 4) END AS rrf_score FROM fused), {_enriched('f', 'found')},
weak AS (SELECT query_id FROM f_rich WHERE pos < 3 GROUP BY query_id HAVING avg(round(c, 4)) < 0.45::DOUBLE),
w AS (SELECT query_id, pos, len(t) AS l, unnest(t) AS term, generate_subscripts(t, 1) AS spot FROM (SELECT query_id, pos, {_words('lower(content)')} AS t FROM found JOIN weak USING (query_id) WHERE pos < 3)),
wt AS (SELECT query_id, pos, l, term, count(*) AS tf, min(spot) AS spot FROM w GROUP BY ALL),
wc AS (SELECT query_id, term, count(*) AS df, sum(tf / l::DOUBLE) AS share, min((pos, spot)) AS spot FROM wt JOIN q USING (query_id) WHERE length(term) >= 4 AND term NOT IN ({', '.join(map(_literal, ranking.FEEDBACK_STOPS))}) AND NOT list_contains({_words('lower(query)')}, term) GROUP BY ALL),
wn AS (SELECT query_id, count(*) AS n FROM found JOIN weak USING (query_id) WHERE pos < 3 GROUP BY query_id),
best AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY round(share * ln(n / (df + 1)::DOUBLE + 1), 12) DESC, spot) AS r FROM wc JOIN wn USING (query_id)),
retry AS (SELECT query_id, query || coalesce(' ' || added, '') AS query, 'informational' AS intent, wanted FROM q JOIN weak USING (query_id) LEFT JOIN (SELECT query_id, string_agg(term, ' ' ORDER BY r) AS added FROM best WHERE r <= 5 GROUP BY query_id) USING (query_id)), {_named('y', _ranked('retry', 20))},
two AS (SELECT query_id, 0 AS list, pos, doc_id, source, content, bm25_score FROM found JOIN weak USING (query_id) UNION ALL SELECT query_id, 1, pos, doc_id, source, content, bm25_score FROM yranked),
again AS (SELECT query_id, doc_id, any_value(source) AS source, any_value(content) AS content, arg_min(bm25_score, (list, pos)) AS bm25_score, sum(CASE list WHEN 0 THEN 2.0 ELSE 1.0 END::DOUBLE / (61 + pos)) AS score, min((list, pos)) AS first FROM two GROUP BY query_id, doc_id),
merged AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) - 1 AS pos, doc_id, source, content, bm25_score, round(score, 4) AS rrf_score FROM again), {_enriched('g', 'merged')},
every AS (SELECT query_id, pos, doc_id, source, content, bm25_score, rrf_score, info_density, claim_density, agreement_score, c FROM f_rich WHERE query_id NOT IN (SELECT query_id FROM weak) UNION ALL SELECT query_id, pos, doc_id, source, content, bm25_score, rrf_score, info_density, claim_density, agreement_score, c FROM g_rich),
few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY query_id) AS many FROM (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY pos) <= 2)),
cut AS (SELECT few.*, query_id * 100 + place AS k, query, wanted, budget FROM few JOIN q USING (query_id)),
rows AS (SELECT k, content AS text, CASE WHEN many = 1 THEN budget ELSE greatest(200, floor(budget * (many - place) / (many * (many + 1) / 2)::DOUBLE)) END::INT AS budget FROM cut),
terms AS (SELECT k, term, count(*) AS times FROM (SELECT k, unnest({_words('lower(query)')}) AS term FROM cut) GROUP BY ALL), {_compressed('rows', 'terms')}
SELECT query_id, place AS pos, 'https://' || source || '.example/' || doc_id AS url, cmp.content, bm25_score, rrf_score, info_density, claim_density, agreement_score, round(c, 4) AS confidence, {_LEVEL} AS confidence_level, many AS result_count FROM cut JOIN cmp USING (k) WHERE place < wanted""")
def research(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tools.research(_requests(spark), C.documents_as_corpus(_table(spark, sf_dir, "documents")), embed=letters)
    return found.select(F.col("pos").cast("bigint").alias("pos"), *_SHOWN)
