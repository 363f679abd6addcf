"""The queries by name, each with the DuckDB SQL that it must agree with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.functions import vectors as V
from gleaner.operators import compression, grounding, links, quality, ranking, resilience
from gleaner.plans import tools
from gleaner.sources import corpus as C
from gleaner.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v).upper() if isinstance(v, bool) else repr(v) + ("::DOUBLE" if isinstance(v, float) else "")


def _values(rows: list[tuple], columns: str) -> str:
    """Rows as a FROM item of SQL."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS v({columns})"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w : w <> '')"


ASKED = [(0, "the and of there", "informational"), (1, "der die und die", "code"), (2, "le la les dans", "academic"), (3, "que de los las", "navigational"), (4, "inger nowhere the", "other")]
_ASKED = "query_id bigint, query string, intent string"
TEXTS = [
    "official python docs", "arxiv api", "npm docs", "weather", "learn python and learn rust; go", "salt and pepper", "latest news today", "fastapi site:github.com  Filetype:pdf auth", "The cat is on el mat",
    "async database api", "db database", "query search", "Growth was 12.5% and 100% of 2024 users must agree.", "no longer supported", "It was good but\nnow bad", "antes era asi y ahora no", "was replaced by another",
    "  spaces   between  words ", "", "sign in to homepage", "updated schedules also current standings; and then more", "inurl:login fast join", "This study shows that all tests never fail 100 of 250 times",
]
_TEXTS = _values([(i, t) for i, t in enumerate(TEXTS)], "id, t")
URLS = [
    "HTTP://Ex.COM/a/b/?q=1#f", "", "/rel/", "http://h/a/;p?", "mailto:x@y", "https://netflix.com/a", "https://notgithub.com/x", "https://docs.python.org/3/", "https://u@github.com:443/x", "https://a.example.org/p//", "https://x.com",
    "ftp://files.example.org/a b/", "https://en.wikipedia.org/wiki/Url?x=1&y=/", "https://example.com/#top", "http://localhost/x", "http://10.1.2.3/", "http://[::1]/", "http://0.0.0.0/", "javascript:alert(1)", "http://192.168.0.9:8080/a", "https://8.8.8.8/dns",
]


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")


def _urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(URLS)), "id int, url string")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, _ASKED)


_IDF = "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)"
_K1 = "CASE intent WHEN 'code' THEN 0.9 WHEN 'academic' THEN 1.5 WHEN 'navigational' THEN 1.0 ELSE 1.2 END::DOUBLE"
_B = "CASE intent WHEN 'code' THEN 0.5 WHEN 'academic' THEN 0.85 WHEN 'navigational' THEN 0.6 ELSE 0.75 END::DOUBLE"


@query(f"""
WITH q AS (SELECT query_id, intent, unnest(string_split(lower(query), ' ')) AS term FROM {_values(ASKED, "query_id, query, intent")}),
qq AS (SELECT query_id, intent, term, count(*) AS times FROM q GROUP BY ALL),
d AS (SELECT doc_id, {_words("lower(text)")} AS t FROM documents),
pool AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM d) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(times * {_IDF} * tf * (({_K1}) + 1) / (tf + ({_K1}) * (1 - ({_B}) + ({_B}) * l / greatest(a, 1)))), 4) AS bm25_score
  FROM qq JOIN tf USING (term) JOIN dfs USING (term) CROSS JOIN pool GROUP BY ALL)
SELECT query_id, doc_id, bm25_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each query, by the statistics of the whole corpus."""
    return ranking.corpus_bm25(_asked(spark), _table(spark, sf_dir, "documents"))


@query(f"""
WITH v AS (SELECT * FROM {_values(ASKED, "query_id, query, intent")}), q AS (SELECT query_id, intent, unnest(string_split(lower(query), ' ')) AS term FROM v),
d AS (SELECT doc_id % 5 AS query_id, doc_id, {_words("lower(text)")} AS t FROM documents),
pool AS (SELECT query_id, count(*) AS n, avg(len(t)) AS a FROM d GROUP BY query_id),
tf AS (SELECT query_id, doc_id, l, term, count(*) AS tf FROM (SELECT query_id, doc_id, len(t) AS l, unnest(t) AS term FROM d) GROUP BY ALL),
dfs AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum({_IDF} * tf * (({_K1}) + 1) / (tf + ({_K1}) * (1 - ({_B}) + ({_B}) * l / greatest(a, 1)))) AS s
  FROM q JOIN tf USING (query_id, term) JOIN dfs USING (query_id, term) JOIN pool USING (query_id) GROUP BY ALL),
r AS (SELECT d.query_id, d.doc_id, round(coalesce(s, 0), 4) AS bm25_score FROM d LEFT JOIN s USING (query_id, doc_id))
SELECT query_id, doc_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, doc_id) - 1 AS pos FROM r
""")
def bm25_intent_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document ranked for the query of its pool, by that pool's statistics and the intent's parameters."""
    hits = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("query_id"), F.col("doc_id").alias("pos"), "doc_id", F.col("text").alias("content"))
    return ranking.bm25_rank(hits, _asked(spark)).select("query_id", "doc_id", "bm25_score", F.col("pos").cast("bigint").alias("pos"))


@query(f"""
WITH v AS (SELECT * FROM {_values(ASKED, "query_id, query, intent")}), q AS (SELECT DISTINCT query_id, unnest(string_split(lower(query), ' ')) AS term FROM v),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_words("lower(text)")}) AS term FROM documents) GROUP BY ALL),
s AS (SELECT query_id, doc_id, count(*) AS held, sum(tf) AS tf FROM q JOIN tf USING (term) GROUP BY ALL)
SELECT query_id, 'https://' || source || '.example/' || doc_id AS url, held::DOUBLE AS score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY held DESC, tf DESC, doc_id) - 1 AS pos FROM s) JOIN documents USING (doc_id) WHERE pos < 20
""")
def corpus_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _asked(spark).withColumn("wanted", F.lit(20))
    hits = C.retrieve(q, C.documents_as_corpus(_table(spark, sf_dir, "documents")))
    return hits.select("query_id", "url", "score", F.col("pos").cast("bigint").alias("pos"))


@query(f"SELECT doc_id, greatest(1, floor(len({_words('text')}) * 1.3::DOUBLE)::INT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


_DENSITY = f"""
WITH d AS (SELECT doc_id, {_words("lower(text)")} AS t FROM documents),
c AS (SELECT doc_id, n, w, count(*) AS c FROM (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM d) GROUP BY ALL),
h AS (SELECT doc_id, n, -sum(c / n::DOUBLE * log2(c / n::DOUBLE)) AS h FROM c GROUP BY ALL)
SELECT doc_id, round(CASE WHEN coalesce(n, 0) < 2 THEN 0 ELSE h / log2(n) END, 4) + 0.0::DOUBLE AS info_density FROM d LEFT JOIN h USING (doc_id)
"""


@query(_DENSITY)
def info_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.density(_table(spark, sf_dir, "documents")).withColumn("info_density", F.col("info_density") + F.lit(0.0))


@query(_DENSITY)
def info_density_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a fold within each row, as the tools use it on hits."""
    return _table(spark, sf_dir, "documents").select("doc_id", (F.round(T.information_density(F.col("text")), 4) + F.lit(0.0)).alias("info_density"))


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+([A-ZÀ-ɏ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s : trim(s, chr(32) || chr(9) || chr(10) || chr(13))), lambda s : length(s) > 10)"


@query(f"SELECT doc_id, len({_SENTENCES.format(x='text')})::INT AS sentences FROM documents")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(T.split_sentences(F.col("text"))).alias("sentences"))


_B1, _B2 = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"
_CLAIM_SQL = "(len(regexp_extract_all({x}, '\\b\\d+(?:\\.\\d+)?%')) + len(regexp_extract_all({x}, '\\b\\d{{2,}}')) + len(regexp_extract_all({x}, '(?i)\\b(?:all|always|every|must|never|none)\\b')) + len(regexp_extract_all({x}, '(?i)\\b(?:confirms?|demonstrates?|proves?|shows?)\\b')))"


@query(f"SELECT doc_id, {_CLAIM_SQL.format(x='text')}::INT AS claims, round(coalesce({_CLAIM_SQL.format(x='text')} / nullif(len(list_filter(string_split_regex(text, '[.!?]+'), lambda s : NOT regexp_full_match(s, '\\s*'))), 0)::DOUBLE, 0), 4) AS claim_density FROM documents WHERE lang = 'en'")
def claim_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", T.count_claims(F.col("text")).alias("claims"), T.claim_density(F.col("text")).alias("claim_density"))


def _flag(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '(?i){_B1}(?:{p}){_B2}')" for p in patterns) + ")"


_NEGATION_SQL = ["never|not?|ya no|no es", "replaced|changed\\s+from|cambió\\s+de", "rather than|instead of|en vez de", "obsolete|deprecated|elimina|removed", f"was{_B2}(?:.*{_B1})?now|was[^\\p{{L}}\\p{{N}}_\\n]now|antes{_B2}(?:.*{_B1})?ahora|antes[^\\p{{L}}\\p{{N}}_\\n]ahora"]
_CHANGE_SQL = ["removed|discontinued|obsolete|deprecated", "replaced\\s+(?:with|by)", "no\\s+longer\\s+(?:available|maintained|supported|works?)", "(?:were|was)\\s+(?:formerly|previously)"]


@query(f"SELECT doc_id, {_flag('text', _NEGATION_SQL[:4])} OR regexp_matches(text, '(?i){_B1}(?:was(?:[^\\p{{L}}\\p{{N}}_\\n](?:.*[^\\p{{L}}\\p{{N}}_\\n])?)now|antes(?:[^\\p{{L}}\\p{{N}}_\\n](?:.*[^\\p{{L}}\\p{{N}}_\\n])?)ahora){_B2}') AS negation FROM documents")
def negation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.has_negation(F.col("text")).alias("negation"))


@query(f"SELECT id, {_flag('t', _CHANGE_SQL)} AS changed, {_flag('t', _NEGATION_SQL[:4])} OR regexp_matches(t, '(?i)\\b(?:was\\b.*\\bnow|antes\\b.*\\bahora)\\b') AS negation FROM {_TEXTS}")
def temporal_change_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", T.has_temporal_change(F.col("t")).alias("changed"), T.has_negation(F.col("t")).alias("negation"))


@query(f"""SELECT id, CASE WHEN regexp_matches(t, '(?i)\\b(download|go to|homepage|login|official|sign in)\\b') THEN 'navigational' WHEN regexp_matches(t, '(?i)\\b(arxiv|citation|doi|journal|paper|research|study|thesis)\\b') THEN 'academic'
WHEN regexp_matches(t, '(?i)\\b(api|crate|docs|github|library|module|npm|package|pypi|sdk)\\b') THEN 'code' ELSE 'informational' END AS intent FROM {_TEXTS}""")
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", T.detect_intent(F.col("t")).alias("intent"))


@query(f"""WITH p AS (SELECT id, t, list_filter(list_transform(string_split_regex(t, '(?i)\\b(?:also|and|y)\\b|;'), lambda x : trim(x, chr(32) || chr(10))), lambda x : length(x) > 5) AS parts FROM {_TEXTS})
SELECT id, unnest(CASE WHEN len(parts) >= 2 THEN parts ELSE [t] END) AS part FROM p""")
def decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", F.explode(T.decompose_query(F.col("t"))).alias("part"))


@query(f"SELECT id, array_to_string(regexp_extract_all(t, '(?i)\\b(?:site|inurl|intitle|filetype):\\S+'), '|') AS operators, array_to_string({_words(chr(114) + 'egexp_replace(t, ' + chr(39) + '(?i)' + chr(92) + 'b(?:site|inurl|intitle|filetype):' + chr(92) + 'S+' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, ' ') AS clean FROM {_TEXTS}")
def operators_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", F.array_join(T.query_operators(F.col("t")), "|").alias("operators"), T.without_operators(F.col("t")).alias("clean"))


@query(f"SELECT id, array_to_string(list_filter({_words('t')}, lambda w : NOT list_contains([{', '.join(map(_literal, T.STOPWORDS))}], lower(w))), ' ') AS kept FROM {_TEXTS}")
def stopwords_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", T.remove_stopwords(F.col("t")).alias("kept"))


_SYNONYM_ROWS = [(k, i, s) for k, v in tables.SYNONYMS.items() for i, s in enumerate(v)]


@query(f"""
WITH RECURSIVE q AS (SELECT id, {_words("lower(t)")} AS w FROM {_TEXTS}), s AS (SELECT term, list(syn ORDER BY ord) AS syns FROM {_values(_SYNONYM_ROWS, "term, ord, syn")} GROUP BY term),
f AS (SELECT id, w, w AS o, 1 AS i, 1 AS j, 0 AS added FROM q UNION ALL
  SELECT id, w, CASE WHEN new THEN list_append(o, syn) ELSE o END, CASE WHEN last THEN i + 1 ELSE i END, CASE WHEN last THEN 1 ELSE j + 1 END, CASE WHEN last THEN 0 WHEN new THEN added + 1 ELSE added END
  FROM (SELECT f.*, syns[j] AS syn, j >= coalesce(len(syns), 0) AS last, coalesce(j <= len(syns) AND added < 2 AND NOT list_contains(o, syns[j]), FALSE) AS new FROM f LEFT JOIN s ON s.term = w[i] WHERE i <= len(w)))
SELECT id, array_to_string(o, ' ') AS expanded FROM f WHERE i = len(w) + 1
""")
def synonym_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", T.expand_query(F.col("t"), tables.synonym_map()).alias("expanded"))


@query(f"""WITH w AS (SELECT id, regexp_matches(t, '(?i)\\b(2025|2026|current|latest|newest|now|recent|today|updated?)\\b') AS hot FROM {_TEXTS})
SELECT id, CASE WHEN hot THEN 0.2 ELSE 0.25 END::DOUBLE AS w_content, CASE WHEN hot THEN 0.15 ELSE 0.2 END::DOUBLE AS w_tier, CASE WHEN hot THEN 0.25 ELSE 0.15 END::DOUBLE AS w_freshness FROM w""")
def confidence_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", T.confidence_weights(F.col("t")).alias("w")).select("id", "w.*")


@query(f"SELECT id, array_to_string(list_sort(list_filter([lower(trim(t)), lower('General'), lower('')], lambda x : x <> '')), ' ') AS key FROM {_TEXTS}")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", T.cache_key(F.col("t"), F.lit("General"), F.lit(" ")).alias("key"))


@query(f"SELECT id, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS normalized FROM {_TEXTS}")
def normalized_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", T.normalize_query(F.col("t")).alias("normalized"))


_CANONICAL = "regexp_extract(lower(url), '^https?://[^/?#]*') || coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') || coalesce('?' || nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), '')"


@query(f"SELECT page_id, {_CANONICAL} AS canonical FROM pages")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", U.normalize_url(F.col("url")).alias("canonical"))


@query(f"SELECT query_id, pos, page_id FROM (SELECT page_id % 5 AS query_id, page_id AS pos, page_id, row_number() OVER (PARTITION BY page_id % 5, {_CANONICAL.replace('url', 'u')} ORDER BY page_id) AS k FROM (SELECT page_id, regexp_replace(url, '/[a-z]+/(.).*$', '/\\1') AS u FROM pages)) WHERE k = 1")
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("query_id"), F.col("page_id").alias("pos"), "page_id", F.regexp_replace("url", "/[a-z]+/(.).*$", "/$1").alias("url"))
    return quality.deduplicate(hits).select("query_id", "pos", "page_id")


_NET = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_ENDS = lambda kind: "(" + " OR ".join(f"ends_with({_NET}, {_literal(d)})" for d in U.DOMAINS[kind]) + ")"
_URLS = _values(list(enumerate(URLS)), "id, url")


@query(f"SELECT id, CASE WHEN {_ENDS('tier1')} THEN 1 WHEN {_ENDS('tier2')} THEN 2 ELSE 3 END AS source_tier, CASE WHEN {_ENDS('tier1')} THEN 1.0 WHEN {_ENDS('tier2')} THEN 0.7 ELSE 0.4 END::DOUBLE AS tier_score FROM {_URLS}")
def source_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark).withColumn("source_tier", U.source_tier(F.col("url"))).withColumn("tier_score", U.tier_score(F.col("source_tier"))).drop("url")


@query(f"SELECT id, url FROM {_URLS} WHERE NOT {_ENDS('blocked')}")
def blacklist_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark).filter(~U.is_blacklisted(F.col("url")))


@query(f"""SELECT id, regexp_matches(url, '^(?i:https?)://') AND host <> '' AND host <> 'localhost' AND NOT (regexp_full_match(host, '\\d+\\.\\d+\\.\\d+\\.\\d+') AND regexp_matches(host, '^(10|127|169\\.254|192\\.168)\\.')) AND host <> '[::1]' AS public
FROM (SELECT id, url, regexp_extract(url, '^[A-Za-z]+://(?:[^@/?#]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1) AS host FROM {_URLS})""")
def url_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What URLs say of their hosts; no name is resolved."""
    return _urls(spark).select("id", U.is_public_literal(F.col("url")).alias("public"))


@query("""SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS pos FROM (SELECT doc_id % 7 AS query_id, doc_id, source, row_number() OVER (PARTITION BY doc_id % 7, source ORDER BY doc_id) AS k FROM documents) WHERE k <= CASE WHEN source = 'src1' THEN 3 ELSE 2 END""")
def domain_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = C.documents_as_corpus(_table(spark, sf_dir, "documents")).select((F.col("doc_id") % 7).alias("query_id"), F.col("doc_id").alias("pos"), "doc_id", "url", F.when(U.netloc(F.col("url")) == "src1.example", 1).otherwise(3).alias("source_tier"))
    return quality.diversify(hits).select("query_id", "doc_id", F.col("pos").cast("bigint").alias("pos"))


@query(f"""WITH h AS (SELECT doc_id % 4 AS query_id, doc_id AS pos, doc_id, 'https://' || CASE WHEN doc_id % 9 = 0 THEN 'x.com' WHEN doc_id % 5 = 0 THEN 'github.com' ELSE source || '.example' END || '/' || (doc_id % 50) AS url FROM documents)
SELECT query_id, pos, doc_id, CASE WHEN {_ENDS('tier2')} THEN 2 ELSE 3 END AS source_tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY pos) AS k FROM h WHERE NOT {_ENDS('blocked')}) WHERE k = 1""")
def filtered_and_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.when(F.col("doc_id") % 9 == 0, "x.com").when(F.col("doc_id") % 5 == 0, "github.com").otherwise(F.concat("source", F.lit(".example")))
    hits = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("query_id"), F.col("doc_id").alias("pos"), "doc_id", F.concat(F.lit("https://"), host, F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("url"))
    return quality.filter_and_classify(hits).select("query_id", "pos", "doc_id", "source_tier")


def _rankings(docs: DataFrame) -> list[DataFrame]:
    base = docs.select((F.col("doc_id") % 3).alias("query_id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "doc_id", "n_chars")
    place = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return [base.withColumn("pos", place(F.desc("n_chars"), "doc_id")).filter("pos <= 40"), base.withColumn("pos", place("doc_id")).filter("pos <= 40"), base.withColumn("pos", place(F.desc("doc_id"))).filter("pos <= 40")]


def _rrf_sql(weights: list[float]) -> str:
    orders = ["n_chars DESC, doc_id", "doc_id", "doc_id DESC"]
    lists = " UNION ALL ".join(f"(SELECT query_id, url, {i} AS l, {w}::DOUBLE AS w, r FROM (SELECT doc_id % 3 AS query_id, 'u' || doc_id AS url, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY {o}) AS r FROM documents) WHERE r <= 40)" for i, (o, w) in enumerate(zip(orders, weights, strict=False)))
    return f"""WITH u AS ({lists}), s AS (SELECT query_id, url, sum(w / (60 + r)) AS s, min(l * 1000 + r) AS spot FROM u GROUP BY ALL)
SELECT query_id, url, round(s, 4) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, spot) - 1 AS pos FROM s"""


@query(_rrf_sql([1.0, 1.0, 1.0]))
def rrf_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rrf_fuse(_rankings(_table(spark, sf_dir, "documents"))).select("query_id", "url", "rrf_score", F.col("pos").cast("bigint").alias("pos"))


@query(_rrf_sql([2.0, 1.0]))
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weights for three rankings: the third is left out."""
    return ranking.rrf_fuse(_rankings(_table(spark, sf_dir, "documents")), [2.0, 1.0]).select("query_id", "url", "rrf_score", F.col("pos").cast("bigint").alias("pos"))


@query(f"""
WITH d AS (SELECT doc_id % 6 AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 6 ORDER BY doc_id) AS p, {_words("lower(text)")} AS t FROM documents QUALIFY p <= 3),
w AS (SELECT query_id, p, len(t) AS l, unnest(t) AS term, generate_subscripts(t, 1) AS spot FROM d), tf AS (SELECT query_id, p, l, term, count(*) AS tf, min(spot) AS spot FROM w GROUP BY ALL),
c AS (SELECT query_id, term, count(*) AS df, sum(tf / l::DOUBLE) AS share, min(p * 1000000 + spot) AS spot FROM tf WHERE length(term) >= 4 AND term NOT IN ({', '.join(map(_literal, ranking.FEEDBACK_STOPS))}) AND term NOT IN ('ther', 'tion') GROUP BY ALL),
n AS (SELECT query_id, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT query_id, term, share * ln(n / (df + 1)::DOUBLE + 1) AS s, spot FROM c JOIN n USING (query_id))
SELECT query_id, term, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, spot) AS rank FROM s) WHERE rank <= 5
""")
def prf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 6).alias("query_id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"))
    asked = spark.range(6).select(F.col("id").alias("query_id"), F.lit("ther tion").alias("query"))
    return ranking.feedback_terms(quality.first(hits, 3), asked)


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id < 25), s AS (SELECT query_id, vec_id, round(list_dot_product(q::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine FROM q JOIN embeddings ON vec_id <> query_id)
SELECT query_id, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS k FROM s) WHERE k <= 5
""")
def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id < 25").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    s = e.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(V.cosine(F.col("q"), F.col("embedding")), 6).alias("cosine"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).filter("k <= 5").drop("k")


@query("""
WITH p AS (SELECT a.label, a.vec_id, avg(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS m FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL)
SELECT label, vec_id, round(greatest(coalesce(m, 0), 0), 4) AS agreement_score FROM embeddings LEFT JOIN p USING (label, vec_id)
""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's mean cosine to the others of its label."""
    return grounding.agreement_of_vectors(_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


_SIZES = [(1, 3000), (2, 500), (3, 3000), (5, 3000), (20, 3000)]


@query(f"SELECT n, i AS place, (CASE WHEN n = 1 THEN total ELSE greatest(200, floor(total * (n - i + 1) / (n * (n + 1) / 2)::DOUBLE)) END)::INT AS budget FROM (SELECT n, total, unnest(range(1, n + 1)) AS i FROM {_values(_SIZES, 'n, total')})")
def budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(_SIZES, "n int, total int").withColumn("place", F.explode(F.sequence(F.lit(1), "n")))
    return df.select("n", F.col("place").cast("bigint").alias("place"), compression.budget_of(F.col("place"), F.col("n"), F.col("total")).alias("budget"))


@query(f"""
WITH d AS (SELECT doc_id, text, {_SENTENCES.format(x='text')} AS s FROM documents),
e AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM d), t AS (SELECT doc_id, i, s, {_words('lower(s)')} AS w FROM e),
st AS (SELECT doc_id, count(*) AS n, avg(len(w)) AS a FROM t GROUP BY doc_id), q AS (SELECT unnest(['the', 'and', 'of', 'la', 'der']) AS term),
tf AS (SELECT doc_id, i, term, len(list_filter(w, lambda x : x = term)) AS tf, len(w) AS l FROM t CROSS JOIN q), dfs AS (SELECT doc_id, term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY ALL),
sc AS (SELECT doc_id, i, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / greatest(a, 1)))) AS s FROM tf JOIN dfs USING (doc_id, term) JOIN st USING (doc_id) GROUP BY ALL),
top AS (SELECT doc_id, i FROM (SELECT t.doc_id, t.i, row_number() OVER (PARTITION BY t.doc_id ORDER BY round(coalesce(sc.s, 0), 10) DESC, t.i) AS k FROM t LEFT JOIN sc USING (doc_id, i)) WHERE k <= 10),
picked AS (SELECT t.doc_id, t.i, t.s, len(w) AS l FROM t WHERE (doc_id, i) IN (SELECT doc_id, i FROM top) OR ((doc_id, i - 1) IN (SELECT doc_id, i FROM top) AND regexp_matches(t.s, '^(?i:{'|'.join(T.CONNECTORS)})(?:$|[^\\p{{L}}\\p{{N}}_])'))),
fit AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS c FROM (SELECT *, sum(l) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM picked) WHERE upto <= 60 GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(s) = 0 THEN substr(text, 1, 240) ELSE coalesce(c, s[1]) END AS content FROM d LEFT JOIN fit USING (doc_id)
""")
def compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("q", F.lit("the and of la der"))
    # scores are compared to 10 places, as their sums' last bits depend on the order
    return compression.compressed(docs, "text", "q", F.lit(60), "content").select("doc_id", "content")


_SIGNALS = "SELECT doc_id, (doc_id % 11) / 10::DOUBLE AS r, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS t, (doc_id % 7) / 6::DOUBLE AS d, (doc_id % 5) / 4::DOUBLE AS a, (doc_id % 13) / 12::DOUBLE AS s FROM documents"


@query(f"WITH x AS (SELECT doc_id, least(1, greatest(0, 0.25::DOUBLE * r + 0.2::DOUBLE * t + 0.2::DOUBLE * s + 0.15::DOUBLE * 0.7::DOUBLE + 0.1::DOUBLE * d + 0.1::DOUBLE * a)) AS c FROM ({_SIGNALS})) SELECT doc_id, round(c, 4) AS confidence, CASE WHEN c >= 0.8::DOUBLE THEN 'high' WHEN c >= 0.5::DOUBLE THEN 'medium' WHEN c >= 0.3::DOUBLE THEN 'low' ELSE 'unknown' END AS confidence_level FROM x")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    made = ranking.confidence((i % 11) / 10, F.when(i % 3 == 0, 1.0).when(i % 3 == 1, 0.7).otherwise(0.4), F.lit(0.7), (i % 7) / 6, (i % 5) / 4, (i % 13) / 12)
    return _table(spark, sf_dir, "documents").select("doc_id", made.alias("c")).select("doc_id", "c.*")


@query("SELECT query_id, round(avg(c), 6) AS mean_confidence FROM (SELECT doc_id % 50 AS query_id, (doc_id % 17) / 16::DOUBLE AS c, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS k FROM documents) WHERE k <= 3 GROUP BY query_id HAVING avg(c) < 0.45::DOUBLE")
def retry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("pos"), ((F.col("doc_id") % 17) / 16).alias("confidence"))
    return grounding.weak_queries(hits).withColumn("mean_confidence", F.round("mean_confidence", 6))


ROBOTS = [("a.example", "User-agent: *\nDisallow: /private\nDisallow: /tmp/\n\nUser-agent: other\nDisallow: /"), ("b.example", "User-agent: other\nDisallow: /\nUser-agent: gleaner\nDisallow:\nDisallow: /x"), ("c.example", "Disallow: /all\nUser-agent: *\nAllow: /")]
PATHS = [(0, "https://a.example/private/1"), (1, "https://a.example/Private"), (2, "https://a.example/tmp"), (3, "https://b.example/x/y"), (4, "https://b.example/z"), (5, "https://c.example/all"), (6, "https://d.example/private"), (7, "https://a.example")]


@query(f"""
WITH l AS (SELECT domain, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {_values(ROBOTS, "domain, text")}),
m AS (SELECT domain, i, line, last_value(CASE WHEN lower(line) LIKE 'user-agent:%' THEN trim(split_part(line, ':', 2)) END IGNORE NULLS) OVER (PARTITION BY domain ORDER BY i) AS ua FROM l),
r AS (SELECT domain, trim(split_part(line, ':', 2)) AS rule FROM m WHERE lower(line) LIKE 'disallow:%' AND (ua = '*' OR contains(lower(ua), 'gleaner')))
SELECT id, url FROM (SELECT id, url, regexp_extract(url, '//([^/]*)', 1) AS domain, coalesce(nullif(regexp_extract(url, '//[^/]*(.*)$', 1), ''), '/') AS path FROM {_values(PATHS, "id, url")}) p
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.domain = p.domain AND rule <> '' AND starts_with(path, rule))
""")
def robots_disallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.allowed_pages(spark.createDataFrame(PATHS, "id int, url string"), spark.createDataFrame(ROBOTS, "domain string, text string"))


@query("SELECT page_id, CASE WHEN n >= 500 THEN FALSE WHEN n < 300 THEN TRUE ELSE regexp_matches(html, '(?is)<div\\s[^>]*id\\s*=\\s*[\"''](?:root|app|__next|__nuxt|main-app)[\"'']') END AS needs FROM (SELECT page_id, html, length(html) // 8 AS n FROM pages)")
def js_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", T.needs_rendering(F.expr("substring(html, 1, cast(length(html) div 8 as int))"), F.col("html")).alias("needs"))


@query(f"""
WITH e AS (SELECT item_id % 7 AS query_id, item_id, {_words('text')}[2] AS expected FROM benchmark), h AS (SELECT doc_id % 7 AS query_id, lower(text || ' Document ' || doc_id) AS t, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS k FROM documents)
SELECT item_id AS query_id, coalesce(bool_or(contains(t, lower(expected))), FALSE) AS found FROM e LEFT JOIN h ON e.query_id = h.query_id AND k <= 5 GROUP BY item_id
""")
def answer_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.element_at(T.words(F.col("text")), 2).alias("expected"))
    docs = C.documents_as_corpus(_table(spark, sf_dir, "documents")).withColumn("pool", F.col("doc_id") % 7)
    first = docs.withColumn("k", F.row_number().over(Window.partitionBy("pool").orderBy("doc_id"))).filter("k <= 5")
    hits = items.join(first, F.col("query_id") % 7 == F.col("pool")).select("query_id", F.col("doc_id").alias("pos"), "content", "title")
    return tools.answer_contained(hits, items)


WANTED = [("Python",), ("Scikit Learn ",), ("tomli",), ("left-pad",), ("nothing",), ("both",)]
PYPI = [("tomli", '{"info": {"project_urls": {"Homepage": "https://h.example", "Docs": "https://d.example"}, "home_page": "x"}}'), ("both", '{"info": {"project_urls": null, "home_page": "https://p.example"}}'), ("nothing", "no json")]
NPM = [("left-pad", '{"homepage": "", "repository": {"url": "git://r.example"}}'), ("both", '{"homepage": "https://n.example"}')]


@query(f"""
WITH w AS (SELECT library, replace(lower(trim(library)), ' ', '-') AS k FROM {_values(WANTED, "library")}), kn AS (SELECT * FROM {_values(list(tables.LIBRARIES.items()), "k, u")}),
p AS (SELECT k, coalesce(json_extract_string(b, '$.info.project_urls.Documentation'), json_extract_string(b, '$.info.project_urls.Docs'), json_extract_string(b, '$.info.project_urls.Homepage'), json_extract_string(b, '$.info.home_page')) AS u FROM {_values(PYPI, "k, b")} WHERE json_valid(b)),
n AS (SELECT k, coalesce(nullif(json_extract_string(b, '$.homepage'), ''), json_extract_string(b, '$.repository.url')) AS u FROM {_values(NPM, "k, b")})
SELECT library, coalesce(kn.u, p.u, n.u) AS docs_url FROM w LEFT JOIN kn USING (k) LEFT JOIN p USING (k) LEFT JOIN n USING (k)
""")
def docs_url_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = "library string, body string"
    return tables.resolve_docs(spark.createDataFrame(WANTED, "library string"), tables.libraries(spark), spark.createDataFrame(PYPI, meta), spark.createDataFrame(NPM, meta))


LANDED = [(1, '{"results": [{"url": "", "title": "none"}, {"url": "u1", "title": "t1", "score": 2.5}, {"url": "u2", "engine": "e"}, {"url": "u3"}]}'), (2, "broken"), (3, '{"results": []}')]


@query(f"""SELECT query_id, pos, coalesce(json_extract_string(r, '$.url'), '') AS url, coalesce(json_extract_string(r, '$.title'), '') AS title, coalesce(json_extract_string(r, '$.engine'), 'searxng') AS engine, coalesce(json_extract_string(r, '$.score')::DOUBLE, 0) AS score
FROM (SELECT query_id, unnest(json_extract(b, '$.results[*]')) AS r, generate_subscripts(json_extract(b, '$.results[*]'), 1) - 1 AS pos FROM {_values(LANDED, "query_id, b")} WHERE json_valid(b)) WHERE pos < 3 AND json_extract_string(r, '$.url') <> ''""")
def landed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = tables.landed_search(spark.createDataFrame(LANDED, "query_id int, body string"), most=3)
    return hits.select("query_id", F.col("pos").cast("bigint").alias("pos"), "url", "title", "engine", "score")


RESULT_PAGES = [(1, '<table><tr><td><a class="result-link big" href="https://a.example/1">One <b>hit</b></a><tr><td>About one</td></tr><tr><td><a class="result-link" href="/ad">ad</a></td></tr><tr><td>Bought</td></tr><tr><td><a class="result-link" href="https://b.example/">Two</a></td></tr></table>'), (2, None), (3, "<p>none")]


@query(f"""WITH t AS (SELECT query_id, string_split(html, '<tr>') AS parts FROM {_values(RESULT_PAGES, "query_id, html")} WHERE html IS NOT NULL),
r AS (SELECT query_id, i, regexp_extract(parts[i], '<a class="result-link[^"]*" href="([^"]*)">(.*?)</a>', ['url', 'label']) AS a, coalesce(parts[i + 1], '') AS behind FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM t))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY i) - 1)::INT AS pos, a.url AS url, regexp_replace(a.label, '<[^>]*>', '', 'g') AS title, regexp_replace(behind, '<[^>]*>', '', 'g') AS content FROM r WHERE a.url <> '' AND a.url NOT LIKE '/%'""")
def landed_result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.landed_result_pages(spark.createDataFrame(RESULT_PAGES, "query_id int, html string")).drop("engine", "score")


@query("""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS i FROM pages),
l AS (SELECT page_id, url, i, regexp_extract(url, '^[a-z]+://[^/?#]*') || trim(replace(replace(h, '&amp;', '&'), '&#x27;', '''')) AS link FROM a WHERE trim(h) LIKE '/%'),
o AS (SELECT *, row_number() OVER (PARTITION BY url, regexp_replace(link, '/+$', '') ORDER BY i) AS k FROM l)
SELECT url, link, row_number() OVER (PARTITION BY url ORDER BY i) - 1 AS ord FROM o WHERE k = 1 QUALIFY ord < 50
""")
def links_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.map_urls(_table(spark, sf_dir, "pages")).select("url", "link", F.col("ord").cast("bigint").alias("ord"))


SITE = [(f"https://s.example/{i}", f"<title>p{i}</title><p>text of page {i} " + ("skip" if i == 5 else "keep") + "</p>" + "".join(f'<a href="/{j}">{j}</a>' for j in t) + '<a href="https://other.example/">o</a>') for i, t in enumerate([(1, 2, 9), (3, 0, 2), (4, 5), (6,), (6, 7), (8,), (0, 7), (), (1,)])]
_EDGES = [(int(u.rsplit("/", 1)[1]), int(j)) for u, h in SITE for j in __import__("re").findall(r'href="/(\d+)"', h)]


@query(f"""
WITH RECURSIVE e AS (SELECT * FROM {_values(_EDGES, "src, dst")}), w AS (SELECT 0 AS n, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN e ON src = n WHERE depth < 3 AND n <> 5 AND n < 9)
SELECT 'https://s.example/' || n AS url, min(depth) AS depth FROM w WHERE n <> 5 AND n < 9 GROUP BY n
""")
def crawl_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame(SITE, "url string, html string")
    return links.crawl(pages, spark.createDataFrame([("https://s.example/0",)], "url string"), 20, 3, "KEEP").select("url", "depth")


ATTEMPTS = [(s, float(t), ok) for s, log in (("a", [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1), (7, 0)]), ("b", [(i * 10, 0) for i in range(7)] + [(200, 0), (205, 0), (206, 1), (207, 0)])) for t, k in log for ok in (bool(k),)]


@query(f"""
WITH v AS (SELECT service, seconds, ok FROM {_values(ATTEMPTS, "service, seconds, ok")}),
a AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY service ORDER BY seconds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r, max(CASE WHEN NOT ok THEN seconds END) OVER (PARTITION BY service ORDER BY seconds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM v),
f AS (SELECT *, coalesce(sum((NOT ok)::INT) OVER (PARTITION BY service, r ORDER BY seconds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM a)
SELECT service, seconds AS "at", ok, coalesce(n >= 5 AND seconds - l <= 60, FALSE) AS open FROM f
""")
def breaker_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resilience.breaker_states(spark.createDataFrame(ATTEMPTS, "service string, at double, ok boolean"))


@query("SELECT count(*) AS total, count(*) FILTER (item_id % 3 = 0) AS correct, round(count(*) FILTER (item_id % 3 = 0) / count(*)::DOUBLE, 4) AS accuracy, round(sum(length(text) / 100::DOUBLE), 4) AS total_seconds, round(avg(length(text) / 100::DOUBLE), 4) AS mean_seconds, count(*) FILTER (item_id % 4 = 0) AS empty FROM benchmark")
def benchmark_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"), (F.col("item_id") % 3 == 0).alias("found"), (F.col("item_id") % 4).alias("result_count"), (F.length("text") / 100).alias("seconds"))
    return tools.accuracy(b)
