"""BM25, reciprocal rank fusion, relevance feedback, information density and confidence.

Hits are rows (query_id, pos, url, title, content, ...). Order is always by an explicit ``pos``; ranking gives a new one, from 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.session import kept, sized
from gleaner.sources.corpus import met_terms

BM25_PARAMETERS = {"code": (0.9, 0.50), "academic": (1.5, 0.85), "navigational": (1.0, 0.60), "informational": (1.2, 0.75)}
RRF_K = 60
FEEDBACK_STOPS = sorted("about after also been before being between como con cuando desde does donde each entre este esta from have into just like more most only other over para pero porque same should sobre some such than that their them then there these they this those through very were what when where which while will with would your".split())


def parameter(intent: Column, k: int) -> Column:
    """k1 (0) or b (1) of an intent; unknown and null ones count as informational."""
    out = F
    for name, values in BM25_PARAMETERS.items():
        if name != "informational":
            out = out.when(intent == name, F.lit(values[k]))
    return out.otherwise(F.lit(BM25_PARAMETERS["informational"][k]))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def saturation(tf: Column, length: Column, average: Column, k1: Column, b: Column) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (F.lit(1.0) - b + b * length / F.greatest(average, F.lit(1.0))))


def bm25_scores(hits: DataFrame, queries: DataFrame, content: str = "content") -> DataFrame:
    """(query_id, pos, bm25_score) of hits having a query term, by the statistics of their own query's hits.

    ``queries``: query_id, query, intent. Repeated query terms count each time. Each hit is looked through for its query's
    terms alone, so what is shuffled is a row for each hit and term met, never the contents.
    """
    asked = queries.select("query_id", "intent", T.terms(F.col("query")).alias("a")).select("query_id", "intent", F.transform(F.array_distinct("a"), lambda t: F.struct(t.alias("term"), T.count_of(F.col("a"), t).alias("times"))).alias("q"))
    counted = hits.select("query_id", "pos", T.terms(F.coalesce(F.col(content), F.lit(""))).alias("t"))
    # the pool's size and mean length take every hit; terms only those that they occur in
    pool = counted.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("average"))
    met = counted.join(sized(asked), "query_id").select("query_id", "pos", "intent", F.size("t").alias("length"), F.explode(F.transform("q", lambda q: F.struct(q["term"].alias("term"), q["times"].alias("times"), T.count_of(F.col("t"), q["term"]).alias("tf")))).alias("m"))
    met = met.filter("m.tf > 0").select("query_id", "pos", "intent", "length", "m.*")
    df = met.join(met.groupBy("query_id", "term").agg(F.count("*").alias("df")), ["query_id", "term"]).join(pool, "query_id")
    part = F.col("times") * idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("length"), F.col("average"), parameter(F.col("intent"), 0), parameter(F.col("intent"), 1))
    return df.groupBy("query_id", "pos").agg(F.sum(part).alias("bm25_score"))


def bm25_rank(hits: DataFrame, queries: DataFrame, content: str = "content") -> DataFrame:
    """Hits with bm25_score, to 4 places, and the new pos by falling score; equal scores keep their order."""
    scored = hits.join(bm25_scores(hits, queries, content), ["query_id", "pos"], "left").withColumn("bm25_score", F.round(F.coalesce("bm25_score", F.lit(0.0)), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25_score"), "pos")
    return scored.withColumn("pos", F.row_number().over(order) - 1)


def corpus_bm25(queries: DataFrame, corpus: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, doc_id, bm25_score, rank) of each query's best documents, by the statistics of the whole corpus (doc_id, text).

    One scan of the corpus reduces each document to its length and the query terms that it holds, in a reliable checkpoint; what is
    shuffled are these counts, never tokens or texts.
    """
    asked = queries.select("query_id", "intent", F.explode(T.terms(F.col("query"))).alias("term")).groupBy("query_id", "intent", "term").agg(F.count("*").alias("times"))
    held = kept(met_terms(corpus, "text", asked.select("term")))
    pool = held.agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    tf = held.select("doc_id", "length", F.explode("m").alias("m")).select("doc_id", "length", "m.*")
    terms = asked.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term").crossJoin(F.broadcast(pool))  # the pool is one row
    part = F.col("times") * idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("length"), F.col("average"), parameter(F.col("intent"), 0), parameter(F.col("intent"), 1))
    scored = tf.join(sized(terms), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 4).alias("bm25_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25_score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def rrf_fuse(rankings: list[DataFrame], weights: list[float] | None = None, key: str = "url") -> DataFrame:
    """Rankings of hits fused by weighted reciprocal ranks, by query and key.

    Rankings beyond the weights are left out. The columns of a key's first row stay (by ranking, then place). Missing keys count as one, ''.
    The score is given to 4 places, and the order is that of the exact one, then of first appearance.
    """
    weights = [1.0] * len(rankings) if weights is None else weights
    marked = [r.withColumn("_list", F.lit(i)).withColumn("_weight", F.lit(float(w))) for i, (r, w) in enumerate(zip(rankings, weights, strict=False))]
    return fuse_marked(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked), key)


def fuse_marked(rows: DataFrame, key: str = "url") -> DataFrame:
    """As rrf_fuse, for hits marked with their ranking (_list) and its weight (_weight)."""
    place = F.row_number().over(Window.partitionBy("query_id", "_list").orderBy("pos"))
    columns = [c for c in rows.columns if c not in ("_list", "_weight", "rrf_score", "query_id")]
    ranked = rows.withColumn("_rank", place).withColumn("_key", F.coalesce(F.col(key), F.lit("")))
    at = F.struct("_list", "_rank")
    fused = ranked.groupBy("query_id", "_key").agg(F.sum(F.col("_weight") / (RRF_K + F.col("_rank"))).alias("_score"), F.min(at).alias("_at"), F.min_by(F.struct(*columns), at).alias("_row"))
    order = Window.partitionBy("query_id").orderBy(F.desc("_score"), "_at")
    return fused.select("query_id", "_row.*", F.round("_score", 4).alias("rrf_score"), (F.row_number().over(order) - 1).alias("_pos")).drop("pos").withColumnRenamed("_pos", "pos")


def decay(i: Column) -> Column:
    """Weight of the i-th sub-query, from 0."""
    return F.lit(1.0) / (F.lit(1.0) + F.lit(0.2) * i)


def feedback_terms(docs: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, term, score, rank): the best expansion terms of each query's documents (query_id, pos, content).

    A term's score adds, over documents, its share of the words times ln(N / (df + 1) + 1). Query terms, stopwords and terms under
    4 characters are left out. Equal scores go by first appearance.
    """
    split = docs.select("query_id", "pos", T.terms(F.coalesce(F.col("content"), F.lit(""))).alias("t"))
    n = docs.groupBy("query_id").agg(F.count("*").alias("n"))
    tf = split.select("query_id", "pos", F.size("t").alias("length"), F.posexplode("t").alias("at", "term")).groupBy("query_id", "pos", "length", "term").agg(F.count("*").alias("tf"), F.min("at").alias("at"))
    tf = tf.filter((F.length("term") >= 4) & ~F.col("term").isin(FEEDBACK_STOPS)).join(queries.select("query_id", F.explode(T.terms(F.col("query"))).alias("term")).distinct(), ["query_id", "term"], "left_anti")
    by_term = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"), F.sum(F.col("tf") / F.col("length")).alias("share"), F.min(F.struct("pos", "at")).alias("at"))
    scored = by_term.join(n, "query_id").withColumn("score", F.col("share") * F.log(F.col("n") / (F.col("df") + 1) + 1.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "at")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "term", F.round("score", 6).alias("score"), "rank")


def density(corpus: DataFrame) -> DataFrame:
    """(doc_id, info_density), to 4 places; nothing is shuffled."""
    return corpus.select("doc_id", F.round(T.information_density(F.coalesce("text", F.lit(""))), 4).alias("info_density"))


def confidence(relevance: Column, tier: Column, freshness: Column, density: Column, agreement: Column, semantic: Column, weights: Column | None = None) -> Column:
    """struct(confidence, confidence_level): the weighted sum of six signals, to 4 places, and its level by the exact sum."""
    w = weights if weights is not None else F.struct(F.lit(0.25).alias("w_content"), F.lit(0.20).alias("w_tier"), F.lit(0.15).alias("w_freshness"))
    total = w["w_content"] * relevance + w["w_tier"] * tier + F.lit(0.20) * semantic + w["w_freshness"] * freshness + F.lit(0.10) * density + F.lit(0.10) * agreement
    total = F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))
    level = F.when(total >= 0.8, "high").when(total >= 0.5, "medium").when(total >= 0.3, "low").otherwise("unknown")
    return F.struct(F.round(total, 4).alias("confidence"), level.alias("confidence_level"))
