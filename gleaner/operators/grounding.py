"""Grounding: contradiction markers, agreement across sources, semantic scores, confidence and claim summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.operators.ranking import confidence

Embedder = Callable[[Column], Column]
SNIPPET = 300


def detect_contradictions(hits: DataFrame, content: str = "content") -> DataFrame:
    """Two marks by vocabulary alone; the claim's own polarity is not compared."""
    return hits.withColumn("has_contradiction_markers", T.has_negation(F.col(content))).withColumn("has_temporal_change", T.has_temporal_change(F.col(content)))


def agreement_of_vectors(rows: DataFrame, group: str, ident: str, vector: str) -> DataFrame:
    """(group, ident, agreement_score): the mean cosine of each vector of length 1 to the others of its group, 0 at least, to 4 places.

    A mean of dot products is a dot product with the sum of vectors: the work grows with the rows and not with their pairs. Null vectors
    score 0 and take no part.
    """
    some = rows.filter(F.col(vector).isNotNull()).select(group, ident, vector)
    sums = some.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("x")).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    total = sums.select(group, F.transform("s", lambda s: s["x"]).alias("total"))
    size = some.groupBy(group).agg(F.count("*").alias("n"))
    mean = (V.dot(F.col(vector), F.col("total")) - V.dot(F.col(vector), F.col(vector))) / (F.col("n") - 1)
    value = F.when(F.col(vector).isNull() | (F.col("n") < 2), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), mean), 4))
    return rows.select(group, ident, vector).join(total, group, "left").join(size, group, "left").select(group, ident, F.coalesce(value, F.lit(0.0)).alias("agreement_score"))


def cross_source_agreement(hits: DataFrame, embed: Embedder = V.hashed_embedding, content: str = "content") -> DataFrame:
    """Hits with agreement_score, by the embeddings of the first 300 characters; blank ones score 0."""
    head = F.substring(F.coalesce(F.col(content), F.lit("")), 1, SNIPPET)
    vectors = hits.select("query_id", "pos", F.when(T.strip(head) != "", head).alias("head")).withColumn("v", F.when(F.col("head").isNotNull(), embed(F.coalesce("head", F.lit("")))))
    return hits.join(agreement_of_vectors(vectors, "query_id", "pos", "v").select("query_id", "pos", "agreement_score"), ["query_id", "pos"])


def semantic_score(hits: DataFrame, queries: DataFrame, embed: Embedder = V.hashed_embedding) -> DataFrame:
    """Hits with semantic_score: the cosine of query and best snippet, 0 at least, to 4 places; order stays. Vectors may be of any length.

    A content of up to 3 sentences is its own snippet (500 characters); else the sentence of the first 20 that is nearest to the query,
    with its neighbours. Of sentences that are equally near to 10 places, as the last bits depend on the order of sums, the first.
    """
    near_to = lambda text: T.let(embed(text), lambda v: F.coalesce(V.dot(v, F.col("_q")) / F.nullif(F.sqrt(V.dot(v, v)) * F.col("_l"), F.lit(0.0)), F.lit(0.0)))
    asked = queries.select("query_id", embed(F.col("query")).alias("_q")).withColumn("_l", F.sqrt(V.dot(F.col("_q"), F.col("_q"))))
    rows = hits.join(asked, "query_id").withColumn("_s", T.split_sentences(F.coalesce(F.col("content"), F.lit(""))))
    short = F.substring(F.coalesce(F.col("content"), F.lit("")), 1, 500)
    long = rows.filter(F.size("_s") > 3).select("query_id", "pos", "_q", "_l", F.posexplode(F.slice("_s", 1, 20)).alias("i", "s"))
    near = long.withColumn("sim", F.round(near_to(F.col("s")), 10)).groupBy("query_id", "pos").agg(F.max_by("i", F.struct("sim", -F.col("i"))).alias("_best"))
    chosen = rows.join(near, ["query_id", "pos"], "left")
    around = F.array_join(F.slice("_s", F.greatest(F.col("_best"), F.lit(1)), F.when(F.col("_best") > 0, 3).otherwise(2)), " ")
    snippet = F.when(F.col("_best").isNull(), short).otherwise(around)
    score = F.when(T.strip(snippet) == "", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), near_to(snippet)), 4))
    return chosen.withColumn("semantic_score", score).drop("_q", "_l", "_s", "_best")


def signals(hits: DataFrame, content: str = "content") -> DataFrame:
    """Hits with info_density and claim_density."""
    c = F.coalesce(F.col(content), F.lit(""))
    return hits.withColumn("info_density", F.round(T.information_density(c), 4)).withColumn("claim_density", T.claim_density(c))


def with_confidence(hits: DataFrame, queries: DataFrame, semantic: bool = True) -> DataFrame:
    """Hits with confidence and confidence_level; the query sets the weights."""
    weights = queries.select("query_id", T.confidence_weights(F.col("query")).alias("_w"))
    rows = hits.join(weights, "query_id")
    get = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in hits.columns else F.lit(default)
    made = confidence(F.least(get("bm25_score", 0.0) / 10.0, F.lit(1.0)), get("tier_score", 0.4), F.lit(0.7), get("info_density", 0.5), get("agreement_score", 0.0), get("semantic_score", 0.0) if semantic else F.lit(0.0), F.col("_w"))
    return rows.withColumn("_c", made).withColumn("confidence", F.col("_c.confidence")).withColumn("confidence_level", F.col("_c.confidence_level")).drop("_c", "_w")


def enrich(hits: DataFrame, queries: DataFrame, embed: Embedder = V.hashed_embedding) -> DataFrame:
    """Markers and agreement by content, densities by full_content where there is one, and confidence without a semantic score."""
    rows = cross_source_agreement(detect_contradictions(hits.drop("agreement_score", "confidence", "confidence_level")), embed)
    whole = F.coalesce("full_content", "content") if "full_content" in rows.columns else F.col("content")
    return with_confidence(signals(rows.withColumn("_whole", whole), "_whole").drop("_whole"), queries, semantic=False)


def claim_summary(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for each claim (query_id, query): counts of sources, and the confidence of the means of their signals."""
    c = F.coalesce(F.col("content"), F.lit(""))
    means = hits.groupBy("query_id").agg(
        F.count("*").alias("sources_checked"),
        F.count_if(~F.coalesce(F.col("has_contradiction_markers"), F.lit(False))).alias("sources_supporting"),
        F.least(F.min_by("bm25_score", "pos") / 10.0, F.lit(1.0)).alias("relevance"),
        F.avg(F.coalesce(F.col("tier_score"), F.lit(0.4))).alias("tier"),
        F.avg(T.information_density(c)).alias("density"),
        F.avg(F.coalesce(F.col("agreement_score"), F.lit(0.0))).alias("agreement"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    made = confidence(zero("relevance"), zero("tier"), F.lit(0.7), zero("density"), zero("agreement"), F.lit(0.0))
    out = claims.join(means, "query_id", "left").withColumn("_c", made)
    return out.select("query_id", F.col("query").alias("claim"), T.has_negation(F.col("query")).alias("has_negation_markers"), T.count_claims(F.col("query")).alias("verifiable_claims"), F.coalesce("sources_checked", F.lit(0)).alias("sources_checked"), F.coalesce("sources_supporting", F.lit(0)).alias("sources_supporting"), F.col("_c.confidence").alias("overall_confidence"), F.col("_c.confidence_level").alias("confidence_level"))


def weak_queries(hits: DataFrame, least: float = 0.45, top: int = 3) -> DataFrame:
    """(query_id, mean_confidence) of queries whose first hits have a low mean confidence."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return hits.withColumn("_n", place).filter(F.col("_n") <= top).groupBy("query_id").agg(F.avg("confidence").alias("mean_confidence")).filter(F.col("mean_confidence") < least)
