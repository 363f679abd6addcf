"""Retrieval from a corpus (doc_id, url, title, content): what a search engine does for the tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.session import kept, sized


def documents_as_corpus(docs: DataFrame) -> DataFrame:
    """Documents with a made-up URL and title."""
    return docs.select("doc_id", F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"))


def met_terms(corpus: DataFrame, text: str, wanted: DataFrame, most: int = 10_000) -> DataFrame:
    """(doc_id, length, m) of every document (doc_id, text): its number of terms, and (term, tf) of the wanted ones (term) that it holds.

    Up to ``most`` wanted terms are looked up within the row, in one scan without an exchange. With more, each document's counts of terms are
    shuffled to meet them.
    """
    found = [r.term for r in wanted.select("term").filter("term is not null").distinct().limit(most + 1).collect()]
    terms = corpus.select("doc_id", T.terms(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    if len(found) <= most:
        count = lambda h: F.transform(F.array_distinct(h), lambda x: F.struct(x.alias("term"), T.count_of(h, x).alias("tf")))
        return terms.select("doc_id", F.size("t").alias("length"), T.let(F.filter("t", lambda x: x.isin(found)), count).alias("m"))
    tf = terms.select("doc_id", F.explode("t").alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf")).join(wanted.select("term").distinct(), "term")
    by_doc = tf.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("m"))
    return terms.select("doc_id", F.size("t").alias("length")).join(by_doc, "doc_id", "left").select("doc_id", "length", F.coalesce("m", F.array().cast("array<struct<term:string,tf:int>>")).alias("m"))


def retrieve(queries: DataFrame, corpus: DataFrame, query: str = "query", most: int = 40) -> DataFrame:
    """Hits of each query (query_id, a limit in column ``wanted``): documents that hold a term of it.

    Order: how many different terms a document holds, then how often, then doc_id. One scan finds the hits, which are kept; a second one
    fetches their contents alone.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col(query)))).alias("term"))
    # the plain explode would have its input tested, and so computed, twice
    tf = met_terms(corpus, "content", asked).select("doc_id", F.explode_outer("m").alias("m")).select("doc_id", "m.*").filter("term is not null")
    scored = tf.join(sized(asked), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("held"), F.sum("tf").alias("tf"))
    order = Window.partitionBy("query_id").orderBy(F.desc("held"), F.desc("tf"), "doc_id")
    best = scored.withColumn("pos", F.row_number().over(order) - 1).filter(F.col("pos") < most).join(sized(queries.select("query_id", "wanted")), "query_id").filter(F.col("pos") < F.col("wanted"))
    best = kept(best.select("query_id", "doc_id", "pos", "held"))
    return corpus.join(sized(best), "doc_id").select("query_id", "pos", "url", "title", "content", F.lit("corpus").alias("engine"), F.col("held").cast("double").alias("score"))
