"""Extractive compression of contents to word budgets, as expressions within a row: nothing is shuffled but a count of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T

_CONNECTOR = rf"(?iu)^(?:{'|'.join(T.CONNECTORS)})\b"


def budget_of(place: Column, n: Column, total: Column, least: int = 200) -> Column:
    """The budget of the place-th of n results, from 1, falling linearly; a lone one has all. The least one may lift the sum."""
    share = F.floor(total * (n - place + 1) / (n * (n + 1) / 2)).cast("int")
    return F.when(n == 1, total.cast("int")).otherwise(F.greatest(F.lit(least), share))


def compressed(df: DataFrame, text: str, query: str, budget: Column, out: str, most: int = 10) -> DataFrame:
    """``df`` with column ``out``: the sentences of ``text`` that tell most about ``query``, in order, within a budget of words.

    BM25 over the text's own sentences picks ``most`` of them; the next sentence joins if it begins with a connector; sentences are
    taken until the first that would overflow. If none fits, the first sentence; without sentences, 4 characters a word of budget.
    """
    state = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("parts"))

    def kept(sentences: Column, limit: Column) -> Column:
        def take(a: Column, x: Column) -> Column:
            n = a["n"] + F.size(T.words(x))
            over = a["full"] | (n > limit)
            return F.struct(F.when(over, a["n"]).otherwise(n).alias("n"), over.alias("full"), F.when(over, a["parts"]).otherwise(F.array_append(a["parts"], x)).alias("parts"))

        return F.aggregate(sentences, state, take)["parts"]

    def scored(terms: Column, asked: Column) -> Column:
        """(k, i) of each sentence, the best first; k is the score, below 0, to 10 places, as the sums' last bits would decide between equals."""
        n, mean = F.size(terms), F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.size(t)) / F.greatest(F.size(terms), F.lit(1)), F.lit(1.0))
        held = lambda q: F.size(F.filter(terms, lambda t: F.array_contains(t, q)))
        weights = F.transform(asked, lambda q: T.let(held(q), lambda df_: F.struct(q.alias("q"), F.log((n - df_ + 0.5) / (df_ + 0.5) + 1.0).alias("w"))))

        def score(t: Column, c: Column) -> Column:
            norm = F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * F.size(t) / c["mean"])
            met = F.transform(c["weights"], lambda q: F.struct(q["w"].alias("w"), T.count_of(t, q["q"]).alias("tf")))
            return F.aggregate(met, F.lit(0.0), lambda a, x: a + x["w"] * (x["tf"] * F.lit(2.2) / (x["tf"] + norm)))

        return T.let(F.struct(mean.alias("mean"), weights.alias("weights")), lambda c: F.array_sort(F.transform(terms, lambda t, i: F.struct((-F.round(score(t, c), 10)).alias("k"), i.alias("i")))))

    def picked(sentences: Column, top: Column) -> Column:
        joins = lambda s, i: F.array_contains(top, i) | (F.array_contains(top, i - 1) & s.rlike(_CONNECTOR))
        return F.filter(sentences, joins)

    def best(r: Column) -> Column:
        """The kept sentences of a row (s: sentences, t: their terms, q: the query's terms, n: the budget)."""
        order = scored(r["t"], r["q"])
        top = F.transform(F.slice(order, 1, most), lambda o: o["i"])
        return T.let(top, lambda i: kept(picked(r["s"], i), r["n"]))

    step = df.withColumn("_s", T.split_sentences(F.coalesce(F.col(text), F.lit("")))).withColumn("_n", budget)
    row = F.struct(F.col("_s").alias("s"), F.transform("_s", T.terms).alias("t"), T.terms(F.col(query)).alias("q"), F.col("_n").alias("n"))
    step = step.withColumn("_parts", T.let(row, best))
    value = F.when(F.size("_s") == 0, F.substring(F.col(text), F.lit(1), F.col("_n") * 4)).when(F.size("_parts") > 0, F.array_join("_parts", " ")).otherwise(F.element_at("_s", 1))
    return step.withColumn(out, value).drop("_s", "_n", "_parts")


def compress_results(hits: DataFrame, queries: DataFrame, total: int | str = 3000) -> DataFrame:
    """Hits with contents compressed to their budgets; blank contents stay and take a budget too.

    ``total``: a number of words, or the name of a column of ``queries``.
    """
    asked = queries.select("query_id", F.col("query").alias("_asked"), (F.col(total) if isinstance(total, str) else F.lit(total)).alias("_total"))
    every = Window.partitionBy("query_id")
    place = F.row_number().over(every.orderBy("pos"))
    rows = hits.join(asked, "query_id").withColumn("_n", F.count("*").over(every)).withColumn("_place", place)
    done = compressed(rows, "content", "_asked", budget_of(F.col("_place"), F.col("_n"), F.col("_total")), "_content")
    return done.withColumn("content", F.when(F.coalesce(F.col("content"), F.lit("")) == "", F.col("content")).otherwise(F.col("_content"))).drop("_content", "_asked", "_total", "_n", "_place")
