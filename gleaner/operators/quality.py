"""URL quality: blacklist, first of each canonical URL, tiers, and limits by domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import urls as U


def deduplicate(hits: DataFrame, url: str = "url") -> DataFrame:
    """The first hit, by pos, of each query and canonical URL. Hits without a URL stay, each."""
    canonical = U.normalize_url(F.col(url))
    order = Window.partitionBy("query_id", canonical).orderBy("pos")
    blank = F.coalesce(F.col(url), F.lit("")) == ""
    return hits.withColumn("_n", F.row_number().over(order)).filter((F.col("_n") == 1) | blank).drop("_n")


def filter_and_classify(hits: DataFrame, blacklist: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Hits off the blacklist, deduplicated, with source_tier and tier_score."""
    kept = deduplicate(hits.filter(~F.coalesce(U.is_blacklisted(F.col("url"), blacklist, strict), F.lit(False))))
    tier = F.coalesce(U.source_tier(F.col("url"), strict), F.lit(3))
    return kept.withColumn("source_tier", tier).withColumn("tier_score", U.tier_score(F.col("source_tier")))


def diversify(hits: DataFrame, most: int = 2) -> DataFrame:
    """Of each query and domain the first ``most`` hits, one more if the domain is of tier 1; pos is given anew."""
    order = Window.partitionBy("query_id", U.netloc(F.coalesce(F.col("url"), F.lit("")))).orderBy("pos")
    limit = F.lit(most) + (F.coalesce(F.col("source_tier"), F.lit(3)) == 1).cast("int")
    # the literal bound lets the plan stop early in each partition; the exact one follows
    kept = hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most + 1).filter(F.col("_n") <= limit).drop("_n")
    return renumbered(kept)


def renumbered(hits: DataFrame) -> DataFrame:
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) - 1)


def first(hits: DataFrame, n: int) -> DataFrame:
    """The first n hits of each query."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("_n") <= n).drop("_n")
