"""The tools as DataFrame plans: each answers all rows of a request table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.functions import vectors as V
from gleaner.operators import compression, grounding, links, quality, ranking
from gleaner.operators.grounding import Embedder
from gleaner.session import kept
from gleaner.sources import corpus as C
from gleaner.sources import tables

DEPTHS = {"quick": (8, 2), "standard": (12, 4), "deep": (20, 7)}


def _limit(name: str, default: int, most: int, columns: list[str]):
    return F.greatest(F.lit(1), F.least(F.coalesce(F.col(name), F.lit(default)), F.lit(most))) if name in columns else F.lit(default)


def prepared(requests: DataFrame, text: str = "raw_query") -> DataFrame:
    """Requests with the normalized query, its intent and its expansion by synonyms."""
    q = requests.withColumn("query", T.normalize_query(F.coalesce(F.col(text), F.lit("")))).withColumn("intent", T.detect_intent(F.col("query")))
    # a small table that most steps meet again
    return kept(q.withColumn("expanded", T.expand_query(F.col("query"), tables.synonym_map())))


def search(requests: DataFrame, corpus: DataFrame, embed: Embedder = V.hashed_embedding) -> DataFrame:
    """Ranked, grounded and compressed hits of requests (query_id, raw_query, max_results?).

    Twice as many hits as wanted are fetched by the expanded query; rank goes by BM25 of the normalized one, then the limit by domain.
    """
    q = prepared(requests).withColumn("max_results", _limit("max_results", 10, 20, requests.columns)).withColumn("wanted", F.col("max_results") * 2)
    hits = C.retrieve(q, corpus, "expanded", 40)
    hits = kept(ranking.bm25_rank(quality.filter_and_classify(hits), q))
    hits = grounding.signals(grounding.detect_contradictions(grounding.semantic_score(hits, q, embed)))
    hits = quality.diversify(grounding.with_confidence(grounding.cross_source_agreement(hits, embed), q))
    hits = hits.filter(F.col("pos") < 20).join(q.select("query_id", "max_results"), "query_id").filter(F.col("pos") < F.col("max_results")).drop("max_results")
    return compression.compress_results(hits, q, 3000)


def _ranked(sub: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits of sub-queries (query_id, i, query, intent, wanted), ranked each, then fused by query with decaying weights."""
    keyed = sub.withColumn("parent", F.col("query_id")).withColumn("query_id", F.struct("query_id", "i"))
    hits = ranking.bm25_rank(quality.filter_and_classify(C.retrieve(keyed, corpus, "query", 20)), keyed)
    marked = hits.withColumn("_list", F.col("query_id.i")).withColumn("query_id", F.col("query_id.query_id")).withColumn("_weight", ranking.decay(F.col("_list")))
    lone = sub.groupBy("query_id").agg(F.count("*").alias("_many"))
    fused = ranking.fuse_marked(marked)
    # a lone ranking is not fused: it has no rrf_score
    return fused.join(lone, "query_id").withColumn("rrf_score", F.when(F.col("_many") > 1, F.col("rrf_score"))).drop("_many")


def deep_scrape(hits: DataFrame, pages: DataFrame | None, top: DataFrame) -> DataFrame:
    """Hits with full_content: the text of the stored page (url, html), for the first hits of each query (top: query_id, scrape_top)."""
    if pages is None:
        return hits.withColumn("full_content", F.lit(None).cast("string"))
    texts = pages.select(F.col("url").alias("_url"), H.extracted(F.col("html"))["content"].alias("_text")).dropDuplicates(["_url"])
    rows = hits.join(top, "query_id").join(texts, (F.col("url") == F.col("_url")) & (F.col("pos") < F.col("scrape_top")), "left")
    return rows.withColumn("full_content", F.nullif(F.col("_text"), F.lit(""))).drop("_url", "_text", "scrape_top")


def research(requests: DataFrame, corpus: DataFrame, pages: DataFrame | None = None, embed: Embedder = V.hashed_embedding) -> DataFrame:
    """Hits of requests (query_id, raw_query, depth?, max_tokens?): sub-queries fused, enriched, retried with feedback terms where weak.

    ``result_count`` counts all rows compressed; the rows are cut to the depth's number after that.
    """
    depth = F.coalesce(F.col("depth"), F.lit("standard")) if "depth" in requests.columns else F.lit("standard")
    number = lambda k: F.when(depth == "quick", DEPTHS["quick"][k]).when(depth == "deep", DEPTHS["deep"][k]).otherwise(DEPTHS["standard"][k])
    budget = F.coalesce(F.col("max_tokens"), F.lit(3000)) if "max_tokens" in requests.columns else F.lit(3000)
    q = prepared(requests).withColumn("wanted", number(0)).withColumn("scrape_top", number(1)).withColumn("budget", budget)
    parts = q.select("query_id", "intent", "wanted", F.posexplode(T.decompose_query(F.col("query"))).alias("i", "query"))
    # some dozen hits a query: cheap to keep, dear to find again for each of the branches below
    found = kept(_ranked(parts, corpus))
    hits = kept(grounding.enrich(deep_scrape(found, pages, q.select("query_id", "scrape_top")), q, embed))
    weak = kept(grounding.weak_queries(hits).select("query_id"))
    again = q.join(weak, "query_id", "left_semi")
    words = ranking.feedback_terms(quality.first(hits, 3).join(weak, "query_id", "left_semi"), again)
    added = words.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("t"))
    retry = again.join(added, "query_id", "left").select("query_id", F.lit(0).alias("i"), "intent", "wanted", F.when(F.col("t").isNotNull(), F.concat_ws(" ", "query", F.array_join("t", " "))).otherwise(F.col("query")).alias("query"))
    again_found = kept(_ranked(retry, corpus).withColumn("full_content", F.lit(None).cast("string")))
    second = grounding.enrich(again_found, q, embed)
    both = kept(ranking.rrf_fuse([hits.join(weak, "query_id", "left_semi"), second], [2.0, 1.0]))
    final = hits.join(weak, "query_id", "left_anti").unionByName(grounding.enrich(both, q, embed), allowMissingColumns=True)
    final = compression.compress_results(quality.diversify(final), q, "budget").drop("full_content")
    counted = final.withColumn("result_count", F.count("*").over(Window.partitionBy("query_id")))
    return counted.join(q.select("query_id", "wanted"), "query_id").filter(F.col("pos") < F.col("wanted")).drop("wanted")


def validate(claims: DataFrame, corpus: DataFrame, embed: Embedder = V.hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """(summary of each claim, its sources) of requests (query_id, claim, max_sources?). Grounding sees the cut list alone."""
    q = claims.withColumn("query", F.coalesce(F.col("claim"), F.lit(""))).withColumn("intent", F.lit("informational")).withColumn("sources", _limit("max_sources", 5, 10, claims.columns)).withColumn("wanted", F.col("sources") * 2)
    hits = ranking.bm25_rank(quality.filter_and_classify(C.retrieve(q, corpus, "query", 20)), q)
    hits = kept(hits.filter(F.col("pos") < 10).join(q.select("query_id", "sources"), "query_id").filter(F.col("pos") < F.col("sources")).drop("sources"))
    hits = grounding.cross_source_agreement(grounding.detect_contradictions(hits), embed)
    sources = hits.select("query_id", "pos", "url", "title", "source_tier", F.col("has_contradiction_markers").alias("has_contradictions"), F.col("agreement_score").alias("agreement"))
    return grounding.claim_summary(q.select("query_id", "query"), hits), sources


def scrape(pages: DataFrame, robots: DataFrame | None = None, max_tokens: int = 2000) -> DataFrame:
    """(url, title, content, markdown, status, token_count) of stored pages (url, html, content_type?), compressed by the URL's own words.

    Pages that robots rules forbid, or whose URL names no public host, are ``blocked``; those without html are ``error``. What is not HTML
    keeps its first 2,000 characters.
    """
    ok = U.is_public_literal(F.col("url"))
    rows = pages.withColumn("_ok", ok)
    if robots is not None:
        allowed = links.allowed_pages(rows.filter("_ok"), robots).select(F.col("url").alias("_u")).distinct()
        rows = rows.join(allowed, F.col("url") == F.col("_u"), "left").withColumn("_ok", F.col("_ok") & F.col("_u").isNotNull()).drop("_u")
    kind = F.coalesce(F.col("content_type"), F.lit("text/html")) if "content_type" in pages.columns else F.lit("text/html")
    rows = rows.withColumn("_x", H.extracted(F.col("html"))).withColumn("_html", F.contains(kind, F.lit("html")))
    status = F.when(~F.col("_ok"), "blocked").when(F.col("html").isNull(), "error").otherwise("ok")
    rows = rows.withColumn("status", status).withColumn("_content", F.when(F.col("status") != "ok", F.lit("")).when(F.col("_html"), F.col("_x.content")).otherwise(F.substring("html", 1, 2000)))
    done = compression.compressed(rows, "_content", "url", F.lit(max_tokens), "content")
    seen = F.col("status") == "ok"
    return done.select("url", F.when(seen & F.col("_html"), F.col("_x.title")).otherwise("").alias("title"), "content", F.when(seen & F.col("_html"), F.col("_x.markdown")).alias("markdown"), "status", T.estimate_tokens(F.col("content")).alias("token_count"))


def extract(pages: DataFrame, urls: DataFrame, query: str = "", max_tokens: int = 3000) -> DataFrame:
    """(url, title, content, status) of wanted URLs (url); compressed if there is a query. URLs that aren't stored are ``error``.

    Of several pages (url, html, page_id?) of a URL, the one with the least page_id counts, or the least html where there is no page_id.
    """
    order = [*(c for c in ("page_id",) if c in pages.columns), F.col("html").isNull().alias("_empty"), "html"]
    first = pages.groupBy("url").agg(F.min(F.struct(*order)).alias("_p"))
    rows = urls.select("url").distinct().join(first.select("url", "_p.html"), "url", "left")
    rows = rows.withColumn("_x", H.extracted(F.col("html"))).withColumn("_ok", U.is_public_literal(F.col("url")))
    rows = rows.withColumn("status", F.when(~F.col("_ok"), "blocked").when(F.col("html").isNull(), "error").otherwise("ok")).withColumn("_content", F.when(F.col("status") == "ok", F.col("_x.content")).otherwise("")).withColumn("_query", F.lit(query))
    rows = compression.compressed(rows, "_content", "_query", F.lit(max_tokens), "content") if query else rows.withColumn("content", F.col("_content"))
    return rows.select("url", F.when(F.col("status") == "ok", F.col("_x.title")).alias("title"), "content", "status")


def map_urls(pages: DataFrame, max_urls: int = 50) -> DataFrame:
    """(url, ord, link): up to ``max_urls`` (100 at most) links of each URL, from all of its pages (url, html, page_id?)."""
    return links.discover(pages, min(max(max_urls, 1), 100))


def docs(requests: DataFrame, pages: DataFrame, pypi: DataFrame | None = None, npm: DataFrame | None = None, max_tokens: int = 1500) -> DataFrame:
    """(library, query, docs_url, source, content, token_count) of requests (library, query): the documentation page, compressed.

    source: ``docs``, ``none`` where no URL is known, ``error`` where its page isn't stored. token_count counts plain words.
    """
    known = tables.resolve_docs(requests, tables.libraries(requests.sparkSession), pypi, npm)
    stored = pages.select(U.normalize_url(F.col("url")).alias("_key"), "html").dropDuplicates(["_key"])
    rows = known.withColumn("_key", U.normalize_url(F.coalesce("docs_url", F.lit("")))).join(stored, "_key", "left")
    rows = rows.withColumn("source", F.when(F.col("docs_url").isNull(), "none").when(F.col("html").isNull(), "error").otherwise("docs"))
    rows = rows.withColumn("_content", F.when(F.col("source") == "docs", H.extracted(F.col("html"))["content"]).otherwise("")).withColumn("_asked", F.concat_ws(" ", "library", "query"))
    done = compression.compressed(rows, "_content", "_asked", F.lit(max_tokens), "content")
    return done.select("library", "query", "docs_url", "source", "content", F.size(T.words(F.col("content"))).alias("token_count"))


def answer_contained(hits: DataFrame, expected: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, found): whether the expected answer (query_id, expected) is in the content and title of a first hit, in any case."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    first = hits.withColumn("_n", place).filter(F.col("_n") <= top)
    text = F.lower(F.concat(F.coalesce("content", F.lit("")), F.lit(" "), F.coalesce("title", F.lit(""))))
    got = expected.join(first, "query_id", "left").groupBy("query_id").agg(F.max(F.coalesce(F.contains(text, F.lower("expected")), F.lit(False))).alias("found"))
    return got


def accuracy(results: DataFrame) -> DataFrame:
    """One row for results (question, found, result_count, seconds): counts, share found, total and mean seconds."""
    return results.agg(F.count("*").alias("total"), F.count_if("found").alias("correct"), F.round(F.count_if("found") / F.count("*"), 4).alias("accuracy"), F.round(F.sum("seconds"), 4).alias("total_seconds"), F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.count_if(F.col("result_count") == 0).alias("empty"))
