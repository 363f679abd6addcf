"""Link discovery, breadth-first traversal of stored pages, and robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import text as T
from gleaner.functions import urls as U

MOST_LINKS = 100


def discover(pages: DataFrame, most: int = MOST_LINKS, same_domain: bool = True) -> DataFrame:
    """(url, ord, link): each page's links, made absolute, the first of each canonical URL, on its own domain, of public hosts.

    Duplicates go before the other filters do, and links come as written, not in canonical form. Pages of one URL count as one: links go by their
    place in their page, those of equal place by page_id, if there is one.
    """
    ident = [c for c in ("page_id",) if c in pages.columns]
    raw = pages.select("url", *ident, F.posexplode(H.links(F.col("html"))).alias("at", "href")).filter(U.is_valid_href(F.col("href")))
    order = ["at", *ident, "href"]
    full = raw.withColumn("link", U.resolve("url", "href")).filter("link is not null")
    once = full.withColumn("_n", F.row_number().over(Window.partitionBy("url", U.normalize_url(F.col("link"))).orderBy(*order))).filter("_n = 1")
    if same_domain:
        once = once.filter(U.netloc(F.col("link")) == U.netloc(F.col("url")))
    safe = once.filter(U.is_public_literal(F.col("link")))
    return safe.withColumn("ord", F.row_number().over(Window.partitionBy("url").orderBy(*order)) - 1).filter(F.col("ord") < most).select("url", "ord", "link")


def crawl(pages: DataFrame, seeds: DataFrame, max_pages: int = 10, max_depth: int = 2, instructions: str = "") -> DataFrame:
    """(seed, pos, depth, url, title, content): pages met from each seed (column url), breadth first along links in page order.

    A level at a time, for all seeds at once: what is met first by (depth, parent's place, link's place) counts. Pages that aren't stored, or don't
    match the instructions, count as visited but are neither returned nor followed. ``max_pages`` (20 at most) bounds returned pages;
    ``max_depth`` is 3 at most.
    """
    max_pages, max_depth = min(max_pages, 20), min(max_depth, 3)
    stored = pages.withColumn("key", U.normalize_url(F.col("url"))).withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("url"))).filter("_n = 1").select("key", "html")
    level = seeds.select(F.col("url").alias("seed"), F.col("url").alias("url"), U.normalize_url(F.col("url")).alias("key"), F.lit(0).cast("bigint").alias("place")).filter(U.is_public_literal(F.col("url")))
    visited, found = level.select("seed", "key"), None
    for depth in range(max_depth + 1):
        met = level.join(stored, "key").withColumn("x", H.extracted(F.col("html"))).filter(T.matches_keywords(F.col("x.content"), F.lit(instructions)))
        got = met.select("seed", F.lit(depth).alias("depth"), "place", "url", F.col("x.title").alias("title"), F.col("x.content").alias("content"))
        found = got if found is None else found.unionByName(got)
        if depth == max_depth:
            break
        links = discover(met.select(F.concat_ws(" ", "seed", "url").alias("id"), "url", "html").select("url", "html").distinct())
        step = met.select("seed", "place", "url").join(links, "url").select("seed", F.col("link").alias("url"), U.normalize_url(F.col("link")).alias("key"), F.struct("place", "ord").alias("at"))
        step = step.groupBy("seed", "key").agg(F.min(F.struct("at", "url")).alias("m")).join(visited, ["seed", "key"], "left_anti")
        level = step.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("m.at")).cast("bigint")).select("seed", F.col("m.url").alias("url"), "key", "place")
        visited = visited.unionByName(level.select("seed", "key"))
    order = Window.partitionBy("seed").orderBy("depth", "place")
    return found.withColumn("pos", F.row_number().over(order) - 1).filter(F.col("pos") < max_pages).select("seed", "pos", "depth", "url", "title", "content")


def disallowed(robots: Column, path: Column, agent: str = "gleaner", legacy_case: bool = False) -> Column:
    """Whether a robots text forbids a path to all agents or to ours. Null or absent rules allow all.

    A user-agent line starts a block; in blocks for '*' or for our name, disallow lines are path prefixes. ``legacy_case``: the rules are put in lower
    case and the path is not, as some older crawlers do.
    """
    lines = F.transform(F.split(robots, "\n"), T.strip)
    zero = F.struct(F.lit(False).alias("ours"), F.lit(False).alias("hit"))

    def step(a: Column, line: Column) -> Column:
        low = F.lower(line)
        value = T.strip(F.regexp_replace(line, r"^[^:]*:", ""))
        rule = F.lower(value) if legacy_case else value
        mine = (value == "*") | F.contains(F.lower(value), F.lit(agent))
        blocks = a["ours"] & low.startswith("disallow:") & (rule != "") & F.startswith(path, rule)
        return F.struct(F.when(low.startswith("user-agent:"), mine).otherwise(a["ours"]).alias("ours"), (a["hit"] | blocks).alias("hit"))

    return F.coalesce(F.aggregate(lines, zero, step)["hit"], F.lit(False))


def allowed_pages(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """Pages that the rules of their domain (robots: domain, text) don't forbid; domains without rules allow all."""
    rules = robots.select(F.lower("domain").alias("_domain"), F.col("text").alias("_rules"))
    joined = pages.join(rules, U.netloc(F.col("url")) == F.col("_domain"), "left")
    path = F.when(U.part(F.col("url"), 3) == "", "/").otherwise(U.part(F.col("url"), 3))
    return joined.filter(~disallowed(F.col("_rules"), path)).drop("_domain", "_rules")


def readable_pages(pages: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """Stored pages (url, html, ...) as they may be read: html is null where the URL names no public host or the rules (domain, text) forbid it.

    Nothing is cut from the html, so links can be found in it.
    """
    ok = U.is_public_literal(F.col("url"))
    if robots is not None:
        rules = robots.select(F.lower("domain").alias("_domain"), F.col("text").alias("_rules")).dropDuplicates(["_domain"])
        path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^#]*)", 1)
        pages = pages.join(rules, U.netloc(F.col("url")) == F.col("_domain"), "left")
        ok = ok & ~disallowed(F.col("_rules"), F.when(path == "", "/").otherwise(path))
    return pages.withColumn("html", F.when(F.coalesce(ok, F.lit(False)), F.col("html"))).drop("_domain", "_rules")
