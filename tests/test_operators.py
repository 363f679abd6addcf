import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import catalogue, catalogue_tools  # noqa: F401 - the latter adds its queries to the former
from gleaner.functions import html as H
from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.operators import compression, grounding, links, quality, ranking, resilience
from gleaner.plans import tools
from gleaner.plans.server import Server
from gleaner.session import sized
from gleaner.sources import tables
from gleaner.sources.corpus import met_terms


def hits(spark, contents, query_id=1):
    return spark.createDataFrame([(query_id, i, f"https://h{i}.example/", c) for i, c in enumerate(contents)], "query_id long, pos int, url string, content string")


def asked(spark, query, intent="informational"):
    return spark.createDataFrame([(1, query, intent)], "query_id long, query string, intent string")


@pytest.mark.parametrize(("query", "intent", "want"), [("python framework", "code", [1.3447, 0.6159, 0.0]), ("python framework", "academic", [1.24, 0.6714, 0.0]), ("python framework", "navigational", [1.3189, 0.6267, 0.0]), ("python framework", "unknown", [1.2767, 0.6463, 0.0]), ("python python", "informational", [0.8272, 1.2925, 0.0])])
def test_bm25(spark, query, intent, want):
    got = ranking.bm25_rank(hits(spark, ["python web framework fast", "python python snake", "cooking recipes"]), asked(spark, query, intent)).collect()
    by = {r.url: (r.bm25_score, r.pos) for r in got}
    assert [by[f"https://h{i}.example/"][0] for i in range(3)] == want
    assert sorted(r.pos for r in got) == [0, 1, 2] and [r.bm25_score for r in sorted(got, key=lambda r: r.pos)] == sorted(want, reverse=True)


def ranked(spark, urls):
    return spark.createDataFrame([(1, i, u) for i, u in enumerate(urls)], "query_id long, pos int, url string")


def test_rrf(spark):
    a, b = ranked(spark, ["a", "b"]), ranked(spark, ["b", "c"])
    order = lambda df: [(r.url, r.rrf_score) for r in df.orderBy("pos").collect()]
    assert order(ranking.rrf_fuse([a, b])) == [("b", 0.0325), ("a", 0.0164), ("c", 0.0161)]
    assert order(ranking.rrf_fuse([a, b], [2.0])) == [("a", 0.0328), ("b", 0.0323)]
    assert order(ranking.rrf_fuse([a, b, ranked(spark, [])])) == order(ranking.rrf_fuse([a, b]))


def test_confidence(spark):
    one = lambda *x, w=None: spark.range(1).select(ranking.confidence(*map(F.lit, x), weights=w).alias("c")).first().c
    assert tuple(one(1.0, 1.0, 0.7, 1.0, 1.0, 1.0)) == (0.955, "high")
    assert tuple(one(1.0, 1.0, 0.7, 1.0, 1.0, 0.0)) == (0.755, "medium")


def test_budgets(spark):
    for n, want in ((1, [3000]), (3, [1500, 1000, 500]), (5, [1000, 800, 600, 400, 200])):
        df = spark.range(1, n + 1)
        assert [r.b for r in df.select("id", compression.budget_of(F.col("id"), F.lit(n), F.lit(3000)).alias("b")).orderBy("id").collect()] == want


TEXT = "FastAPI uses Pydantic for models. It validates all inputs automatically. Bananas are yellow fruit. However they ripen quickly outside. Short. FastAPI is async by design."


@pytest.mark.parametrize(("text", "query", "budget", "most", "want"), [(TEXT, "fastapi pydantic", 800, 1, TEXT[:72]), (TEXT, "fastapi pydantic", 12, 2, TEXT[:72]), (TEXT, "fastapi", 1, 10, TEXT[:33]), ("tiny", "x", 2, 10, "tiny"), ("", "x", 5, 10, "")])
def test_compression(spark, text, query, budget, most, want):
    df = spark.createDataFrame([(text, query)], "t string, q string")
    assert compression.compressed(df, "t", "q", F.lit(budget), "c", most).first().c == want


def loop_compress(text, query, budget, most):
    import re

    s = [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-ZÀ-ɏ])", text) if len(x.strip()) > 10]
    if not s:
        return text[: budget * 4]
    t = [x.lower().split() for x in s]
    mean = sum(map(len, t)) / len(t)
    df = Counter(w for x in t for w in set(x))
    score = [sum(math.log((len(t) - df[q] + 0.5) / (df[q] + 0.5) + 1) * (c := x.count(q)) * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / max(mean, 1))) for q in query.split() if x.count(q)) for x in t]
    top = set(sorted(range(len(s)), key=lambda i: (-score[i], i))[:most])
    top |= {i + 1 for i in top if i + 1 < len(s) and s[i + 1].split()[0].lower() in ("it", "however", "this")}
    out, used = [], 0
    for i in sorted(top):
        if used + len(t[i]) > budget:
            break
        out.append(s[i])
        used += len(t[i])
    return " ".join(out) or s[0]


def test_compression_against_a_loop(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["It ", "However ", "This ", "Plain ", "Ever "]) + " ".join(rng.choice("red blue green tall small".split()) for _ in range(rng.randint(1, 9))) + "." for _ in range(rng.randint(1, 25))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "red tall") for i, t in enumerate(texts)], "i int, t string, q string")
    got = {r.i: r.c for r in compression.compressed(df, "t", "q", F.lit(40), "c", 5).collect()}
    assert got == {i: loop_compress(t, "red tall", 40, 5) for i, t in enumerate(texts)}


def test_quality(spark):
    rows = [(1, 0, "https://a.org/x/"), (1, 1, "https://A.org/x#f"), (1, 2, "https://x.com/1"), (1, 3, "https://a.org/y"), (1, 4, "https://a.org/z"), (1, 5, "https://docs.python.org/1"), (1, 6, None), (1, 7, "")]
    df = spark.createDataFrame(rows, "query_id long, pos int, url string")
    got = quality.filter_and_classify(df)
    assert sorted(r.pos for r in got.collect()) == [0, 3, 4, 5, 6, 7]
    kept = quality.diversify(got.filter("url like 'https%'"))
    assert [(r.pos, r.url, r.source_tier) for r in kept.orderBy("pos").collect()] == [(0, "https://a.org/x/", 3), (1, "https://a.org/y", 3), (2, "https://docs.python.org/1", 1)]


def test_agreement_and_grounding(spark):
    got = grounding.cross_source_agreement(grounding.detect_contradictions(hits(spark, ["alpha beta gamma", "alpha beta gamma", "", "never mind"]))).orderBy("pos").collect()
    assert got[2].agreement_score == 0 and got[0].agreement_score == got[1].agreement_score > got[3].agreement_score and got[3].has_contradiction_markers
    assert grounding.cross_source_agreement(hits(spark, ["lone"])).first().agreement_score == 0


def test_feedback_terms(spark):
    got = ranking.feedback_terms(hits(spark, ["spark spark engine", "engine oil", "query and of with engine"]), asked(spark, "query"), 2).orderBy("rank").collect()
    assert [r.term for r in got] == ["spark", "engine"]


def test_crawl_and_map(spark):
    pages = spark.createDataFrame([("http://s.org/", "<a href='/a'>a</a><a href='/b/'>b</a><a href='/a#x'>a</a><a href='http://o.org/'>o</a><a href='mailto:x'>m</a>"), ("http://s.org/a", "<a href='/c'>c</a>"), ("http://s.org/b", "<a href='/'>r</a>"), ("http://s.org/c", "end")], "url string, html string")
    got = [(r.url, r.depth) for r in links.crawl(pages, spark.createDataFrame([("http://s.org/",)], "url string")).orderBy("pos").collect()]
    assert got == [("http://s.org/", 0), ("http://s.org/a", 1), ("http://s.org/b/", 1), ("http://s.org/c", 2)]
    assert [r.link for r in tools.map_urls(pages.limit(1)).orderBy("ord").collect()] == ["http://s.org/a", "http://s.org/b/"]


def test_map_takes_all_pages_of_a_url(spark):
    pages = spark.createDataFrame([(2, "http://s.org/", "<a href='/c'>c</a><a href='/a'>a</a>"), (1, "http://s.org/", "<a href='/a'>a</a><a href='/b'>b</a>")], "page_id long, url string, html string")
    for rows in (pages, pages.orderBy("page_id")):
        assert [(r.ord, r.link) for r in tools.map_urls(rows).orderBy("ord").collect()] == [(0, "http://s.org/a"), (1, "http://s.org/c"), (2, "http://s.org/b")]
    assert sorted(r.link for r in tools.map_urls(pages.drop("page_id")).collect()) == ["http://s.org/a", "http://s.org/b", "http://s.org/c"]


def test_links_map_takes_all_pages_of_a_url(spark, tmp_path):
    rows = [(1, "http://s.org/", '<a href="/a">a</a><a href="/b">b</a>'), (2, "http://s.org/", '<a href="/c">c</a>')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r.ord, r.link) for r in catalogue.QUERIES["links_map"](spark, str(tmp_path)).collect()) == [(0, "http://s.org/a"), (1, "http://s.org/c"), (2, "http://s.org/b")]


def test_extract_takes_one_page_of_a_url_by_page_id(spark):
    pages = spark.createDataFrame([(2, "http://s.org/", "<p>second"), (1, "http://s.org/", "<p>first"), (4, "http://s.org/n", "<p>x"), (3, "http://s.org/n", None)], "page_id long, url string, html string")
    wanted = pages.select("url")
    assert sorted((r.content, r.status) for r in tools.extract(pages, wanted).collect()) == [("", "error"), ("first", "ok")]
    assert sorted(r.content for r in tools.extract(pages.drop("page_id"), wanted).collect()) == ["first", "x"]


def test_equal_sentences_go_by_place(spark):
    """The sentences' scores are the same but for the last bits of their sums, which favour the second."""
    s = ["The and and and and of of of word word.", "The the the and of of of of word word.", "Other other other."]
    df = spark.createDataFrame([(" ".join(s), "the and of")], "text string, query string")
    assert compression.compressed(df, "text", "query", F.lit(100), "out", most=1).first().out == s[0]


def test_cache_and_breaker():
    now = [0.0]
    c = resilience.TTLCache(2, 10, lambda: now[0])
    c.set(1, "a")
    c.set(2, "b")
    assert c.get(1) == "a"
    c.set(3, "c")
    assert c.get(1) == "a" and c.get(2) is None and c.size == 2
    now[0] = 11
    assert c.get(1) is None
    b = resilience.CircuitBreaker(2, 5, lambda: now[0])
    b.record_failure()
    assert not b.is_open
    b.record_failure()
    assert b.is_open
    now[0] += 6
    assert not b.is_open
    b.record_success()
    assert b.failures == 0


def test_sources(spark):
    import json

    h = hits(spark, ["é one", None])
    row = tables.as_json(h).first()
    assert [x["pos"] for x in json.loads(row.json)] == [0, 1] and "é one" in row.json
    b = resilience.CircuitBreaker(1)
    assert tables.available(h, h.limit(1), b) is h
    b.record_failure()
    assert tables.available(h, h.limit(1), b).count() == 1
    assert tables.synonyms_from_json(spark, "/nowhere/at/all.json") == {}


def test_server(spark):
    corpus = spark.createDataFrame([(i, f"https://h{i % 4}.example/{i}", f"t{i}", f"Sparks fly over engine number {i}. Engines turn query plans into tasks.") for i in range(12)], "doc_id long, url string, title string, content string")
    pages = spark.createDataFrame([("https://s.org/", "<title>S</title><p>hello page</p><a href='/x'>x</a>")], "url string, html string")
    s = Server(spark, corpus, pages)
    assert len(s.handle({"id": 1, "method": "tools/list"})["result"]["tools"]) == 8
    assert s.handle({"method": "notifications/initialized"}) is None and s.handle({"id": 2, "method": "no"})["error"]["code"] == -32601
    assert s.handle({"id": 3, "method": "tools/call", "params": {"name": "none"}})["result"]["isError"]
    call = lambda name, **a: s.handle({"id": 4, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]
    assert '"result_count": 3' in call("search", query="engine query", max_results=3)["content"][0]["text"]
    assert "https://s.org/x" in call("map", url="https://s.org/")["content"][0]["text"]
    assert "hello page" in call("scrape", url="https://s.org/")["content"][0]["text"]


def test_research_and_validate(spark):
    corpus = spark.createDataFrame([(i, f"https://h{i}.example/", f"t{i}", f"Joins shuffle data number{i}. Sorting needs memory and disks. Never fails.") for i in range(15)], "doc_id long, url string, title string, content string")
    q = spark.createDataFrame([(1, "joins shuffle data and sorting needs memory", "quick"), (2, "nothing matches", "deep")], "query_id long, raw_query string, depth string")
    got = tools.research(q, corpus).collect()
    assert {r.query_id for r in got} == {1} and 0 < len(got) <= 8 and sorted(r.pos for r in got) == list(range(len(got)))
    summary, sources = tools.validate(spark.createDataFrame([(1, "joins never shuffle")], "query_id long, claim string"), corpus)
    row = summary.first()
    assert row.sources_checked == sources.count() == 5 and row.has_negation_markers and row.sources_supporting == 0


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<b>" * 100_000 + "x", "<article>" * 50_000 + "x", "<ul><li>" * 30_000 + "x", "</p>" * 100_000 + "<i>" * 1000, "<table><tr><td>" * 300 + "x"])
def test_deep_pages(page):
    title, text, markdown = H.extract(page)
    assert title == "" and text in ("x", "") and "x" * ("x" in page) in markdown
    assert H.hrefs(page) == [] and H.result_links(page) == []


def test_retries_wait_longer_each_time_and_end():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError, match="down"):
        resilience.retried(fail, attempts=4, first=1.0, most=3.0, sleep=waits.append, spread=lambda: 0.5)
    assert len(calls) == 4 and waits == [1.25, 2.5, 3.75]
    assert resilience.retried(iter([OSError(), 5]).__next__) is not None
    with pytest.raises(KeyError):
        resilience.retried(lambda: {}[1], sleep=waits.append)


def test_readable_pages_are_guarded(spark):
    pages = spark.createDataFrame([("https://a.example/x?q", "1"), ("https://a.example/private/y", "2"), ("http://127.0.0.1/z", "3"), ("https://b.example", "4"), (None, "5")], "url string, html string")
    robots = spark.createDataFrame([("A.example", "User-agent: *\nDisallow: /private")], "domain string, text string")
    assert {r.url: r.html for r in links.readable_pages(pages, robots).collect()} == {"https://a.example/x?q": "1", "https://a.example/private/y": None, "http://127.0.0.1/z": None, "https://b.example": "4", None: None}
    assert links.readable_pages(pages).filter("html is null").count() == 2


def test_libraries_and_synonyms_from_files(spark, tmp_path):
    (tmp_path / "l.json").write_text('{\n "a": "https://a.example/docs",\n "b": null\n}')
    (tmp_path / "bad.json").write_text("[1")
    (tmp_path / "s.json").write_text('{"term": "join", "synonyms": ["unite"]}\n{"term": null, "synonyms": []}\n')
    assert [tuple(r) for r in tables.libraries_from_json(spark, str(tmp_path / "l.json")).collect()] == [("a", "https://a.example/docs")]
    assert tables.libraries_from_json(spark, str(tmp_path / "bad.json")).count() == 0 == tables.libraries_from_json(spark, str(tmp_path / "none.json")).count()
    found = tables.synonyms_from_json(spark, str(tmp_path / "s.json"))
    assert found == {"join": ["unite"]}
    q = spark.createDataFrame([("Fast join",)], "q string").select(T.expand_query(F.col("q"), tables.synonym_map(found)).alias("e")).first()
    assert q.e == "fast join unite"


def test_benchmark_results_are_written(spark, tmp_path):
    results = spark.createDataFrame([("q2", "b", False, 0, 1.0), ("q1", "a", True, 3, 2.0)], "question string, expected string, found boolean, result_count int, seconds double")
    tables.write_benchmark(results, tools.accuracy(results), str(tmp_path / "out"), "answers")
    (line,) = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    got = json.loads(line)
    assert got["benchmark"] == "answers" and got["accuracy"] == 0.5 and got["total"] == 2
    assert got["details"][0] == {"question": "q1", "expected": "a", "found": True, "result_count": 3}


def test_a_model_is_loaded_once_a_worker(spark):
    def load():
        loads = [0]

        def model(texts):
            loads[0] += 1
            return np.array([[len(t), 0.0] for t in texts])

        return model

    embed = V.model_embedding(load)
    df = spark.createDataFrame([("abc",), ("",), (None,)], "t string").coalesce(1)
    assert [r.v for r in df.select(embed(F.col("t")).alias("v")).collect()] == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_research_reads_stored_pages(spark):
    corpus = spark.createDataFrame([(i, f"https://s{i}.example/p", f"T{i}", f"solar power plants number {i}. They make current. " * 3) for i in range(6)], "doc_id long, url string, title string, content string")
    long = "<article><p>" + "Always 100% of 2024 plants confirm 55 claims and all must prove 77. " * 5 + "</p></article>"
    pages = spark.createDataFrame([("https://s0.example/p", long), ("https://s5.example/p", long), ("https://s0.example/p", long)], "url string, html string")
    asked = spark.createDataFrame([(1, "solar power", "quick")], "query_id long, raw_query string, depth string")
    without = {r.url: r for r in tools.research(asked, corpus).collect()}
    found = {r.url: r for r in tools.research(asked, corpus, pages).collect()}
    assert set(found) == set(without) and len(found) == 6
    # the first two hits alone are looked up: the page of the first tells its densities, that of the last doesn't
    hits = tools.deep_scrape(spark.createDataFrame([(1, p, f"https://s{p}.example/p") for p in range(6)], "query_id long, pos int, url string"), pages, spark.createDataFrame([(1, 2)], "query_id long, scrape_top int"))
    assert {r.pos: r.full_content is not None for r in hits.collect()} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False}


def test_terms_met_are_the_same_within_the_row_and_by_a_shuffle(spark):
    texts = ["a b a c", "", None, "B c c d", "x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = spark.createDataFrame([("a",), ("c",), ("b",), ("c",), (None,)], "term string")
    want = {i: (len((t or "").split()), {w: n for w, n in Counter((t or "").lower().split()).items() if w in "abc"}) for i, t in enumerate(texts)}
    for most in (10_000, 1):
        assert {r.doc_id: (r.length, {m.term: m.tf for m in r.m}) for r in met_terms(docs, "text", wanted, most).collect()} == want


def test_only_small_tables_are_broadcast(spark):
    plan = lambda most: spark.range(100).join(sized(spark.range(50), most), "id")._jdf.queryExecution().logical().toString()
    assert "strategy=broadcast" in plan(50) and "strategy=broadcast" not in plan(49)
