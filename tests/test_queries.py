"""Every query with SQL agrees with DuckDB on the smallest data."""

import duckdb
import pytest
from conftest import DATA

from gleaner import catalogue, catalogue_tools  # noqa: F401 - the latter adds its queries to the former

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in found.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["chunks", "html_text", "html_markdown", "scrape", "extract", "documentation"])
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def of_rows(spark, folder, name, table, rows, schema):
    """The query agrees with its SQL on a table of these rows."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    found = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want


def page(title, text):
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body><nav><a href=\"/n\">n</a></nav><article><h1>{title}</h1><p>{text}</p></article><footer>&copy; f</footer></body></html>"


# titles cut within a reference, as in the larger tables
CUT = [(3 * i, f"https://s.example/{i}", page(f"One &amp; two{cut}", "First words of a page &lt;here&gt; and there. Then come some others, &quot;quoted&quot; and more of the same. " * 2)) for i, cut in enumerate(["", "&amp;&amp", "&amp", "&am", "&", "&lt", "&quot"])]


@pytest.mark.parametrize("name", ["html_text", "html_markdown", "scrape", "extract"])
def test_cut_references_stay(spark, tmp_path, name):
    of_rows(spark, tmp_path, name, "pages", CUT, "page_id long, url string, html string")


def test_extract_takes_the_first_page_of_a_url(spark, tmp_path):
    text = "The words of a page and of others. " * 4
    rows = [(3 * i, f"https://s.example/{i % 3}", page(f"Page {i}", f"Page {i}. {text}")) for i in reversed(range(9))]
    of_rows(spark, tmp_path, "extract", "pages", rows, "page_id long, url string, html string")


def test_equally_near_sentences_go_by_place(spark, tmp_path):
    """The fourth sentence holds the first one's letters five times, so that only the last bits tell their cosines apart."""
    text = "Heron dune house. Lulu lulu suus. Vvv kkk vvv kkk. Heron dune house heron dune house heron dune house heron dune house heron dune house. Bbb ggg bbb ggg."
    of_rows(spark, tmp_path, "semantic_scores", "documents", [(0, text)], "doc_id long, text string")
