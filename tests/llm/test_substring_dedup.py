from cases import empty, prose, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import substring_dedup


def brute(docs, window):
    """{(id, text): words cut} by listing all windows."""
    order = sorted({(substring_dedup.LAST_ID if i is None else i, t) for i, t in docs if t}, key=lambda x: x[0])
    seen = {}
    for at, (_, t) in enumerate(order):
        w = t.split()
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), []).append((at, p))
    cut, hold = {}, {}
    for places in seen.values():
        if len(places) > 1:
            for k, (at, p) in enumerate(places):
                (cut if k else hold).setdefault(at, set()).update(range(p, p + window))
    return {order[at]: sorted(c - hold.get(at, set())) for at, c in cut.items() if c - hold.get(at, set())}


def check(spark, docs, window, hot=substring_dedup.HOT):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    want = brute(docs, window)
    got = {(substring_dedup.LAST_ID if r.doc_id is None else r.doc_id, r.text): r.cut_words for r in substring_dedup.repeated_passages(df, window, hot).collect()}
    left = lambda t, gone: " ".join(w for i, w in enumerate(t.split()) if i not in set(gone))
    assert {(i, " ".join(t.split())): n for (i, t), n in got.items()} == {(i, left(t, g)): len(g) for (i, t), g in want.items()}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), min_size=0, max_size=60), max_size=5), st.integers(3, 9), st.sampled_from([1, 2, substring_dedup.HOT]))
def test_small_alphabets(spark, texts, window, hot):
    check(spark, [(i, " ".join(t)) for i, t in enumerate(texts)], window, hot)


def test_passages_and_runs(spark):
    p = [prose(i, 70) for i in range(4)]
    docs = [(1, p[0]), (2, p[1] + " " + p[0]), (3, f"lead {p[0]} {p[1]} tail"), (4, "x " * 400), (5, "y z " * 150 + p[2]), (6, "start " + "x " * 90), (7, p[2] + " " + p[2]), (8, p[3]), (None, p[3]), (9, p[3][: len(p[3]) // 3])]
    for hot in (1, 3, substring_dedup.HOT):
        check(spark, docs, 50, hot)


def test_odd_rows(spark):
    docs = table(spark)
    out = substring_dedup.drop_repeated_passages(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    done = out.collect()
    want = brute([r[:2] for r in rows()], 50)
    by_id = {}
    for r in done:
        by_id.setdefault(r.doc_id, []).append(r)
    for (i, t), gone in want.items():
        left = " ".join(w for k, w in enumerate(t.split()) if k not in set(gone))
        assert any(" ".join((r.text or "").split()) == left and r.n_chars == len(r.text) for r in by_id[None if i == substring_dedup.LAST_ID else i])
    assert len([r for r in by_id[2] if r.text.strip() == ""]) == 2, "both equal rows are cut alike"
    assert by_id[3][0].text is None and by_id[4][0].text == ""
    assert substring_dedup.drop_repeated_passages(empty(spark)).count() == 0 and substring_dedup.repeated_passages(empty(spark)).count() == 0
