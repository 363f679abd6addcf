import random
import re

from cases import empty, prose, table
from hypothesis import given
from hypothesis import strategies as st

from gleaner.llm import decontaminate


def least(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=120))
def test_myers_is_the_edit_distance(pattern, text):
    assert decontaminate.myers(decontaminate.masks(pattern), len(pattern), text) == least(pattern, text)


@given(st.lists(st.text("ab ", min_size=12, max_size=40), max_size=3), st.text("ab ", max_size=150))
def test_matcher_finds_what_all_places_hold(items, text):
    found = dict(decontaminate.Matcher(list(enumerate(items)), 0.15).find(text))
    assert found == {i: d for i, p in enumerate(items) if (d := least(p, text)) <= int(0.15 * len(p))}


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice(["", "q", out[at] + "z"])
    return "".join(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = [(k, prose(100 + k, 20)) for k in range(6)] + [(7, "short one"), (10, "Short"), (11, " \n"), (12, "orto"), (13, "  a SHORT\tone "), (8, None), (9, prose(100, 20))]
    docs = [(k, prose(k, 40) + " " + edited(items[k % 6][1], k, rng).upper() + "\n " + prose(50 + k, 10)) for k in range(14)] + [(20, prose(77, 200)), (21, None), (22, ""), (23, "a  short One."), (24, "portone short onesie a")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for a, t in docs:
        for b, p in items:
            p = " ".join((p or "").lower().split())
            if not t or not p:
                continue
            if len(p) < 20:
                if re.search(rf"(?<![^\W_]){re.escape(p)}(?![^\W_])", " ".join(t.lower().split())):
                    want[a, b] = 0
            elif (x := least(p, " ".join(t.lower().split()))) <= int(0.05 * len(p)):
                want[a, b] = x
    for shard in (10**6, 100):
        assert {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(d, i, shard_chars=shard).collect()} == want
    assert len(want) > 8
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, i).collect()} == {a for a, _ in docs} - {a for a, _ in want}


def test_ids_that_are_no_integers_count_as_null(spark):
    text = prose(5, 30)
    docs, items = spark.createDataFrame([("a-1", text)], "doc_id string, text string"), spark.createDataFrame([("q", text)], "item_id string, text string")
    assert [tuple(r) for r in decontaminate.contaminated(docs, items).collect()] == [(None, None, 0)]
    assert decontaminate.drop_contaminated(docs, items).count() == 0


def test_odd_rows(spark):
    docs = table(spark)
    items = spark.createDataFrame([(1, prose(2, 60), "x"), (None, prose(3, 30), "y"), (2, "", "z"), (3, None, "z")], "item_id long, text string, key string")
    out = decontaminate.drop_contaminated(docs, items)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [2, 3, 4, 5, 6, 7, 9, 10, 12] and ids.count(None) == 1
    assert decontaminate.contaminated(docs, items).filter("doc_id = 2").count() == 2
    assert decontaminate.contaminated(empty(spark), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()
