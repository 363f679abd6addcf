from collections import Counter

import numpy as np
from cases import empty, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import packing


def one_by_one(lengths, capacity):
    """Best-two-fit, bin by bin and document by document."""
    pool, bins = sorted(lengths, reverse=True), []
    while pool:
        held, gap = [], capacity
        while fit := [n for n in pool if n <= gap]:
            n = max(fit)
            pool.remove(n)
            held.append(n)
            gap -= n
        if gap:
            small = min(held)
            best = max(((a + b, a, b) for i, a in enumerate(pool) for j, b in enumerate(pool) if i != j and a >= b and a + b <= gap + small), default=None)
            if best and best[0] > small:
                held.remove(small)
                for n in best[1:]:
                    pool.remove(n)
                    held.append(n)
                pool.append(small)
        bins.append(tuple(sorted(held)))
    return Counter(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(30, 45))
def test_counts_give_the_bins_of_the_plain_procedure(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    got = Counter()
    for used, times in packing.plan(counts, capacity):
        got[tuple(sorted(n for n, k in used.items() for _ in range(k)))] += times
    assert got == one_by_one(lengths, capacity)


def test_every_word_is_packed_once(spark):
    docs = spark.createDataFrame([(i, "w " * (i * 37 % 200)) for i in range(300)], "doc_id long, text string")
    bins = packing.pack(docs, 64).collect()
    assert all(b.n_tokens == sum(p.length for p in b.pieces) <= 64 and [p.doc_id for p in b.pieces] == b.doc_ids for b in bins)
    assert len({b.bin_id for b in bins}) == len(bins) == max(b.bin_id for b in bins) + 1
    cover = Counter((p.doc_id, k) for b in bins for p in b.pieces for k in range(p.start, p.start + p.length))
    assert cover == Counter((i, k) for i in range(300) for k in range(i * 37 % 200))
    lengths = [n for i in range(300) for n in [64] * (i * 37 % 200 // 64) + [i * 37 % 200 % 64] if n]
    assert Counter(tuple(sorted(p.length for p in b.pieces)) for b in bins) == one_by_one(lengths, 64)


def test_odd_rows(spark):
    bins = packing.pack(table(spark)).collect()
    words = Counter()
    for b in bins:
        for p in b.pieces:
            words[p.doc_id] += p.length
    want = Counter()
    for i, t, *_ in rows():
        if t and t.split():
            want[i] += len(t.split())
    assert words == want
    assert packing.pack(empty(spark)).count() == 0


def test_ids_that_are_no_integers_are_packed_as_null(spark):
    docs = spark.createDataFrame([("a-1", "one two"), ("b-2", "three"), ("3", "four")], "doc_id string, text string")
    (row,) = packing.pack(docs, 10).collect()
    assert row.n_tokens == 4 and sorted(map(str, row.doc_ids)) == ["3", "None", "None"]
