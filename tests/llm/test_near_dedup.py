import inspect

import numpy as np
import pyarrow as pa
from cases import empty, prose, table

from gleaner.llm import near_dedup
from gleaner.llm.components import connected_components


def brute_groups(ids, sigs, limit):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if sum(int(a ^ b).bit_count() for a, b in zip(sigs[i], sigs[j], strict=True)) <= limit]
    for i, j in pairs:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return pairs, {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_signature_matches_a_plain_computation():
    texts = ["Hello, hello WORLD of words", None, "", "a b c d e", "word " * 500]
    sig, has = near_dedup.signatures(pa.array(texts, pa.string()))
    assert has.tolist() == [True, False, False, True, True]
    for t, s in zip(texts, sig, strict=True):
        words = (t or "").lower().replace(",", "").split()
        total = np.zeros(256)
        hashes = [near_dedup.hash_spans(r := np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(r)])) for w in words]
        features = [(h, 1 if len(w.encode()) > 4 else 0.1) for h, w in zip(hashes, words, strict=True)] + [(near_dedup.mix(a * np.uint64(3) + b), 1) for a, b in zip(hashes, hashes[1:], strict=False)]
        for h, weight in features:
            for k, seed in enumerate(near_dedup._SEEDS):
                v = int(near_dedup.mix(h + seed)[0])
                # bit b of a byte value is counted from its highest one, as unpackbits does
                for j in range(8):
                    byte = v >> (8 * j) & 255
                    for b in range(8):
                        total[64 * k + 8 * j + 7 - b] += (1 if byte >> (7 - b) & 1 else -1) * weight
        want = [sum(1 << i for i in range(64) if total[64 * k + i] > 1e-9) for k in range(4)]
        assert s.tolist() == want


def test_recall_and_precision_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    docs = []
    for g in range(60):
        words = prose(g, 150).split()
        docs.append(" ".join(words))
        for _ in range(int(rng.integers(0, 5))):
            copy = list(words)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 15))):
                copy[at] = f"edit{rng.integers(10**6)}"
            docs.append(" ".join(copy))
    docs += ["same words here again"] * 50
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.keep_doc_id for r in near_dedup.near_duplicates(df, leaf=8).collect()}
    sig, _ = near_dedup.signatures(pa.array(docs))
    pairs, want = brute_groups(list(range(len(docs))), sig.tolist(), 56)
    hit = sum(got.get(i, -1) == got.get(j, -2) for i, j in pairs)
    assert hit >= 0.95 * len(pairs)
    assert all(want[i] == want[k] for i, k in got.items())
    assert len(near_dedup.drop_near_duplicates(df, leaf=8).collect()) == len(docs) - sum(i != k for i, k in got.items())


def pairs_apart(rng, distances):
    """Signatures of isolated pairs, at one of the distances each: both of a pair are neighbours."""
    sig = rng.integers(-(2**63), 2**63 - 1, (len(distances), 4), dtype=np.int64).view(np.uint64)
    flips = np.zeros((len(distances), 256), dtype=np.uint8)
    for row, d in zip(flips, distances, strict=True):
        row[rng.permutation(256)[:d]] = 1
    return np.stack([sig, sig ^ np.packbits(flips, axis=1).view(np.uint64)], axis=1).reshape(-1, 4)


def test_tries_meet_the_farthest_pairs_at_any_size():
    rng = np.random.default_rng(4)
    default = {k: v.default for k, v in inspect.signature(near_dedup.grouped).parameters.items()}
    design = default["max_distance"] if default["design_distance"] is None else default["design_distance"]
    for rows in (10_000, 1_000_000, 15_000_000):  # 30 GB have some 15 million documents
        depth, tries = near_dedup.forest_shape(rows, design, default["recall"], default["leaf"])
        orders = np.array([rng.permutation(256)[:depth] for _ in range(tries)])
        for d in (45, 50, 53, 56):
            differs = rng.permuted(np.tile(np.arange(256) < d, (1000, 1)), axis=1)
            assert (~differs[:, orders].any(axis=2)).any(axis=1).mean() > 0.9


def test_isolated_pairs_at_45_to_56_bits_are_linked(spark, monkeypatch):
    distances = np.repeat(np.arange(45, 57), 150)
    sig = pairs_apart(np.random.default_rng(6), distances)
    assert near_dedup.hamming(sig[::2], sig[1::2]).tolist() == distances.tolist()
    rows = [(i, i, i, *map(int, s)) for i, s in enumerate(sig.view(np.int64))]
    monkeypatch.setattr(near_dedup, "signature_table", lambda docs: docs)
    got = {r.doc_id: r.keep_doc_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "k long, h long, doc_id long, s0 long, s1 long, s2 long, s3 long"), leaf=8).collect()}
    linked = np.array([got.get(2 * k + 1) == 2 * k for k in range(len(distances))])
    assert linked[distances >= 54].mean() > 0.9 and linked.mean() > 0.9
    assert len(got) == 2 * linked.sum()


def test_dense_leaves_are_exact():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (3, 4), dtype=np.int64).view(np.uint64)
    sig = np.repeat(base, 40, axis=0)
    sig[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)
    ids = np.arange(120)
    for leaf in (2, 16, 500):
        a, b = near_dedup._links(sig, ids, np.zeros(120, np.int64), 10, leaf)
        assert sorted(b.tolist()) == [i for i in range(120) if i % 40]
        assert set(a.tolist()) == {0, 40, 80}


def test_odd_rows(spark):
    got = sorted((r.doc_id, r.keep_doc_id) for r in near_dedup.near_duplicates(table(spark)).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (11, 1)]  # the row of id 2 with another text is in no group
    docs = table(spark)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12] and sum(r.doc_id is None for r in rows) == 2
    assert [r.text for r in rows if r.doc_id == 2] == [prose(5, 90)]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0 and near_dedup.drop_near_duplicates(empty(spark)).count() == 0


def test_rows_without_ids_and_repeated_ids(spark):
    a, b = prose(31, 90), prose(32, 90)
    rows = [(None, a, 1), (None, a, 2), ("x", a, 3), ("7", a, 4), ("7", b, 5), ("7", b, 5), ("8", None, 6), ("8", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, k int")
    got = sorted(((r.doc_id, r.keep_doc_id) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == [(7, 7)] * 3 + [(None, 7)] * 3
    assert sorted((r.doc_id, r.text or "") for r in near_dedup.drop_near_duplicates(docs).collect()) == sorted([("7", a), ("7", b), ("8", ""), ("8", "")])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 9)] + [(20, 30), (30, 20), (5, 5), (None, 3), (40, 41), (41, 42), (40, 42)]
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 10)}, 30: 20, 41: 40, 42: 40}


def crowded(rng, rows):
    """Signatures like those of texts in one language: each bit leans to one side, and a third of them is alike in all rows but for some noise."""
    lean = np.where(np.arange(256) % 3 == 0, 0.1, rng.uniform(0.35, 0.65, 256))
    return np.packbits(rng.random((rows, 256)) < lean, axis=1).view(np.uint64)


def test_work_in_crowded_nodes_does_not_grow_with_their_square(monkeypatch):
    rng, counted = np.random.default_rng(8), []
    count = np.bitwise_count

    def counting(x, *args, **kwargs):
        counted.append(x.size)
        return count(x, *args, **kwargs)

    monkeypatch.setattr(np, "bitwise_count", counting)
    work = {}
    for n in (5_000, 20_000):
        sig = crowded(rng, n)
        rows = np.c_[np.zeros(n, np.int64), np.arange(n), sig.view(np.int64)]
        counted.clear()
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=["node", "id", "s0", "s1", "s2", "s3"])
        for _ in near_dedup._forest(56, 56, 0.8, [rng.permutation(256)], 0, 7)(iter([batch])):
            pass
        work[n] = sum(counted) / n
    # four words of each of the 20,000 / 2 others of a row would be 40,000
    assert work[20_000] < 2 * work[5_000] and work[20_000] < 10_000


def test_crowded_nodes_keep_the_recall():
    rng = np.random.default_rng(9)
    sig = crowded(rng, 20_000)
    flips = np.zeros((1000, 256), dtype=np.uint8)
    for row in flips:
        row[rng.permutation(256)[:56]] = 1
    sig[1:2000:2] = sig[:2000:2] ^ np.packbits(flips, axis=1).view(np.uint64)
    for recall in (0.8, 0.95):
        a, b = near_dedup._node_links(sig, np.arange(20_000), np.arange(256), 56, 56, recall, np.random.default_rng(1))
        assert np.isin(np.arange(1, 2000, 2), b).mean() > recall - 0.05


def test_shuffled_and_inner_tries_together_reach_the_recall(spark, monkeypatch):
    distances = np.repeat(np.arange(45, 57), 150)
    sig = pairs_apart(np.random.default_rng(6), distances)
    rows = [(i, i, i, *map(int, s)) for i, s in enumerate(sig.view(np.int64))]
    monkeypatch.setattr(near_dedup, "signature_table", lambda docs: docs)
    docs = spark.createDataFrame(rows, "k long, h long, doc_id long, s0 long, s1 long, s2 long, s3 long")
    got = {r.doc_id: r.keep_doc_id for r in near_dedup.near_duplicates(docs, leaf=8, node_rows=500).collect()}
    linked = np.array([got.get(2 * k + 1) == 2 * k for k in range(len(distances))])
    assert linked[distances >= 54].mean() > 0.9 and linked.mean() > 0.9
    assert len(got) == 2 * linked.sum()


def test_large_groups_are_exact_with_others_around():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (4, 4), dtype=np.int64).view(np.uint64)
    sig = np.concatenate([np.repeat(base[:1], 150, axis=0), np.repeat(base[1:3], 20, axis=0), pairs_apart(rng, [8] * 10)])
    sig[:190, 0] ^= np.uint64(1) << rng.integers(0, 64, 190).astype(np.uint64)
    sig[190:192, 0] = sig[0, 0] ^ np.array([0b111111 << 8, 0b11111111111111 << 8], dtype=np.uint64)  # a chain away from the large group
    sig[190:192, 1:] = sig[0, 1:]
    order = rng.permutation(len(sig))
    sig = sig[order]
    _, want = brute_groups(list(range(len(sig))), sig.tolist(), 10)
    for leaf in (4, 96, 500):
        a, b = near_dedup._links(sig, np.arange(len(sig)), np.zeros(len(sig), np.int64), 10, leaf)
        assert {**{i: i for i in want}, **dict(zip(b.tolist(), a.tolist(), strict=True))} == want
        top = np.array([want[i] for i in range(len(sig))])
        large = np.bincount(top).argmax()
        label = np.where(top == large, large, np.arange(len(sig)))  # as if an earlier try had linked it
        for x, y in near_dedup._close(np.ascontiguousarray(sig.T), np.full(len(sig), len(sig)), 10, leaf, label):
            label = near_dedup._joined(label, x, y)
        assert label.tolist() == top.tolist()
