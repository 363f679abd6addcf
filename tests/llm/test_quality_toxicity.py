import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from cases import empty, prose, table
from conftest import DATA

from gleaner.llm import quality, toxicity


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    good = np.asarray(label) == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_factorisation_identity_against_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(0, 0.3, (quality.SIZE, 4)))
    bounds, f, x = np.array([0, 5, 5, 12]), rng.integers(0, quality.SIZE, 12), rng.normal(size=12)
    got = m.scores(bounds, f, x)
    for k in range(3):
        i = range(bounds[k], bounds[k + 1])
        want = 0.3 + sum(m.weight[f[a]] * x[a] for a in i) + sum(m.factor[f[a]] @ m.factor[f[b]] * x[a] * x[b] for a in i for b in i if a < b)
        assert np.isclose(got[k], 1 / (1 + np.exp(-want)))


def test_quality_on_held_out_rows():
    docs = {r["doc_id"]: r for r in ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table().to_pylist()}
    labels = ds.dataset("/root/testdata/sf0.01/labels.parquet").to_table().to_pylist()
    rows = [(docs[r["doc_id"]], r["quality"]) for r in labels]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[c] for r, _ in part]) for c in ("text", "lang", "source")], names=["text", "lang", "source"])
    m = quality.train(batch(rows[:250]), np.array([q for _, q in rows[:250]], dtype=float))
    b, f, x, _ = quality.features(batch(rows[250:]))
    p, y = m.scores(b, f, x), np.array([q for _, q in rows[250:]])
    assert auc(p, y) > 0.95
    assert (p[y == 1] >= m.threshold).mean() > 0.95


def test_toxicity_on_held_out_rows():
    # in the small tables, only English toxic texts differ from clean ones
    docs = {r["doc_id"]: r["text"] for r in ds.dataset("/root/testdata/sf0.1/documents.parquet").to_table().to_pylist() if r["lang"] == "en"}
    labels = [r for r in ds.dataset("/root/testdata/sf0.1/labels.parquet").to_table().to_pylist() if r["doc_id"] in docs]
    fit, rest = labels[: len(labels) // 2], labels[len(labels) // 2 :]
    held = {r["doc_id"] for r in rest}
    toxic, others = [docs[r["doc_id"]] for r in fit if r["toxic"]], [t for i, t in docs.items() if i not in held]
    words, count = np.unique(toxicity.sparse(toxic)[1], return_counts=True)
    rest_count = np.bincount(toxicity.sparse(others)[1], minlength=1 << toxicity.BITS)[words]
    model, levels = toxicity.train(toxic, others, 0.11, words[toxicity.telling(count, rest_count, len(toxic), len(others), 30.0)])
    scores = model.scores(*toxicity.sparse(others))
    edges = toxicity.edges_of(model, levels)
    model.bias -= toxicity.threshold(levels, edges, np.array([(scores >= x).sum() for x in edges]))
    bounds, bucket = toxicity.words_held(pa.array([docs[r["doc_id"]] for r in rest]))
    s, y = model.scores(bounds, bucket), np.array([r["toxic"] for r in rest])
    assert ((s >= 0) & (y == 1)).sum() >= 0.9 * (y == 1).sum()
    assert ((s >= 0) & (y == 0)).sum() <= 0.01 * (y == 0).sum()


def plain_words(text):
    out = set()
    for w in "".join(c for c in (text or "").lower() if not (c.isascii() and c.isprintable() and not c.isalnum() and c != " ")).split():
        raw = np.frombuffer(w.encode(), np.uint8)
        out.add(int(toxicity.hash_spans(raw, np.array([0]), np.array([len(raw)]), seed=9)[0]) >> (64 - toxicity.BITS))
    return out


def test_words_held_and_frequencies_against_a_loop(spark):
    texts = ["Bad, bad WORDS!", None, "", "words of all (kinds) über bad", " \t", "x-y x y xy"]
    bounds, bucket = toxicity.words_held(pa.array(texts))
    assert [set(bucket[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)] == [plain_words(t) for t in texts]
    words = np.unique(bucket)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 5)], "doc_id long, text string").repartition(3)
    assert toxicity.frequencies(docs, words).tolist() == [5 * sum(w in plain_words(t) for t in texts) for w in words.tolist()]


def test_risk_and_its_slope_against_plain_loops():
    rng = np.random.default_rng(5)
    for shift in (-3.0, 0.0, 3.0):
        p, u, prior = rng.normal(shift, 1, 7), rng.normal(0, 1, 11), 0.4

        def parts(f, prior=prior):
            p, u = f[:7], f[7:]
            loss = lambda z: np.log(1 + np.exp(-z))
            return prior * sum(loss(x) for x in p) / 7, sum(loss(-x) for x in u) / 11 - prior * sum(loss(-x) for x in p) / 7

        f = np.r_[p, u]
        positive, negative, slope = toxicity.risk(p, u, prior)
        assert np.allclose((positive, negative), parts(f))
        lowered = (lambda f: sum(parts(f))) if negative >= 0 else (lambda f: -parts(f)[1])
        for i in range(len(f)):
            step = np.zeros(len(f))
            step[i] = 1e-6
            assert np.isclose(slope[i], (lowered(f + step) - lowered(f - step)) / 2e-6, atol=1e-6)


def test_telling_words_and_threshold_against_plain_loops():
    rng = np.random.default_rng(6)
    count, rest = rng.integers(0, 20, 50), rng.integers(0, 60, 50)
    got = toxicity.telling(count, rest, 20, 60, 3.0)
    for k, r, g in zip(count.tolist(), rest.tolist(), got.tolist(), strict=True):
        q = (k + r) / 80
        total = sum(2 * o * np.log(o / e) for o, e in ((k, 20 * q), (r, 60 * q), (20 - k, 20 * (1 - q)), (60 - r, 60 * (1 - q))) if o)
        assert g == (total >= 3.0 and k / 20 > r / 60)
    levels, scores = np.sort(rng.normal(1, 1, 30)), rng.normal(0, 1, 400)
    edges = np.unique(np.r_[levels, rng.normal(0, 1, 100)])
    above = lambda t: max(sum(x >= t for x in scores), 1)
    recall = lambda t: sum(x >= t for x in levels) / 30
    best = max(edges, key=lambda t: (recall(t) ** 2 / above(t), -t))
    least = min(t for t in edges if above(t) <= above(best) * ((recall(best) + 1 / 30) / recall(best)) ** 2)
    assert np.isclose(toxicity.threshold(levels, edges, np.array([(scores >= x).sum() for x in edges])), (best + least) / 2)


def test_binned_counts_every_score(spark):
    levels, scores = np.array([0.0, 1.0, 1.0, 2.5]), [-np.inf, -1.0, 0.0, 0.5, 1.0, 3.0, 2.5]
    got = {r.bin: r.n for r in toxicity.binned(spark.createDataFrame([(s,) for s in scores], "score double").repartition(2), levels).collect()}
    assert got == {0: 2, 1: 2, 3: 1, 4: 2}


def test_quality_features_against_plain_loops():
    rows = [("One two TWO, 33!\nline\nline", "en", "web"), (None, None, "x"), ("", "fr", None), ("naïve  Café 7", "fr", "web")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["text", "lang", "source"])
    bounds, feature, value, many = quality.features(batch)
    hashed = lambda w, seed=0: int(quality.hash_spans(r := np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(r)]), seed=seed)[0])
    for i, (text, lang, source) in enumerate(rows):
        text = text or ""
        words, raw = text.lower().split(), text.encode()
        assert many[i] == len(words)
        counts = {}
        for w in words:
            counts[hashed(w) >> (64 - quality.WORD_BITS)] = counts.get(hashed(w) >> (64 - quality.WORD_BITS), 0) + 1
        norm = max(sum(c * c for c in counts.values()), 1) ** 0.5
        want = {k: c / norm for k, c in counts.items()}
        size, n, lines = max(len(raw), 1), max(len(words), 1), text.splitlines(keepends=True)
        symbol = sum(b < 128 and b > 31 and chr(b) not in " .,;:'\"()-?" and not chr(b).isalnum() for b in raw)
        stats = [np.log1p(len(words)) / 10, sum(b < 128 and chr(b).isupper() for b in raw) / size, sum(chr(b).isdigit() for b in raw if b < 128) / size, 2 * symbol / size, min(20 * raw.count(b"\n") / size, 1), min(sum(len(w.encode()) for w in words) / n / 10, 2), sum(len(w.encode()) <= 3 for w in words) / n, len(set(words)) / n, len(set(lines)) / max(len(lines), 1), 1.0]
        base = (1 << quality.WORD_BITS) + quality.META
        want |= {base + j: x for j, x in enumerate(stats)}
        got = {}
        for f, v in zip(feature[bounds[i] : bounds[i + 1]].tolist(), value[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            got[f] = got.get(f, 0) + v
        for j, name in enumerate((lang, source)):
            key = hashed(name or "", j + 1) % quality.META + (1 << quality.WORD_BITS)
            want[key] = want.get(key, 0) + 0.3
        assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)


def test_odd_rows(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 1), (6, 0, 0), (7, 0, 1), (None, 1, 1), (99, 0, 0), (8, None, None), (9, 5, 7), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.assess(docs, labels).collect()
    assert len(got) == docs.count() and all(not r.keep and r.quality == 0 for r in got if r.doc_id in (3, 4, 5))
    assert len({r.quality for r in got if r.doc_id == 10}) == 1
    tox = toxicity.detect(docs, labels).collect()
    assert len(tox) == docs.count() and all(not r.toxic and r.toxicity == 0 for r in tox if r.doc_id in (3, 4, 5, 12))
    for none in (labels.limit(0), labels.filter("quality = 1 and toxic = 0")):
        assert all(r.quality in (0, 0.5) for r in quality.assess(docs, none).collect())
        assert toxicity.detect(docs, none).filter("toxic").count() == 0
    text = spark.createDataFrame([("a-1", "some words")], "doc_id string, text string")
    assert [r.doc_id for r in quality.assess(text, labels).collect()] == [None] == [r.doc_id for r in toxicity.detect(text, labels).collect()]
    assert quality.assess(empty(spark), labels).count() == 0 and toxicity.detect(empty(spark), labels).count() == 0


def test_long_texts_use_all_words(spark):
    docs = [(i, prose(i, 60) + (" vilewordx " if i % 3 == 0 else " ") + prose(i + 500, 60)) for i in range(240)] + [(1000, prose(7, 20_000) + " vilewordx"), (1001, prose(8, 20_000))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.detect(d, labels).collect()}
    assert got[1000] and not got[1001] and all(got[i] == (i % 3 == 0) for i in range(200, 240))


def test_near_copies_among_examples_count_once():
    a, b = prose(21, 100), prose(22, 100)
    assert toxicity.distinct([a, b, a, a + " more", "", "", b + " x"]) == [a, b, "", ""]
