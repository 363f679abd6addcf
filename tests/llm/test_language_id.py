import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from cases import empty, table
from conftest import DATA

from gleaner.llm import language_id


@pytest.fixture(scope="module")
def scored(spark):
    return language_id.identify(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_held_out_accuracy():
    import pyarrow.dataset as ds

    rows = ds.dataset(f"{DATA}/documents.parquet").to_table(columns=["text", "lang"]).to_pylist()
    model = language_id.train([r["text"] for r in rows[:120]], [r["lang"] for r in rows[:120]])
    import pyarrow as pa

    p, n = model.probabilities(pa.array([r["text"] for r in rows[120:]]))
    right = [model.languages[k] == r["lang"] for k, r in zip(p.argmax(axis=1), rows[120:], strict=True)]
    assert sum(right) / len(right) > 0.95
    assert (p.max(axis=1) >= model.threshold).mean() > 0.95


def test_probabilities_match_a_plain_computation():
    import numpy as np
    import pyarrow as pa

    model = language_id.train(["the cat and the dog"] * 6 + ["der hund und die katze"] * 6, ["en"] * 6 + ["de"] * 6)
    texts = ["The dog!", "die", None, "42 ?", "a"]
    p, count = model.probabilities(pa.array(texts, pa.string()))
    for t, row, n in zip(texts, p, count, strict=True):
        raw = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in (t or "").lower().encode())
        total, seen = np.zeros(2), 0
        for k in language_id.ORDERS:
            for i in range(len(raw) - k + 1):
                gram = raw[i : i + k]
                if gram.strip():
                    x = int.from_bytes(gram, "little")
                    b = ((x ^ x >> 15) * (0x9E3779B1 + 2 * k) & 0xFFFFFFFF) >> 32 - language_id.BUCKET_BITS
                    total += model.table[:, b]
                    seen += 1
        assert seen == n
        e = np.exp((total / max(seen, 1)) / model.temperature)
        assert np.allclose(row, e / e.sum(), atol=1e-5)


def test_fit_and_verdicts_match_a_plain_computation():
    rng = np.random.default_rng(3)
    words = {"en": ["weather", "the", "harbour", "and", "morning"], "de": ["wetter", "der", "hafen", "und", "morgen"]}
    texts, labels = zip(*((" ".join(rng.choice(words[k], 12)), k) for k in ["en", "de"] * 40), strict=True)
    model = language_id.train(list(texts), list(labels))
    asked = ["the morning and the harbour", "qqq zzz xxyy", "der hafen 7", "", None, "\u4e2d\u6587\u4e2d\u6587"]
    best, sure, accepted = model.verdicts(pa.array(asked, pa.string()))
    for t, b, p, ok in zip(asked, best, sure, accepted, strict=True):
        raw = bytes(x if x > 127 or chr(x).isalpha() else 32 for x in (t or "").lower().encode())
        score, usual, n = np.zeros(len(model.languages)), language_id.PRIOR * model.usual_fit, 0
        for k in language_id.ORDERS:
            for i in range(len(raw) - k + 1):
                if raw[i : i + k].strip():
                    x = int.from_bytes(raw[i : i + k], "little")
                    bucket = ((x ^ x >> 15) * (0x9E3779B1 + 2 * k) & 0xFFFFFFFF) >> 32 - language_id.BUCKET_BITS
                    score, usual, n = score + model.table[:, bucket], usual + float(model.usual[bucket]), n + 1
        e = np.exp(score / max(n, 1) / model.temperature)
        want = max(e / e.sum()) if n else 0.0
        assert np.isclose(p, want, atol=1e-5) and (not n or b == int(np.argmax(e)))
        assert ok == bool(n and want >= model.threshold and usual / (n + language_id.PRIOR) >= model.least_fit)
    assert accepted.tolist() == [True, False, True, False, False, False]


def test_all_rows_are_scored_and_most_rightly(spark, scored):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    both = scored.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(both) == docs.count()
    assert sum(r.accepted and r.language == r.lang for r in both) > 0.95 * len(both)


def test_foreign_text_and_noise_are_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "これは日本語の文章です。" * 30, None), (-2, "12345 67890 !!! " * 20, None), (-3, "Это русский текст о погоде " * 20, None)], docs.schema)
    got = {r.doc_id: r.accepted for r in language_id.identify(docs.union(odd)).filter("doc_id < 0").collect()}
    assert got[-2] is False and got[-1] is False


def test_foreign_scripts_and_shuffled_letters_are_rejected_among_any_number_of_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    russian = (-3, "Это русский текст о погоде " * 20, None)
    shuffled = (-4, language_id.foreign([docs.filter("length(text) > 500").first().text], set(), np.random.default_rng(1))["shuffled"][0], None)
    for languages in (["en"], ["en", "de"], ["de", "en", "es", "fr"]):
        own = docs.filter(docs.lang.isin(languages))
        got = language_id.identify(own.union(spark.createDataFrame([russian, shuffled], docs.schema))).collect()
        assert all(r.accepted is False and r.language is None for r in got if r.doc_id < 0), languages
        assert sum(r.accepted for r in got if r.doc_id >= 0) > 0.98 * (len(got) - 2)


def test_languages_left_out_of_training_are_rejected():
    rows = [r for r in ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["text", "lang"]).to_pylist() if r["text"] and r["lang"]]
    for out in ("de", "fr"):
        known, other = [r for r in rows if r["lang"] != out], [r["text"] for r in rows if r["lang"] == out and len(r["text"]) > 200]
        model = language_id.train([r["text"] for r in known[::2]], [r["lang"] for r in known[::2]])
        assert model.verdicts(pa.array(other))[2].mean() < 0.1
        assert model.verdicts(pa.array([r["text"] for r in known[1::2]]))[2].mean() > 0.98
        assert model.false_reject < 0.01 and set(model.false_accept) == {"shuffled", "scripts", "left out"} and max(model.false_accept.values()) < 0.2


def test_every_label_is_learned_however_many_there_are(spark):
    def text(k, seed, n=60):
        own, rng = np.random.default_rng(k), np.random.default_rng((k, seed))
        words = ["".join(own.choice(list("abcdefghijklmnopqrstuvwxyz"), own.integers(3, 8))) for _ in range(40)]
        return " ".join(rng.choice(words, n))

    rows = [(100 * k + i, text(k, i), f"l{k:02}") for k in range(80) for i in range(6 if k < 79 else 1)]
    asked = [(-100 * k - i, text(k, 50 + i), None) for k in range(80) for i in range(1, 4)]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).filter("doc_id <= -1").collect()}
    right = [got[d].language == f"l{-d // 100:02}" for d, _, _ in asked]
    assert np.mean(right) > 0.9 and {r.language for r in got.values()} >= {f"l{k:02}" for k in range(79)}
    texts, labels = language_id.labelled_sample(docs, 300, 20_000, 160)
    assert len(texts) == 159 and len(set(labels)) == 80
    model = language_id.train(texts, labels)
    assert model.table.shape[0] == language_id.DIMENSIONS and model.languages == sorted(set(labels))


def test_odd_rows(spark):
    docs = table(spark)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(not got[i].accepted and got[i].language is None and got[i].confidence == 0 for i in (3, 4, 5, 12))
    kept = language_id.drop_rejected(docs)
    assert kept.columns == docs.columns and not {3, 4, 5, 12} & {r.doc_id for r in kept.collect()}
    assert language_id.identify(empty(spark)).count() == 0 and language_id.drop_rejected(empty(spark)).count() == 0
    text = spark.createDataFrame([("a-1", "the cat and the dog", "en", 1), ("7", "der hund", None, 2)], "doc_id string, text string, lang string, `x.y` int")
    assert sorted(str(r.doc_id) for r in language_id.identify(text).collect()) == ["7", "None"]
    assert language_id.drop_rejected(text).columns == text.columns
    bare = docs.drop("lang")
    assert language_id.identify(bare).filter("accepted").count() == 0
