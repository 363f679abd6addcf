"""Language identification by averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Texts are put in lower case; digits and ASCII punctuation count as white space. The subwords are byte n-grams (orders 2 to 4),
hashed into buckets. Every label that occurs is learned. A text's embedding is the mean over its n-grams, and a linear softmax over it gives the languages'
probabilities. Stochastic gradient descent in numpy trains embeddings and softmax on a sample of labelled rows, bounded by
``per_language`` rows of each language (the rows of least hash; fewer if all would be over ``max_train_rows``, but one at least) of up to ``max_train_chars`` characters; they are cut into passages, so
that short texts are met in training too. As mean and softmax are linear in the embeddings, scoring adds one row of a
buckets-by-languages table for each n-gram of the whole text; with more languages than dimensions it adds the embeddings themselves,
so that the work for an n-gram and the model stay bounded.

Held-out rows calibrate a temperature and two bounds, and a prediction is accepted if it keeps both. One is on the probability, which
tells the languages from each other: ``SURE``, or the ``false_reject`` quantile of what rightly predicted held-out texts get, if that is
less. The other is on the fit, which tells them from everything else, for any number of languages: the mean logarithm of how often the
text's n-grams occur in the training texts, with ``PRIOR`` usual n-grams added, so that short texts are judged mildly. It lies halfway between that
quantile of rightly predicted texts' fits and the ``NEGATIVE`` quantile of those of held-out texts made foreign (their language left out,
their letters shuffled, or replaced by those of scripts that training didn't meet), or at the former where the two overlap. The model holds the
shares of held-out texts that are wrongly rejected and of foreign ones that are wrongly accepted.

Defined cases: null, empty and letterless texts have no language: confidence 0, rejected. Rows without a label are scored but not
trained on; without any labelled row everything is rejected. With a single language only the fit counts. Ties go to the
language that sorts first. Repeated rows are scored alike. Ids that are no integers
count as null and stay. Empty tables give empty results. Extra columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm._spark import filtered, ident, mapped, pick
from gleaner.llm._text import segment_sums, text_bytes

BUCKET_BITS, ORDERS, DIMENSIONS = 15, (2, 3, 4), 16
_GAP = np.arange(256, dtype=np.uint8)
_GAP[[b for b in range(128) if not chr(b).isalpha()]] = 32
#: A text in two languages gets about a half for each, a foreign one little more than any language's share of one.
SURE = 0.42
PRIOR, NEGATIVE = 60, 0.99
#: Bounds the held-out texts, and passages, times languages.
CALIBRATION_CELLS = 8_000_000
_SCRIPTS = (0x3B1, 0x430, 0x5D0, 0x628, 0x905, 0xE01, 0x10D0, 0x3042, 0x4E00, 0xAC00)
SCORED = "doc_id bigint, language string, confidence double, accepted boolean"


def subwords(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of each n-gram, by order (the last bucket for none), bounds of the texts, and n-grams by text."""
    raw, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    raw = _GAP[raw]
    none = 1 << BUCKET_BITS
    code = raw.astype(np.uint32)
    ids, count = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    single = blank = raw == 32
    for n in range(2, max(ORDERS) + 1):
        later, also = np.full(len(raw), 32, dtype=np.uint32), np.ones(len(raw), dtype=bool)
        later[: -n + 1 or None], also[: -n + 1 or None] = raw[n - 1 :], single[n - 1 :]
        code = code | later << np.uint32(8 * (n - 1))
        blank = blank & also
        if n not in ORDERS:
            continue
        bucket = (((code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
        bucket[blank] = none
        for back in range(1, n):  # n-grams that would run over the end of their text
            at = offsets[1:] - back
            bucket[at[at >= offsets[:-1]]] = none
        ids.append(bucket)
        count += segment_sums((bucket != none).astype(np.int32), offsets)
    lettered = pc.match_substring_regex(column.cast(pa.large_string()), r"\pL").fill_null(False).to_numpy(zero_copy_only=False)
    return ids, offsets, np.where(lettered, count, 0)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # languages x buckets, or dimensions x buckets
    temperature: float
    threshold: float
    usual: np.ndarray | None = None  # logarithm of each bucket's share of the n-grams
    usual_fit: float = 0.0
    least_fit: float = -np.inf
    false_reject: float = 0.0
    false_accept: dict[str, float] | None = None  # by kind of foreign text
    out: np.ndarray | None = None  # dimensions x languages, if the table has dimensions

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each text by language, its fit, and its n-grams."""
        ids, offsets, count = subwords(column)
        total = np.zeros((len(self.table), len(offsets) - 1))
        for k, row in enumerate(self.table):
            for bucket in ids:
                total[k] += segment_sums(row[bucket], offsets)
        fit = np.full(len(count), PRIOR * self.usual_fit)
        if self.usual is not None:
            for bucket in ids:
                fit += segment_sums(self.usual[bucket], offsets)
        mean = (total / np.maximum(count, 1)).T
        return mean if self.out is None else mean @ self.out, fit / (count + PRIOR), count

    def probabilities(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        score, _, count = self.scores(column)
        return softmax(score / self.temperature), count

    def verdicts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language of each text, its probability, and whether it is accepted."""
        score, fit, count = self.scores(column)
        p = softmax(score / self.temperature)
        sure = np.where(count > 0, p.max(axis=1), 0.0)
        return p.argmax(axis=1), sure, (sure >= self.threshold) & (sure > 0) & (fit >= self.least_fit)


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True)) if score.size else score
    return e / e.sum(axis=1, keepdims=True)


def foreign(texts: list[str], seen: set[str], rng: np.random.Generator) -> dict[str, list[str]]:
    """The texts with their letters shuffled, and in letters of scripts of which none is ``seen``."""

    def shuffled(text: str) -> str:
        letters = np.array([c for c in text if c.isalpha()])
        order = iter(letters[rng.permutation(len(letters))].tolist())
        return "".join(next(order) if c.isalpha() else c for c in text)

    scripts = [x for x in _SCRIPTS if not any(chr(x + i) in seen for i in range(26))]
    other = [{c: chr(start + ord(c) % 26) for c in seen if c.isalpha()} for start in scripts]
    moved = ["".join(other[i % len(other)].get(c, c) for c in t.lower()) for i, t in enumerate(texts)] if other else []
    return {"shuffled": [shuffled(t.lower()) for t in texts], "scripts": moved}


def passages(texts: list[str], size: int) -> list[tuple[int, str]]:
    return [(i, t[a : a + size]) for i, t in enumerate(texts) for a in range(0, max(1, len(t)), size)]


def train(texts: list[str], labels: list[str], epochs: int = 2, least_steps: int = 400, rate: float = 20.0, batch: int = 64, held: float = 0.25, false_reject: float = 0.0005, seed: int = 3) -> Model:
    """The model of labelled texts; the last ``held`` part of them, in random order, calibrates it. Of each language one text trains at least."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    cut = max(1, int(len(order) * (1 - held)))
    target = np.searchsorted(languages, labels)
    absent = order[cut:][~np.isin(target[order[cut:]], target[order[:cut]])]
    absent = absent[np.unique(target[absent], return_index=True)[1]]
    order = np.r_[order[:cut], absent, order[cut:][~np.isin(order[cut:], absent)]]
    cut += len(absent)
    buckets = (1 << BUCKET_BITS) + 1
    wide = len(languages) > DIMENSIONS
    if wide:  # a language's share of the steps falls with their number
        rate, least_steps = rate * min(15.0, len(languages) / 5), least_steps * max(1, len(languages) // 80)
    deep = np.zeros((buckets, DIMENSIONS), dtype=np.float32)
    out = rng.normal(0, 1 / np.sqrt(DIMENSIONS), (DIMENSIONS, len(languages))).astype(np.float32)
    own = [texts[i] for i in order[:cut]]
    parts = [(i, t) for k, text in enumerate(own) for i, t in ((k, t) for _, t in passages([text], 60 if k % 4 == 0 else 300))]
    ids, offsets, _ = subwords(pa.array([t for _, t in parts]))
    grams = np.stack(ids, axis=1).ravel().astype(np.uint16)  # by position, so each passage's are together
    del ids
    real = grams != buckets - 1
    edges = np.r_[0, np.cumsum(segment_sums(real.astype(np.int32), offsets * len(ORDERS)))]
    grams = grams[real]
    del real
    goal = target[order[:cut]][[i for i, _ in parts]]
    epochs = max(epochs, -(-least_steps * batch // len(parts)))
    steps = epochs * -(-len(parts) // batch)
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(parts))
        for at in range(0, len(parts), batch):
            some = shuffled[at : at + batch]
            size = edges[some + 1] - edges[some]
            row = np.repeat(np.arange(len(some)), size)
            held_grams = grams[np.repeat(edges[some] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
            n = np.bincount(row, minlength=len(some))
            mean = segment_sums(deep[held_grams], np.r_[0, np.cumsum(n)]) / np.maximum(n, 1)[:, None]
            score = mean @ out
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), goal[some]] -= 1
            speed = rate * (1 - step / steps) / len(some)
            back = (p @ out.T) / np.maximum(n, 1)[:, None] * speed
            out -= 0.05 * speed * mean.T @ p
            for d in range(DIMENSIONS):
                deep[:, d] -= np.bincount(held_grams, weights=back[row, d], minlength=buckets)
            step += 1
    table = np.ascontiguousarray((deep if wide else deep @ out).T)
    table[:, -1] = 0
    model = Model(languages, table.astype(np.float32), 1.0, 0.0, out=out if wide else None)
    rest = [(texts[i], target[i]) for i in order[cut:]] or [(texts[i], target[i]) for i in order]
    most = max(500, CALIBRATION_CELLS // len(languages))
    rest = rest[:most]
    whole = [t for t, _ in rest]
    short = passages(whole, 60)
    if len(short) > most:
        short = [short[i] for i in rng.permutation(len(short))[:most]]
    true = every_true = np.array([y for _, y in rest] + [rest[i][1] for i, _ in short])
    check = pa.array(whole + [t for _, t in short])
    score, _, count = model.scores(check)
    score, true, count = score[count > 0], true[count > 0], count[count > 0]
    trials = []
    for temperature in np.geomspace(0.05, 20, 25):
        p = softmax(score / temperature)
        trials.append((-np.log(np.maximum(p[np.arange(len(true)), true], 1e-12)).mean() if len(true) else 0.0, float(temperature)))
    model.temperature = min(trials)[1]
    p = softmax(score / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == true]
    model.threshold = float(min(np.quantile(right, false_reject), SURE)) if len(right) else SURE

    def shares(k: int) -> np.ndarray:
        """Of each bucket among the n-grams of a language, none of them 0."""
        mine = np.flatnonzero(goal == k)
        size = edges[mine + 1] - edges[mine]
        many = np.bincount(grams[np.repeat(edges[mine] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())], minlength=buckets) + 0.5
        return many / many.sum()

    def logs(share: np.ndarray) -> np.ndarray:
        out = np.log(share).astype(np.float32)
        out[-1] = 0
        return out

    every = sum(shares(k) for k in range(len(languages)))
    model.usual = logs(every / len(languages))
    score, fit, count = model.scores(check)
    lettered = np.flatnonzero(count)
    if len(lettered):
        model.usual_fit = float((fit * (count + PRIOR))[lettered].sum() / count[lettered].sum())
    fit += model.usual_fit * PRIOR / (count + PRIOR)
    fits = fit[(count > 0) & (score.argmax(axis=1) == every_true)]
    some = rng.permutation(lettered)[:2000]
    texts_of = check.take(pa.array(some)).to_pylist()
    apart = {name: model.scores(pa.array(made))[1] for name, made in foreign(texts_of, set("".join(own).lower()), rng).items() if made}
    if len(languages) > 1:
        left = []
        for k in np.unique(every_true[some]):
            rest_model = Model(languages, table[:0], 1.0, 0.0, logs((every - shares(k)) / (len(languages) - 1)), model.usual_fit)
            left.append(rest_model.scores(pa.array([t for t, y in zip(texts_of, every_true[some], strict=True) if y == k]))[1])
        apart["left out"] = np.concatenate(left) if left else np.zeros(0)
    if len(fits):
        model.least_fit = float(np.quantile(fits, false_reject))
        far = [np.quantile(x, NEGATIVE) for x in apart.values() if len(x)]
        if far and max(far) < model.least_fit:
            model.least_fit = float(model.least_fit + max(far)) / 2
        model.false_reject = float((fits < model.least_fit).mean())
    model.false_accept = {name: float((x >= model.least_fit).mean()) for name, x in apart.items() if len(x)}
    return model


def labelled_sample(docs: DataFrame, per_language: int, max_train_chars: int, max_train_rows: int) -> tuple[list[str], list[str]]:
    """Texts and labels of the labelled rows of least hash, so many of each language."""
    rows = docs.select(*pick(docs, "doc_id", "text", "lang")).withColumn("lang", F.col("lang").cast("string")).filter("lang is not null and length(text) between 1 and " + str(max_train_chars))
    many = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not many:
        return [], []
    each = min(per_language, max(1, max_train_rows // len(many)))
    # about twice the rows needed pass the hash, so that the least are among them
    share = docs.sparkSession.createDataFrame([(k, int(min(1.0, 2 * each / n + 40 / n) * 2**62)) for k, n in many.items()], "lang string, share bigint")
    key = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 2)
    some = rows.withColumn("key", key).join(F.broadcast(share), "lang").filter("key <= share")
    least = Window.partitionBy("lang").orderBy("key", "text")
    some = some.withColumn("at", F.row_number().over(least)).filter(F.col("at") <= each)
    taken = sorted(some.select("key", "lang", "text").collect(), key=lambda r: (r.key, r.lang, r.text))
    return [r.text for r in taken], [r.lang for r in taken]


def model_of(docs: DataFrame, per_language: int = 300, max_train_chars: int = 20_000, max_train_rows: int = 19_200, false_reject: float = 0.0005) -> Model | None:
    """The model trained on a bounded sample of the labelled rows; none without them."""
    texts, labels = labelled_sample(docs, per_language, max_train_chars, max_train_rows)
    return train(texts, labels, false_reject=false_reject) if texts else None


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, language, confidence, accepted) of every row; language is null where rejected. ``options`` are those of model_of."""
    sent = docs.sparkSession.sparkContext.broadcast(model_of(docs, **options))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = sent.value
        n = batch.num_rows
        best, sure, accepted = model.verdicts(batch.column("text")) if model is not None else (np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=bool))
        names = pa.array([model.languages[k] if ok else None for k, ok in zip(best, accepted, strict=True)] if model is not None else [None] * n, pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), names, pa.array(sure), pa.array(accepted)], names=["doc_id", "language", "confidence", "accepted"])

    return mapped(docs.select(ident(docs), *pick(docs, "text")), "text", work, SCORED)


def drop_rejected(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose language is rejected, filtered in one scan. ``options`` are those of model_of."""
    sent = docs.sparkSession.sparkContext.broadcast(model_of(docs, **options))

    def accepted(texts: pa.Array) -> np.ndarray:
        return np.zeros(len(texts), dtype=bool) if sent.value is None else sent.value.verdicts(texts)[2]

    return filtered(docs, "text", accepted)
