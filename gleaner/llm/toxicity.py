"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the hashed words that a text holds (lower case, ASCII punctuation removed) learns from confirmed toxic texts and unlabelled
ones. With class prior pi and loss l, the risk is pi E+[l(f)] + max(0, Eu[l(-f)] - pi E+[l(-f)]): the unlabelled texts' risk as
clean ones is corrected by the toxic part among them, and where that estimate falls below zero, which is over-fitting, a step is
taken to raise it again. Adam in numpy trains it. Only words that are more frequent in toxic training texts than in the documents
as a whole, by a likelihood ratio of ``least``, weigh anything, so that long texts do not add up the noise of all others.

Only the weights are fitted on a bounded sample: ``positives`` toxic rows and ``unlabelled`` rows, those of least hash, of up to ``max_train_chars``
characters; of near-copies among the toxic ones the first counts. The words' frequencies and the share of texts above each threshold are counted over all documents. The prior is a parameter; by
default it is the share of toxic rows among all labelled ones.

The best threshold is that for which the held-out toxic texts' recall squared, by the number of all documents above it, is greatest; that is
proportional to recall times precision, neither of which clean labels are needed for. The one used lies halfway from there to the least at which one more
held-out text would make up for the documents that it adds.

Defined cases: null and empty texts and those without words are not toxic. Only labels of toxic = 1 are used as such, repeated ones once; null labels
count for nothing, and ids that are no integers as null. Without toxic examples, or where no word tells them apart, nothing is toxic. Rows of equal hash are ordered by
their texts; of thresholds that do equally well the least counts. Repeated rows are scored alike. Empty tables give empty
results; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._spark import ident, mapped, pick, pieces, written
from gleaner.llm.near_dedup import hamming, signatures
from gleaner.llm._text import hash_spans, plain_bytes, segment_sums, word_spans

BITS = 22
NEAR = 56  # bits of 256 in which texts of a group of copies differ


def words_held(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts and the distinct buckets of each."""
    raw, offsets = plain_bytes(column)
    starts, ends, before = word_spans(raw, offsets)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(before))
    key = np.sort(row << BITS | (hash_spans(raw, starts, ends, seed=9) >> np.uint64(64 - BITS)).astype(np.int64))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return np.searchsorted(key >> BITS, np.arange(rows + 1)), key & ((1 << BITS) - 1)


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def scores(self, bounds: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return self.bias + segment_sums(self.weight[bucket], bounds)


def sparse(texts: list[str], at_once: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """As words_held, a few texts at a time, so that only the result takes memory."""
    bounds, buckets = [np.zeros(1, np.int64)], []
    for i in range(0, len(texts), at_once):
        b, k = words_held(pa.array(texts[i : i + at_once], pa.string()))
        bounds.append(b[1:] + bounds[-1][-1])
        buckets.append(k.astype(np.int32))
    return np.concatenate(bounds), np.concatenate(buckets)


def telling(count: np.ndarray, rest: np.ndarray, n_toxic: int, n_others: int, least: float) -> np.ndarray:
    """Which words are more frequent in toxic texts than in others, by a likelihood ratio (G squared) of ``least`` or more.

    ``count`` and ``rest``: how many texts of each kind hold a word.
    """
    count, rest = count.astype(np.float64), rest.astype(np.float64)
    share = (count + rest) / (n_toxic + n_others)
    total = np.zeros(len(count))
    for held, n in ((count, n_toxic), (rest, n_others)):
        for k, q in ((held, share), (n - held, 1 - share)):
            some = k > 0
            total[some] += 2 * k[some] * np.log(k[some] / (n * q[some]))
    return (total >= least) & (count * n_others > rest * n_toxic)


def risk(f_toxic: np.ndarray, f_unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The toxic part of the risk, the corrected clean part before it is cut off at 0, and the slope by score of what a step lowers.

    Logistic loss: l(f) = log(1 + exp(-f)), with slope -sigmoid(-f); l(-f) has slope sigmoid(f). A step lowers the sum of both parts, or raises the
    clean part alone where that is negative.
    """
    n_p, n_u = len(f_toxic), len(f_unlabelled)
    positive = prior * np.logaddexp(0, -f_toxic).mean()
    negative = np.logaddexp(0, f_unlabelled).mean() - prior * np.logaddexp(0, f_toxic).mean()
    slope = np.concatenate([-prior / n_p * sigmoid(f_toxic), sigmoid(f_unlabelled) / n_u])
    if negative < 0:
        return positive, negative, -slope
    slope[:n_p] -= prior / n_p * sigmoid(-f_toxic)
    return positive, negative, slope


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(toxic: list[str], unlabelled: list[str], prior: float, used: np.ndarray, epochs: int = 120, size: int = 8192, rate: float = 0.02, held: float = 0.25, seed: int = 9) -> tuple[Model, np.ndarray]:
    """The model over the ``used`` words, of the first part of both kinds of texts in random order, and the scores of the toxic texts held out."""
    bounds, bucket = sparse(toxic + unlabelled)
    rng = np.random.default_rng(seed)
    p, p_held = split(len(toxic), held, rng)
    u = rng.permutation(len(unlabelled)) + len(toxic)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    tells = place[bucket] >= 0
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    own, edges = place[bucket[tells]], np.searchsorted(owner[tells], np.arange(len(bounds)))
    del bucket, owner, tells
    w, bias = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    first, second, step = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0
    batches = max(1, -(-len(u) // size))
    for _ in range(epochs):
        p, u = rng.permutation(p), rng.permutation(u)
        for k in range(batches):
            some_p = p[np.arange(k * size, k * size + min(size, len(p))) % len(p)]
            some_u = u[k * size : (k + 1) * size]
            some = np.concatenate([some_p, some_u])
            count = edges[some + 1] - edges[some]
            edge = np.r_[0, np.cumsum(count)]
            feature = own[np.repeat(edges[some] - edge[:-1], count) + np.arange(edge[-1])]
            f = bias + segment_sums(w[feature], edge)
            _, _, slope = risk(f[: len(some_p)], f[len(some_p) :], prior)
            g = np.append(np.bincount(feature, weights=np.repeat(slope, count), minlength=len(used)), slope.sum())
            step += 1
            first = 0.9 * first + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-5)
            w -= move[:-1]
            bias -= move[-1]
    weight = np.zeros(1 << BITS, dtype=np.float32)
    weight[used] = w
    model = Model(weight, float(bias))
    return model, np.sort(model.scores(*sparse([toxic[i] for i in (p_held if len(p_held) else p)])))


def split(n: int, held: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Numbers below n in random order, in a part to train on and a ``held`` part."""
    return np.split(rng.permutation(n), [max(1, int(n * (1 - held)))])


def edges_of(model: Model, levels: np.ndarray) -> np.ndarray:
    """Scores to count documents at: those of held-out toxic texts, ``levels``, and a grid from texts without telling words on, in order."""
    return np.unique(np.r_[levels, np.linspace(min(model.bias, levels[0]), levels[-1], 4096)])


def threshold(levels: np.ndarray, edges: np.ndarray, above: np.ndarray) -> float:
    """The score from which texts are toxic; ``above``: how many documents reach each of the ``edges``."""
    recall = 1 - np.searchsorted(levels, edges) / len(levels)
    above = np.maximum(above, 1)
    best = int(np.argmax(recall**2 / above))
    # held-out texts are few: the documents that catching one more of them would be worth lie between here and the best place
    worth = above[best] * (1 + 1 / (len(levels) * recall[best])) ** 2
    return float((edges[best] + edges[np.argmax(above <= worth)]) / 2)


def distinct(texts: list[str]) -> list[str]:
    """The texts without near-duplicates of those before: copies of a text would make all its words telling."""
    sig, has = signatures(pa.array(texts, pa.string()))
    kept: list[int] = []
    for i in range(len(texts)):
        if not (has[i] and (hamming(sig[kept], sig[i]) <= NEAR).any()):
            kept.append(i)
    return [texts[i] for i in kept]


def sampled(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int, max_train_chars: int) -> tuple[list[str], list[str], float, int]:
    """Toxic texts, unlabelled texts, the share of toxic rows among the labelled, and the number of documents."""
    (toxic,) = pick(labels, "toxic")
    known = labels.select(ident(labels).alias("ident"), toxic.try_cast("int").alias("toxic")).filter("ident is not null and toxic in (0, 1)").distinct()
    share = known.agg(F.avg("toxic")).first()[0]
    some = known.filter("toxic = 1").orderBy(F.xxhash64("ident", F.lit(9)), "ident").limit(positives)
    rows = docs.select(ident(docs), *pick(docs, "text")).filter(f"length(text) between 1 and {max_train_chars}")
    total = docs.count()
    key = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(9)), 2)
    limit = int(min(1.0, (1.1 * unlabelled + 200) / max(total, 1)) * 2**62)
    # the broadcast side has ``positives`` rows of two numbers at most
    both = rows.withColumn("key", key).join(F.broadcast(some), F.col("doc_id") == F.col("ident"), "left").filter((F.col("toxic") == 1) | (F.col("key") <= limit))
    # of the unlabelled, the hash admits a few more than wanted, and the least are kept
    found = sorted(both.select("key", F.coalesce("toxic", F.lit(0)).alias("toxic"), "text").collect(), key=lambda r: (r.key, r.text))
    return distinct([r.text for r in found if r.toxic]), [r.text for r in found if r.key <= limit][:unlabelled], float(share or 0.0), total


def frequencies(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """How many of all documents hold each of the ``words``, which are in order."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.full(1 << BITS, -1, dtype=np.int32)
        wanted[sent.value] = np.arange(len(sent.value))
        count = np.zeros(len(sent.value), dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                at = wanted[words_held(part.column("text"))[1]]
                count += np.bincount(at[at >= 0], minlength=len(count))
        seen = np.flatnonzero(count)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen])], names=["word", "n"])

    out = np.zeros(len(words), dtype=np.int64)
    # as many rows as the toxic training texts have words, at most
    for r in docs.select(*pick(docs, "text")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


def fitted(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 8000, max_train_chars: int = 20_000, prior: float | None = None, least: float = 30.0) -> tuple[Model, np.ndarray] | None:
    """The model, and the scores of the toxic texts held out; none without examples or words that tell them."""
    toxic, others, share, total = sampled(docs, labels, positives, unlabelled, max_train_chars)
    if not toxic or not others:
        return None
    rng = np.random.default_rng(9)
    bounds, bucket = sparse([toxic[i] for i in split(len(toxic), 0.25, rng)[0]])
    words, count = np.unique(bucket, return_counts=True)
    used = words[telling(count, frequencies(docs, words), len(bounds) - 1, total, least)]
    if not len(used):
        return None
    return train(toxic, others, min(max(share if prior is None else prior, 1e-3), 0.9), used)


def detect(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, toxicity, toxic) of every row; toxicity is the probability under the model, toxic from 0.5 on. ``options`` are those of fitted."""
    spark = docs.sparkSession
    found = fitted(docs, labels, **options)
    sent = spark.sparkContext.broadcast(found[0] if found else None)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = sent.value
        if model is None:
            score = np.full(batch.num_rows, -np.inf)
        else:
            bounds, bucket = words_held(batch.column("text"))
            score = np.where(bounds[1:] > bounds[:-1], model.scores(bounds, bucket), -np.inf)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = mapped(docs.select(ident(docs), *pick(docs, "text")), "text", work, "doc_id bigint, score double")
    if not found:
        return scored.select("doc_id", F.lit(0.0).alias("toxicity"), F.lit(False).alias("toxic"))
    scored = written(scored, "scores")
    edges = edges_of(*found)
    counts = np.zeros(len(edges) + 1, dtype=np.int64)
    for r in binned(scored, edges).collect():  # a row an edge at most
        counts[r.bin] = r.n
    cut = threshold(found[1], edges, np.cumsum(counts[::-1])[::-1][1:])
    p = F.when(F.col("score") > float("-inf"), 1 / (1 + F.exp(F.lit(cut) - F.col("score")))).otherwise(0.0)
    return scored.select("doc_id", p.alias("toxicity"), (F.col("score") >= F.lit(cut)).alias("toxic"))


def binned(scored: DataFrame, levels: np.ndarray) -> DataFrame:
    """(bin, n): how many scores lie at or above exactly ``bin`` of the ``levels``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(len(levels) + 1, dtype=np.int64)
        for batch in batches:
            many += np.bincount(np.searchsorted(levels, batch.column("score").to_numpy(zero_copy_only=False), side="right"), minlength=len(many))
        seen = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(many[seen])], names=["bin", "n"])

    return scored.select("score").mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
