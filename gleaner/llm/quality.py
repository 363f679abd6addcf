"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its words (lower case, hashed into buckets, counts scaled to unit length), statistics of its structure (length,
shares of upper case, digits, symbols and line ends, word lengths, share of distinct words and lines), and hashed language
and source. The score is bias + sum of w_i x_i + the interactions of all pairs, <v_i, v_j> x_i x_j, with vectors of low rank. Their sum
takes linear time by the identity: half of sum over f of (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2.

Adagrad in numpy trains it on labelled rows, bounded by ``sample`` rows (those of least hash) of up to ``max_train_chars``
characters. Held-out good rows set the threshold: the ``false_reject`` quantile of their scores, but 0.5 at most.

Defined cases: null and empty texts, and those without words, have quality 0 and are not kept. Missing lang or source hash as null.
Labels other than 0 and 1 and labels without a document are left out; a document with several labels counts with each. Without labels
of both kinds there is no model: texts with words get 0.5 and are kept. Ids that are no integers count as null. Labelled rows alike in their id's hash are taken by id, then label; repeated rows are scored alike. Empty tables give
empty results; extra columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._spark import ident, mapped, pick
from gleaner.llm._text import hash_spans, segment_sums, text_bytes, word_spans

WORD_BITS, META, STATS, RANK = 14, 64, 10, 4
SIZE = (1 << WORD_BITS) + META + STATS
SCORED = "doc_id bigint, quality double, keep boolean"
_KIND = np.zeros(256, dtype=np.int64)  # 1 upper, 2 digit, 3 symbol, 4 line end
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = 1 if _c.isupper() else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c not in " \t\r.,;:'\"()-?" and not _c.isalnum() and _b > 31 else 0


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """How many distinct values each group has."""
    if not len(value):
        return np.zeros(groups)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
    return np.bincount(g[new], minlength=groups)


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows as (bounds, feature, value), and the words of each text. Columns: text, lang, source."""
    raw, offsets = text_bytes(batch.column("text"))
    rows = len(offsets) - 1
    lower, low_offsets = text_bytes(pc.utf8_lower(batch.column("text").cast(pa.large_string())))
    starts, ends, before = word_spans(lower, low_offsets)
    words, many = hash_spans(lower, starts, ends), np.diff(before)
    row = np.repeat(np.arange(rows), many)
    key = np.sort(row << WORD_BITS | (words >> np.uint64(64 - WORD_BITS)).astype(np.int64))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(key)]).astype(np.float64)
    feature, owner = key[new] & ((1 << WORD_BITS) - 1), key[new] >> WORD_BITS
    value = count / np.sqrt(np.maximum(np.bincount(owner, weights=count * count, minlength=rows), 1))[owner]
    size = np.maximum(np.diff(offsets), 1)
    kind = np.bincount(np.repeat(np.arange(rows), np.diff(offsets)) * 5 + _KIND[raw], minlength=rows * 5).reshape(rows, 5) / size[:, None]
    ends_at = np.flatnonzero(raw == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], ends_at[ends_at + 1 < len(raw)] + 1]))
    line_ends = np.r_[line_starts[1:], len(raw)]
    line_row = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = np.bincount(line_row, minlength=rows)
    length = np.maximum(many, 1)
    word_length = np.bincount(row, weights=(ends - starts).astype(np.float64), minlength=rows) / length
    short = np.bincount(row, weights=(ends - starts <= 3).astype(np.float64), minlength=rows) / length
    stats = np.stack([np.log1p(many) / 10, kind[:, 1], kind[:, 2], kind[:, 3] * 2, np.minimum(kind[:, 4] * 20, 1), np.minimum(word_length / 10, 2), short, _distinct(row, words, rows) / length, _distinct(line_row, hash_spans(raw, line_starts, line_ends), rows) / np.maximum(lines, 1), np.ones(rows)], axis=1)
    meta = []
    for j, name in enumerate(("lang", "source")):
        data, at = text_bytes(batch.column(name))
        meta.append((hash_spans(data, at[:-1], at[1:], seed=j + 1) % np.uint64(META)).astype(np.int64) + (1 << WORD_BITS))
    dense = np.concatenate([np.stack(meta, axis=1), np.broadcast_to(np.arange(STATS) + (1 << WORD_BITS) + META, (rows, STATS))], axis=1)
    values = np.concatenate([np.full((rows, 2), 0.3), stats], axis=1)
    width = dense.shape[1]
    order = np.argsort(np.concatenate([owner, np.repeat(np.arange(rows), width)]), kind="stable")
    bounds = np.r_[0, np.cumsum(np.bincount(owner, minlength=rows) + width)]
    return bounds, np.concatenate([feature, dense.ravel()])[order], np.concatenate([value, values.ravel()])[order], many


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # SIZE
    factor: np.ndarray  # SIZE x RANK
    threshold: float = 0.5

    def scores(self, bounds: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        total = self.bias + segment_sums(self.weight[feature] * value, bounds)
        for f in range(self.factor.shape[1]):
            part = self.factor[:, f][feature] * value
            total += (segment_sums(part, bounds) ** 2 - segment_sums(part * part, bounds)) / 2
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(batch: pa.RecordBatch, label: np.ndarray, epochs: int = 8, rate: float = 0.15, size: int = 64, decay: float = 1e-5, held: float = 0.3, false_reject: float = 0.002, seed: int = 4) -> Machine:
    """The machine of labelled rows; the last ``held`` part of them, in random order, sets its threshold."""
    bounds, feature, value, _ = features(batch)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(label))
    cut = max(1, int(len(order) * (1 - held)))
    m = Machine(float(np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3))), np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK)))
    seen_w, seen_v = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6)
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-3), 0.5 / max(1 - label.mean(), 1e-3))
    for _ in range(epochs):
        for at in range(0, cut, size):
            some = rng.permutation(order[:cut])[:size] if at else order[:cut][rng.permutation(cut)[:size]]
            index = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some])
            edge = np.r_[0, np.cumsum(bounds[some + 1] - bounds[some])]
            f, x = feature[index], value[index]
            row = np.repeat(np.arange(len(some)), np.diff(edge))
            error = (m.scores(edge, f, x) - label[some]) * weight[some] / len(some)
            used, place = np.unique(f, return_inverse=True)
            g = np.bincount(place, weights=error[row] * x) + decay * m.weight[used]
            seen_w[used] += g * g
            m.weight[used] -= rate * g / np.sqrt(seen_w[used])
            m.bias -= rate * 0.1 * error.sum()
            for k in range(RANK):
                v = m.factor[f, k]
                total = segment_sums(v * x, edge)
                g = np.bincount(place, weights=error[row] * (x * total[row] - v * x * x)) + decay * m.factor[used, k]
                seen_v[used, k] += g * g
                m.factor[used, k] -= rate * 0.3 * g / np.sqrt(seen_v[used, k])
    rest = order[cut:] if len(order) > cut else order
    good = rest[label[rest] == 1]
    if len(good):
        index = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in good])
        p = m.scores(np.r_[0, np.cumsum(bounds[good + 1] - bounds[good])], feature[index], value[index])
        m.threshold = float(min(np.quantile(p, false_reject), 0.5))
    return m


def labelled(docs: DataFrame, labels: DataFrame, name: str, sample: int, max_train_chars: int) -> list:
    """(text, lang, source, label) of up to ``sample`` labelled rows, those whose ids' hashes are least."""
    (kind,) = pick(labels, name)
    some = labels.select(ident(labels).alias("ident"), kind.try_cast("int").alias("label")).filter("ident is not null and label in (0, 1)").distinct().orderBy(F.xxhash64("ident", F.lit(4)), "ident", "label").limit(sample)
    rows = docs.select(ident(docs), *pick(docs, "text", "lang", "source")).filter(f"length(text) between 1 and {max_train_chars}")
    # the broadcast side has ``sample`` rows of two numbers at most
    found = rows.join(F.broadcast(some), F.col("doc_id") == F.col("ident")).select("text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "label").collect()
    return sorted(found, key=lambda r: (r.text, r.label, r.lang or "", r.source or ""))


def assess(docs: DataFrame, labels: DataFrame, sample: int = 6000, max_train_chars: int = 20_000, false_reject: float = 0.002) -> DataFrame:
    """(doc_id, quality, keep) of every row."""
    spark = docs.sparkSession
    rows = labelled(docs, labels, "quality", sample, max_train_chars)
    y = np.array([r.label for r in rows], dtype=np.float64)
    machine = None
    if len(set(y)) == 2:
        columns = [pa.array([r[c] for r in rows], pa.string()) for c in ("text", "lang", "source")]
        machine = train(pa.RecordBatch.from_arrays(columns, names=["text", "lang", "source"]), y, false_reject=false_reject)
    sent = spark.sparkContext.broadcast(machine)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bounds, feature, value, many = features(batch)
        m = sent.value
        p = np.where(many > 0, 0.5 if m is None else m.scores(bounds, feature, value), 0.0)
        keep = (many > 0) & (p >= (0.5 if m is None else m.threshold))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(keep)], names=["doc_id", "quality", "keep"])

    text, lang, source = pick(docs, "text", "lang", "source")
    return mapped(docs.select(ident(docs), text, lang.cast("string").alias("lang"), source.cast("string").alias("source")), "text", work, SCORED)
