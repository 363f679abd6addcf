"""Benchmark decontamination: test items found in documents within an edit budget.

Texts are compared in lower case with each run of white space as one space. An item of m characters has a budget of
k = floor(error_rate * m) insertions, deletions and substitutions. By the pigeonhole principle, a passage within k edits of an
item holds one of any k + 1 pieces of the item unchanged; so each item is split into k + 1 pieces, an Aho-Corasick automaton
finds all exact piece hits in one pass over each text, and around every hit Myers' bit-parallel algorithm computes the edit
distance of the whole item to the best passage. Nothing is sampled, and no hit is dropped: the search is exact.

An item without a budget, of under 1 / error_rate characters, is found where it stands unchanged between word boundaries.

Items travel to the executors in shards of bounded size (``shard_chars``), so what is sent at once does not grow with the
benchmark; each shard is one more scan of the documents.

Defined cases: null and empty texts hold nothing; items that are null or nothing but white space are not searched for, all others are,
however short. Rows are told apart by doc_id alone in the result: a repeated row gives its row again; a doc_id or item_id that is null, or no integer, gives
rows with null. Repeated items are each reported. Empty tables give an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gleaner.llm._spark import filtered, ident, pick, pieces

MATCH = "doc_id bigint, item_id bigint, distance int"


def plain(column: pa.Array) -> pa.Array:
    """Lower case, runs of white space as one space, none at the ends."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(column.cast(pa.large_string())), r"\s+", " "), " ")


def cut(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    edges = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def myers(peq: dict[str, int], m: int, text: str) -> int:
    """The least edit distance of the pattern to a substring of the text, by bit vectors of the pattern's length."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


class Matcher:
    """One shard of items: the automaton of their pieces and the bit masks of their characters."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.items = []
        for ident, text in items:
            budget = int(error_rate * len(text))
            for offset, piece in cut(text, budget):
                where[piece].append((len(self.items), offset))
            self.items.append((ident, text, budget, masks(text)))
        self.machine = ahocorasick.Automaton()
        for piece, places in where.items():
            self.machine.add_word(piece, (len(piece), places))
        if where:
            self.machine.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(item_id, distance) of the items that the text holds within their budgets."""
        hits: dict[int, set[int]] = defaultdict(set)
        if not self.items or not text:
            return
        for end, (size, places) in self.machine.iter(text):
            for item, offset in places:
                hits[item].add(end + 1 - size - offset)
        for item, starts in hits.items():
            ident, pattern, budget, peq = self.items[item]
            best, m = budget + 1, len(pattern)
            if not budget:
                if any(not text[i - 1 : i].isalnum() and not text[i + m : i + m + 1].isalnum() for i in starts):
                    yield ident, 0
                continue
            low = high = None
            for start in sorted(starts):  # where the item would begin; neighbouring places are searched together
                if low is not None and start <= high + 2 * budget:
                    high = start
                    continue
                if low is not None:
                    best = min(best, self.distance(peq, m, pattern, text, low, high, budget))
                low = high = start
            best = min(best, self.distance(peq, m, pattern, text, low, high, budget))
            if best <= budget:
                yield ident, best

    @staticmethod
    def distance(peq: dict[str, int], m: int, pattern: str, text: str, low: int, high: int, budget: int) -> int:
        passage = text[max(0, low - budget) : high + m + budget]
        return 0 if pattern in passage else myers(peq, m, passage)


#: One automaton a Python worker, with the shard that it was made of.
_matcher: list = []


def matcher_of(shard: list[tuple[int, str]], error_rate: float) -> Matcher:
    if not _matcher or _matcher[0] is not shard or _matcher[1] != error_rate:
        _matcher[:] = shard, error_rate, Matcher(shard, error_rate)
    return _matcher[2]


def _shards(items: DataFrame, shard_chars: int) -> Iterator[list[tuple[int, str]]]:
    shard, size = [], 0
    for row in items.select(ident(items, "item_id"), *pick(items, "text")).filter("text is not null").toLocalIterator():
        text = plain(pa.array([row.text])).to_pylist()[0]
        if not text:
            continue
        if shard and size + len(text) > shard_chars:
            yield shard
            shard, size = [], 0
        shard.append((row.item_id, text))
        size += len(text)
    if shard:
        yield shard


def contaminated(docs: DataFrame, items: DataFrame, error_rate: float = 0.05, shard_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, distance) of every item within its edit budget in a document."""
    spark = docs.sparkSession
    slim = docs.select(ident(docs), *pick(docs, "text"))
    out = None
    for shard in _shards(items, shard_chars):
        sent = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(sent.value, error_rate)
            for batch in batches:
                for part in pieces(batch, "text"):
                    found = [(i, *m) for i, t in enumerate(plain(part.column("text")).to_pylist()) for m in matcher.find(t or "")]
                    if found:
                        row, item, distance = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), pa.array(distance, pa.int32())], names=["doc_id", "item_id", "distance"])

        one = slim.mapInArrow(run, MATCH)
        out = one if out is None else out.unionAll(one)
    return spark.createDataFrame([], MATCH) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, error_rate: float = 0.05, shard_chars: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows whose own text holds an item; ids play no part. Each shard filters in one scan what is left."""
    for shard in _shards(items, shard_chars):
        sent = docs.sparkSession.sparkContext.broadcast(shard)

        def clean(texts: pa.Array, sent=sent) -> np.ndarray:
            matcher = matcher_of(sent.value, error_rate)
            return np.array([next(matcher.find(t or ""), None) is None for t in plain(texts).to_pylist()], dtype=bool)

        docs = filtered(docs, "text", clean)
    return docs
