"""Best-two-fit packing of documents into bins of ``capacity`` tokens (words).

A bin is filled greedily: the longest unpacked document, then ever the longest that still fits. If a gap remains, the bin's
smallest document is taken out in favour of the two unpacked documents that fill the expanded gap most, should they fill it
better; of pairs that fill it alike, the one with the longest document counts.

Documents of one length are interchangeable to this procedure, so it runs exactly, for the whole corpus at once, over the counts
of each length: as long as the counts allow the same choices, equal bins are made together. The driver's work and memory depend on
the capacity alone. Documents then find their bins by their rank among those of their length; ranks come from windows over
(length, salt), so that frequent lengths are spread over the cluster.

Documents longer than the capacity are cut into pieces of it and a rest. Defined cases: null texts and texts without words are in no
bin. A null doc_id is packed, as null, and so is one that is no integer. Repeated rows are packed each. Ranks in a length go by salt, then doc_id, then the text's
hash; for rows equal in all of these the order has no effect. Other columns play no part. An empty table gives no bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm._spark import ident, pick, written

SALTS, FULL_SALTS = 64, 4096  # of each length, and of pieces of the capacity, of which long documents make many
_RANK = 1 << 44


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as ({length: documents of that length}, how many such bins), in the order made. counts[n]: documents of length n."""
    left = np.array(counts[: capacity + 1], dtype=np.int64)
    left[0] = 0
    bins: list[tuple[dict[int, int], int]] = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return bins
        used: dict[int, int] = {}
        gap = capacity
        while True:  # greedy
            i = np.searchsorted(there, gap, side="right") - 1
            while i >= 0 and left[there[i]] <= used.get(int(there[i]), 0):
                i -= 1
            if i < 0:
                break
            n = int(there[i])
            k = min(gap // n, int(left[n]) - used.get(n, 0))
            used[n] = used.get(n, 0) + k
            gap -= k * n
            if not gap:
                break
        peak = dict(used)
        if gap:
            small = min(used)
            rest = left[there].copy()
            rest[np.searchsorted(there, list(used))] -= list(used.values())
            free, many = there[rest > 0], rest[rest > 0]
            room = gap + small
            if len(free):
                # for each longer document of a pair, the longest other one that is no longer than it
                most = np.minimum(room - free, free)
                at = np.searchsorted(free, most, side="right") - 1
                single = (at >= 0) & (free[np.maximum(at, 0)] == free) & (many < 2)
                at = np.where(single, at - 1, at)
                total = np.where(at >= 0, free + free[np.maximum(at, 0)], -1)
                best = int(total.max())
                if best > small:
                    long = int(free[np.flatnonzero(total == best)[-1]])
                    short = best - long
                    for n in (long, short):
                        used[n] = used.get(n, 0) + 1
                        peak[n] = peak.get(n, 0) + 1
                    used[small] -= 1
                    if not used[small]:
                        del used[small]
        # the same bin again, as long as every choice can be made again
        times = min((int(left[n]) - peak[n]) // u for n, u in used.items()) + 1
        for n, u in used.items():
            left[n] -= u * times
        bins.append((used, times))


def places(bins: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For spans of (length, rank), in order: where they start, their first bin, and how many of the length are in a bin."""
    start: dict[int, int] = {}
    rows = []
    first = 0
    for used, times in bins:
        for n, u in used.items():
            rows.append((n * _RANK + start.get(n, 0), first, u))
            start[n] = start.get(n, 0) + u * times
        first += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """(bin_id, n_tokens, doc_ids, pieces) of each bin; pieces: (doc_id, start, length) in words, the longest first."""
    spark = docs.sparkSession
    (text,) = pick(docs, "text")
    lengths = docs.select(ident(docs), F.xxhash64(text).alias("h"), F.regexp_count(text, F.lit(r"\S+")).alias("n")).filter("n > 0")
    parts = lengths.select("doc_id", "h", F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"(n - 1) div {capacity}").cast("int")), lambda i: F.struct((i * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - i * capacity).alias("length")))).alias("p"))
    salt = F.pmod(F.xxhash64("doc_id", "h", "p.start"), F.when(F.col("p.length") == capacity, FULL_SALTS).otherwise(SALTS)).cast("int")
    table = written(parts.select("doc_id", "h", F.col("p.start").cast("int").alias("start"), F.col("p.length").cast("int").alias("length"), salt.alias("salt")), "pieces")
    # a place for each length and salt; those of the capacity come last, so that they may be more
    counts = np.zeros(capacity * SALTS + FULL_SALTS, dtype=np.int64)
    for row in table.groupBy("length", "salt").count().collect():  # as many rows at most
        counts[row["length"] * SALTS + row["salt"]] = row["count"]
    edges = np.r_[np.arange(capacity + 1) * SALTS, len(counts)]
    done = np.r_[0, np.cumsum(counts)]
    before = done[:-1] - np.repeat(done[edges[:-1]], np.diff(edges))
    start, first, uses = places(plan(np.diff(done[edges]), capacity))
    sent = spark.sparkContext.broadcast((before, start, first, uses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, start, first, uses = sent.value
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "rank"))
            key = length * _RANK + before[length * SALTS + salt] + rank - 1
            at = np.searchsorted(start, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(first[at] + (key - start[at]) // uses[at]), batch.column("doc_id"), batch.column("start"), batch.column("length")], names=["bin_id", "doc_id", "start", "length"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "h", "start")
    placed = table.withColumn("rank", F.row_number().over(order)).select("doc_id", "start", "length", "salt", "rank").mapInArrow(run, "bin_id bigint, doc_id bigint, start int, length int")
    bins = placed.groupBy("bin_id").agg(F.sum("length").cast("int").alias("n_tokens"), F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("k"), "doc_id", "start", "length"))).alias("p"))
    piece = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length")))
    return bins.select("bin_id", "n_tokens", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), piece.alias("pieces"))
