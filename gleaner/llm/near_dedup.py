"""SimHash near-duplicate groups, found with an LSH forest and verified by Hamming distance.

Every document gets a 256-bit SimHash of its words and its pairs of neighbouring words (lower case, ASCII punctuation removed; words of
up to four bytes weigh a tenth, as they carry little). Copies that agree in all bits are joined first, by a plain group-by, so that thousands of exact
copies cost one row. The other signatures go through several tries, each over its own random permutation of the bits. A node
with few signatures is compared whole, at the shortest prefix where it is that small; a dense one is split by further bits,
but never deeper than the prefix at which the tries together reach the target recall at the greatest distance that links. Depth
and number of tries follow from the number of signatures: the depth grows with its logarithm and the tries with a power of it
(about 0.37), so that any pair that counts, also one at that distance in a group of two, is met with the target recall at every
size. Leaves are compared exhaustively, large ones by pivots, which is exact for groups;
every link is verified on all 256 bits. The links' connected components are the groups.

What this costs: the tries grow with the corpus, since no forest of single bits can hold a recall at a fixed distance otherwise: 16 at
2e5 distinct signatures, 61 at 5e6, 104 at 3e7, 397 at 1e9, each one row of 48 bytes for a signature.

Defined results: each row is a document. Null text and texts without words have no signature and are in no group. Rows that share a doc_id but
not the text are told apart, and so are rows with a null doc_id, or one that is no integer, which counts as null. Rows alike in doc_id and text are copies of
each other; the stage keeps the one whose other columns hash least. Of a group the row with the least doc_id stays, null being the greatest, of equal ones that
whose text hashes least. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm._spark import fresh, ident, mapped, pick, shuffle_partitions, written
from gleaner.llm._text import hash_spans, mix, plain_bytes, word_spans
from gleaner.llm.components import connected_components

BITS = 256
LIGHT_BYTES, LIGHT_WEIGHT = 4, 0.1
_BYTE_BITS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1)
_COUNT = np.array([bin(i).count("1") for i in range(65536)], dtype=np.uint8)
_SEEDS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64))
_NAMES = [f"s{k}" for k in range(BITS // 64)]
_MEMBER = "a bigint, b bigint"
#: Within a node: rows up to which nodes are compared by shifts; the work of comparing a row with one of its node (half of them),
#: where that of placing it in a try is 1; the deepest path, which float32 must hold; paths held and pairs compared at once;
#: by how much a group's square must exceed its node's rows to be set apart.
SHIFTED, PAIR, MOST_DEPTH, KEYS, BLOCK, PEEL = 96, 0.03, 24, 1 << 22, 1 << 16, 100


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """256-bit signatures as four uint64 a row, and which rows have one."""
    raw, offsets = plain_bytes(column)
    starts, ends, before = word_spans(raw, offsets)
    rows, many = len(offsets) - 1, np.diff(before)
    out = np.zeros((rows, BITS // 64), dtype=np.uint64)
    words = hash_spans(raw, starts, ends)
    weight = np.where(ends - starts > LIGHT_BYTES, 1.0, LIGHT_WEIGHT)
    row = np.repeat(np.arange(rows, dtype=np.int64) * 256, many)
    inside = np.flatnonzero(row[1:] == row[:-1])
    pairs = mix(words[inside] * np.uint64(3) + words[inside + 1])
    for k, seed in enumerate(_SEEDS):
        code, double = (mix(x + seed).view(np.uint8).reshape(-1, 8) for x in (words, pairs))
        for j in range(8):
            held = np.bincount(row + code[:, j], weights=weight, minlength=rows * 256) + np.bincount(row[inside] + double[:, j], minlength=rows * 256)
            out[:, k] |= np.packbits(np.rint(held.reshape(rows, 256) @ _BYTE_BITS * 10) > 0, axis=1)[:, 0].astype(np.uint64) << np.uint64(8 * j)
    return out, many > 0


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of signatures, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def signature_table(docs: DataFrame) -> DataFrame:
    """(k, h, doc_id, s0, s1, s2, s3) of each row that has words; k and h are hashes of id and text, and of the text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig, has = signatures(batch.column("text"))
        keep = pa.array(has)
        s = np.ascontiguousarray(sig.view(np.int64)[has])
        return pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("k", "h", "doc_id")), *(pa.array(s[:, k]) for k in range(4))], names=["k", "h", "doc_id", *_NAMES])

    rows = docs.select(ident(docs), *pick(docs, "text")).select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", "text")
    return mapped(rows, "text", work, "k bigint, h bigint, doc_id bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes by which rows that differ in id or text are told apart."""
    return F.xxhash64(doc_id, text).alias("k"), F.xxhash64(text, F.lit(1)).alias("h")


def forest_shape(rows: int, distance: int, recall: float, leaf: int, within: float = 1.0) -> tuple[int, int]:
    """Depth at which ``rows`` random signatures have about ``leaf`` in a node, and the tries that reach the recall there.

    A try meets a pair at ``distance`` if none of its bits, drawn without replacement, is one of those that differ, and a pair
    that shares a node is found with the probability ``within``.

    Rows that fit one node are compared whole, at the root of a single trie.
    """
    if rows <= leaf:
        return 0, 1
    depth = max(1, math.ceil(math.log2(rows / leaf)))
    met = within * math.prod((BITS - distance - i) / (BITS - i) for i in range(depth))
    return depth, max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def node_shape(near: np.ndarray, rows: int, bits: int, distance: int, recall: float) -> tuple[int, int]:
    """Depth and number of the tries within a node of ``rows`` signatures that are the least work; 0 and 1 if that is to compare it whole.

    ``near``: distances of some of its pairs, from which the work at each depth follows. ``bits``: those that the node's own path leaves.
    """
    best, shape, met, agree = 1 + rows * PAIR, (0, 1), 1.0, np.ones(len(near))
    for depth in range(1, MOST_DEPTH + 1):
        met *= max(0, bits - distance - depth + 1) / (bits - depth + 1)
        agree *= np.maximum(0, bits - near - depth + 1) / (bits - depth + 1)
        if not met:
            break
        tries = 1 if met == 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))
        if (work := tries * (1 + rows * PAIR * agree.mean())) < best:
            best, shape = work, (depth, tries)
    return shape


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the first 192, by word columns: if they are too many, so are those of all."""
    out = np.bitwise_count(a[0] ^ b[0])
    for k in (1, 2):
        out += np.bitwise_count(a[k] ^ b[k])
    return out


def _close(words: np.ndarray, size: np.ndarray, limit: int, leaf: int, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links, as pairs of positions, whose components are those of all close pairs within nodes.

    ``words``: four columns of signatures, node by node; ``size``: of each row's node. Nodes of up to ``leaf`` rows are compared by
    shifting the columns, which can also meet rows of the next nodes, larger ones in blocks. ``known``: labels of rows that are
    linked already.
    """

    def verified(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = known[x] != known[y]
        x, y = x[new], y[new]
        near = np.bitwise_count(words[:, x] ^ words[:, y]).sum(axis=0, dtype=np.int32) <= limit
        return x[near], y[near]

    at = np.flatnonzero((size > 1) & (size <= leaf))
    most, cols = size[at], words[:3, at]
    step = 1
    while len(at) > step:
        hits = np.flatnonzero(_apart(cols[:, :-step], cols[:, step:]) <= limit)
        if len(hits):
            yield verified(at[hits], at[hits + step])
        step += 1
        on = most > step
        if np.count_nonzero(on) < 0.8 * len(at):
            at, most, cols = at[on], most[on], cols[:, on]

    def blocks(one: np.ndarray, other: np.ndarray, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All of one against all of the other; of the same rows each pair once."""
        high, cols = max(1, BLOCK // len(other)), np.ascontiguousarray(words[:3, other])
        for i in range(0, len(one), high):
            top = one[i : i + high]
            for j in range(i if both else 0, len(other), BLOCK):
                x, y = np.nonzero(_apart(words[:3, top, None], cols[:, None, j : j + BLOCK]) <= limit)
                if len(x):
                    x, y = top[x], other[j + y]
                    yield verified(x[x != y], y[x != y])

    start = 0
    wide = np.flatnonzero(size > leaf)
    while start < len(wide):
        rows = wide[start : start + size[wide[start]]]
        start += len(rows)
        while len(rows) > 1:
            # rows of one group need not meet each other, only the others: one that is known, or those near some row
            _, at, many = np.unique(known[rows], return_inverse=True, return_counts=True)
            near, pivot = at == many.argmax(), None
            if many.max() ** 2 < PEEL * len(rows):
                for row in rows[np.linspace(0, len(rows) - 1, 8).astype(int)]:
                    close = np.bitwise_count(words[:, rows] ^ words[:, row, None]).sum(axis=0, dtype=np.int32) <= limit
                    if pivot is None or np.count_nonzero(close) > np.count_nonzero(near):
                        near, pivot = close, row
            group, rest = rows[near], rows[~near]
            if len(group) ** 2 < PEEL * len(rows):
                yield from blocks(rows, rows, True)
                break
            if pivot is not None:
                yield np.full(len(group), pivot), group
            if len(rest):
                yield from blocks(group, rest, False)
            rows = rest


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels, each the least row of its component, after links between x and y."""
    x, y = label[x], label[y]
    new = x != y
    if not new.any():
        return label
    x, y = x[new], y[new]
    top = np.arange(len(label))
    while True:
        low = np.minimum(top[x], top[y])
        before = top.copy()
        np.minimum.at(top, x, low)
        np.minimum.at(top, y, low)
        top = top[top]
        if (top == before).all():
            return top[label]


def _members(label: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A group of m as m - 1 links, and not m * m."""
    rest = np.flatnonzero(label != np.arange(len(label)))
    return ids[label[rest]], ids[rest]


def _links(sig: np.ndarray, ids: np.ndarray, node: np.ndarray, limit: int, leaf: int = SHIFTED) -> tuple[np.ndarray, np.ndarray]:
    """Links within nodes (equal, adjacent values of ``node``) whose components are those of all close pairs in them."""
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    size = np.diff(np.r_[first, len(node)])
    label = np.arange(len(ids))
    for x, y in _close(np.ascontiguousarray(sig.T), np.repeat(size, size), limit, leaf, label):
        label = _joined(label, x, y)
    return _members(label, ids)


def _node_links(sig: np.ndarray, ids: np.ndarray, free: np.ndarray, limit: int, distance: int, recall: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Links of one node's rows that meet a pair at ``distance`` with the given recall, by tries of its own over the ``free`` bits."""
    n = len(ids)
    x, y = rng.integers(0, n, 4096), rng.integers(0, n, 4096)
    apart = hamming(sig[x], sig[y])[x != y]
    # pairs that link are no measure of the others: they are joined as one group
    apart = apart[apart > limit]
    depth, tries = node_shape(apart, n, len(free), distance, recall) if len(apart) else (0, 1)
    if not depth:
        return _links(sig, ids, np.zeros(n, dtype=np.int64), limit)
    label, words, raw = np.arange(n), np.ascontiguousarray(sig.T), sig.view(np.uint8).reshape(n, -1)
    at_once = max(1, KEYS // n)
    for done in range(0, tries, at_once):
        many = min(at_once, tries - done)
        weight = np.zeros((BITS, many), dtype=np.float32)
        for t in range(many):
            weight[rng.choice(free, depth, replace=False), t] = 2.0 ** np.arange(depth)
        path = np.empty((many, n), dtype=np.uint64)
        for i in range(0, n, 4096):
            path[:, i : i + 4096] = (np.unpackbits(raw[i : i + 4096], axis=1, bitorder="little").astype(np.float32) @ weight).T
        for key in path:
            key = np.sort(key << np.uint64(32) | np.arange(n, dtype=np.uint64))
            order = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            key >>= np.uint64(32)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, n])
            size = np.repeat(size, size)
            order, size = order[size > 1], size[size > 1]
            for x, y in _close(words[:, order], size, limit, SHIFTED, label[order]):
                label = _joined(label, order[x], order[y])
    return _members(label, ids)


def _forest(limit: int, distance: int, recall: float, orders: list[np.ndarray], depth: int, seed: int):
    """The mapInArrow body over rows (node, id, s0..s3) sorted by node, which is the trie and below it the path of ``depth`` bits.

    ``recall``: within a node; at 1 nodes are compared whole.
    """

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        sig, ids, node = np.ascontiguousarray(rows[:, 2:]).view(np.uint64), rows[:, 1], int(rows[0, 0])
        if recall < 1:
            a, b = _node_links(sig, ids, orders[node >> depth][depth:], limit, distance, recall, np.random.default_rng([seed, node]))
        else:
            a, b = _links(sig, ids, rows[:, 0], limit)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)], axis=1)
            cuts = np.flatnonzero(np.diff(rows[:, 0], prepend=held[-1][-1, 0] if held else rows[0, 0]))
            for part, new in zip(np.split(rows, cuts), [False, *[True] * len(cuts)], strict=True):
                if new and held:
                    yield solve(np.concatenate(held))
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield solve(np.concatenate(held))

    return run


def grouped(docs: DataFrame, max_distance: int = 56, design_distance: int | None = None, recall: float = 0.95, leaf: int = 2048, node_rows: int = 32768, within: float = 0.8, seed: int = 7) -> DataFrame:
    """(k, h, doc_id, best) of every row in a group of two or more; best: struct (missing, doc_id, k, h) of the row that stays.

    ``max_distance``: bits of 256 in which linked documents may differ. ``recall``: of pairs at ``design_distance``,
    which is ``max_distance`` if not given; closer pairs have a higher one. ``leaf``: signatures that are compared whole, all with
    all. ``node_rows``: of which the nodes of more have about so many. ``within``: the part of ``recall`` that holds within each of
    several tries' nodes.
    """
    spark = docs.sparkSession
    sigs = written(signature_table(docs), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "k", "h"))
    # numbered once and for all by being written
    nodes = written(sigs.groupBy(*_NAMES).agg(least.alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "copies")
    rows = nodes.count()
    distance = max_distance if design_distance is None else design_distance
    if rows <= node_rows:
        depth, tries, inner = 0, 1, 1.0 if rows <= leaf else recall
    else:
        depth, tries = forest_shape(rows, distance, recall, node_rows, within)
        inner = within
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(BITS) for _ in range(tries)]

    def node(tree: int, order: np.ndarray) -> Column:
        out = F.lit(tree).cast("bigint")
        for bit in order[:depth]:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftrightunsigned(F.col(_NAMES[bit // 64]), int(bit % 64)).bitwiseAND(F.lit(1).cast("bigint")))
        return out

    spread = nodes.select(F.explode(F.array(*(node(t, o) for t, o in enumerate(orders)))).alias("node"), "id", *_NAMES)
    spread = spread.repartition(shuffle_partitions(spark), "node").sortWithinPartitions("node")
    links = spread.mapInArrow(_forest(max_distance, distance, inner, orders, depth, seed), _MEMBER).filter("a != b")
    components = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # from nodes to components, and back to the rows
    tops = nodes.join(components.withColumnRenamed("u", "id"), "id", "left").select(*_NAMES, F.coalesce("v", "id").alias("top"), "least", "n")
    best = tops.groupBy("top").agg(F.min("least").alias("best"), F.sum("n").alias("many")).filter("many > 1").select("top", "best")
    return sigs.join(tops.join(best, "top").select(*_NAMES, "best"), _NAMES).select("k", "h", "doc_id", "best")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, keep_doc_id) of every document in a group of two or more, the kept one (equal ids) included. ``options`` are those of grouped."""
    return grouped(docs, **options).select("doc_id", F.col("best.doc_id").alias("keep_doc_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group; documents of no group stay. ``options`` are those of grouped."""
    k, h, stays, rank = (fresh(docs, x) for x in ("k", "h", "stays", "rank"))
    stay = (F.col("k") == F.col("best.k")) & (F.col("h") == F.col("best.h"))
    known = grouped(docs, **options).select(F.col("k").alias(k), F.col("h").alias(h), stay.alias(stays)).distinct()
    own_k, own_h = row_key(ident(docs), *pick(docs, "text"))
    left = docs.withColumns({k: own_k, h: own_h}).join(known, [k, h], "left").filter(F.coalesce(F.col(stays), F.lit(True)))
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy(k, h).orderBy(F.xxhash64(*others) if others else F.lit(0))
    return left.withColumn(rank, F.row_number().over(order)).filter(F.col(stays).isNull() | (F.col(rank) == 1)).select(*(F.col(f"`{c}`") for c in docs.columns))
