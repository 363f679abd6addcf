"""Exact substring dedup: every passage of ``window`` words or more that repeats keeps only its first occurrence.

Recompression reveals the repeats. Each round names maximal runs of a symbol, then pairs of neighbouring symbols whose sides,
bits of the names' hashes that a round draws for the whole corpus, are left and right. Names are fingerprints of what they
stand for, so they are the same on every executor without any exchange, and equal substrings get the same symbols but for some
at their edges. With each symbol goes its *zone*, the stretch of words that settled it: wherever the zone's words recur, the
symbol recurs. A window of ``window`` words is represented by the least of the symbols (named with their zones' words) whose
zones it holds; equal windows have equal representatives. Symbols that represent a single window run are dropped; for the others,
all windows that they represent are compared by their own 64-bit fingerprints within the symbol's group, which verifies repeats.
A symbol that over ``hot`` runs share is spread over several tasks, each of which also gets the first of all equal windows.
A window that holds no whole zone (in a long run, or at the edge of a text) represents itself, so no repeat is missed.

Result: of equal windows, the first by (doc_id, position) stays. A word goes if a later occurrence of a repeated window covers
it and no first occurrence of a repeated window does. What goes with a word is the white space behind it. Words are split at ASCII white
space; windows are compared by fingerprints of 128 bits in all.

Defined cases: null and empty texts and texts under ``window`` words stay as they are. Null doc_id sorts last, as does one that is no
integer, and is then null in keep_doc_ids. Rows with equal doc_id and text count as one occurrence and are cut alike; those with equal doc_id and different
text are told apart. A text may be cut to nothing; its row stays. Empty tables give empty results. Other columns pass through;
n_chars, if there, follows a cut text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm._spark import fresh, ident, mapped, pick, pieces, shuffle_partitions, written
from gleaner.llm._text import hash_spans, mix, text_bytes, word_spans

ROUNDS = 3
HOT = 100_000  # runs of windows of one symbol that one task compares
LAST_ID = 2**63 - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_inverse = lambda p: np.uint64(pow(int(p), -1, 2**64))


class _Ranges:
    """Fingerprints of word ranges from prefix sums of h[i] * base ** i, modulo 2 ** 64."""

    def __init__(self, words: np.ndarray, base: np.uint64) -> None:
        power = np.full(len(words) + 1, base, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * power[:-1], out=self.sums[1:])
        self.back = np.full(len(words) + 1, _inverse(base), dtype=np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def symbols(words: np.ndarray, before: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and zones [a, b) of the symbols after some rounds over texts with word bounds ``before``.

    A zone that reaches over an edge of its text ends one word beyond it, so that no window holds it.
    """
    full = before[1:] > before[:-1]
    low, high = before[:-1][full] - 1, before[1:][full] + 1
    first, name, a, b = before[:-1][full], words, np.arange(len(words)), np.arange(1, len(words) + 1)

    def shifted() -> tuple[np.ndarray, np.ndarray]:
        """Zone starts of the symbols before, zone ends of those behind."""
        left, right = np.empty_like(a), np.empty_like(b)
        left[1:], right[:-1] = a[:-1], b[1:]
        left[first], right[last] = low, high
        return left, right

    for k in range(rounds if len(words) else 0):
        last = np.r_[first[1:], len(name)] - 1
        equal = np.r_[name[1:] == name[:-1], False]
        equal[last] = False
        left, right = shifted()
        if equal.any():
            heads = np.r_[True, ~equal[:-1]]
            at = np.flatnonzero(heads)
            length = np.diff(np.r_[at, len(name)])
            first = np.cumsum(heads)[first] - 1
            name, a, b = name[at], left[at], right[~equal]
            run = np.flatnonzero(length > 1)
            name[run] = mix(name[run] * _B + length[run].astype(np.uint64))
            last = np.r_[first[1:], len(name)] - 1
        else:
            a, b = left, right
        side = (name * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) % 2**64 | 1)).view(np.int64) < 0
        pair = np.r_[~side[:-1] & side[1:], False]
        pair[last] = False
        left, right = shifted()
        a, b = np.where(side, left, a), np.where(side, b, right)
        at = np.flatnonzero(pair)
        merged = mix(name[at] * _A + mix(name[at + 1] + _B))
        name = name.copy()
        name[at] = merged
        keep = np.r_[True, ~pair[:-1]]
        first = np.cumsum(keep)[first] - 1
        name, a, b = name[keep], a[keep], b[keep]
    return name, a, b


def representatives(words: np.ndarray, before: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, representatives and own fingerprints of all windows; the symbols met twice in these texts."""
    many = np.maximum(np.diff(before) - window + 1, 0)
    total = int(many.sum())
    if not total:
        return np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3
    start = np.arange(total) + np.repeat(before[:-1] - (np.cumsum(many) - many), many)
    own = _Ranges(words, _A)
    name, a, b = symbols(words, before)
    inside = (a >= 0) & (b <= len(words))
    key = np.full(len(name), np.uint64(2**64 - 1))
    key[inside] = mix(own.of(a[inside], b[inside]) + name[inside])
    low, high = np.searchsorted(a, start), np.searchsorted(b, start + window, side="right")
    represented = own.of(start, start + window)
    has = high > low
    span = np.where(has, high - low, 1)
    level = np.floor(np.log2(span)).astype(np.int64)
    least = key
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(has & (level == k))
        represented[at] = np.minimum(least[low[at]], least[high[at] - (1 << k)])
        if len(least) > 1 << k:
            least = np.minimum(least[: -(1 << k)], least[1 << k :])
    again = np.sort(key[inside])
    return start, represented, _Ranges(words, _B).of(start, start + window), again[1:][again[1:] == again[:-1]]


def _windows(batch: pa.RecordBatch, window: int):
    """Runs of neighbouring windows with one representative: bounds in the windows, row, and the windows themselves."""
    raw, offsets = text_bytes(batch.column("text"))
    starts, ends, before = word_spans(raw, offsets)
    start, key, own, again = representatives(hash_spans(raw, starts, ends), before, window)
    if not len(start):
        return None
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)])
    row = np.searchsorted(before, start[new], side="right") - 1
    return new, np.r_[new[1:], len(start)], row, start - np.repeat(before[row], np.diff(np.r_[new, len(start)])), key, own, again


def _first_pass(window: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = _windows(batch, window)
        if found is None:
            return None
        new, end, row, _, key, own, again = found
        # windows of one run may be equal: it is then emitted twice, as one that repeats
        twice = np.isin(key[new], again)
        equal = np.flatnonzero((own[1:] == own[:-1]) & (key[1:] == key[:-1])) + 1
        twice[np.searchsorted(new, equal, side="right") - 1] = True
        times = 1 + (twice & (end - new > 1))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(key[new], times).view(np.int64)), batch.column("rid").take(pa.array(np.repeat(row, times)))], names=["key", "rid"])

    return work


def _second_pass(window: int, rid: str, text: str, order: str, flags: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                part = pa.RecordBatch.from_arrays([batch.column(text)], names=["text"])
                found = _windows(part, window)
                if found is None:
                    continue
                new, end, row, position, key, own, _ = found
                marks = batch.column(flags).flatten()
                repeated, first = np.unique(marks.field("key").to_numpy(zero_copy_only=False), return_index=True)
                salts = marks.field("salts").to_numpy(zero_copy_only=False)[first]
                keep = np.flatnonzero(np.isin(key[new].view(np.int64), repeated))
                salts = salts[np.searchsorted(repeated, key[new[keep]].view(np.int64))]
                size = (end - new)[keep]
                bounds = np.r_[0, np.cumsum(size)]
                pick_ = np.repeat(new[keep] - bounds[:-1], size) + np.arange(bounds[-1])
                row = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[new[keep]].view(np.int64)), pa.array(salts), batch.column(order).take(row), batch.column(rid).take(row), pa.array(position[new[keep]].astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(own[pick_].view(np.int64)))],
                    names=["key", "salts", "doc", "rid", "position", "prints"],
                )

    return run


def _spans(doc: np.ndarray, rid: np.ndarray, at: np.ndarray, source: np.ndarray, hold: bool, window: int) -> pa.RecordBatch:
    """Spans of neighbouring windows of one row and source."""
    order = np.lexsort((at, rid))
    doc, rid, at, source = doc[order], rid[order], at[order], source[order]
    new = np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (at[1:] > at[:-1] + 1) | (source[1:] != source[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    return pa.RecordBatch.from_arrays([pa.array(rid[new]), pa.array(at[new].astype(np.int32)), pa.array((at[last] + window).astype(np.int32)), pa.array(source[new]), pa.array(np.full(len(new), hold))], names=["rid", "s", "e", "source", "hold"])


def _compare(window: int):
    """Over rows sorted by key, doc, rid, position: the spans to cut, and those that stay as first occurrences of repeats.

    The prints seen of a key that goes on in the next batch are kept, one entry for each distinct window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, seen = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, rid, position = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            prints = batch.column(4)
            size = prints.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(key)), size)
            value = prints.flatten().to_numpy(zero_copy_only=False)
            at = position[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            key_, doc, rid = key[row], doc[row], rid[row]
            order = np.lexsort((np.arange(len(row)), value, key_))
            same = (key_[order][1:] == key_[order][:-1]) & (value[order][1:] == value[order][:-1])
            group = np.cumsum(np.r_[0, ~same])
            first = order[np.flatnonzero(np.r_[True, ~same])]  # the first row of each group, by the sort order of the input
            f_doc, f_rid, f_at = doc[first].copy(), rid[first].copy(), at[first].copy()
            if last_key is not None and key[0] == last_key:
                for g in np.flatnonzero(key_[first] == last_key):
                    old = seen.get(int(value[first[g]]))
                    if old is not None:
                        f_doc[g], f_rid[g], f_at[g] = old
            later = np.zeros(len(row), dtype=bool)
            later[order] = (f_rid[group] != rid[order]) | (f_at[group] != at[order])
            source = np.zeros(len(row), dtype=np.int64)
            source[order] = f_doc[group]
            if later.any():
                yield _spans(doc[later], rid[later], at[later], source[later], False, window)
                held = np.unique(group[later[order]])
                yield _spans(f_doc[held], f_rid[held], f_at[held], f_doc[held], True, window)
            if key[-1] != last_key:
                last_key, seen = key[-1], {}
            for g in np.flatnonzero(key_[first] == last_key):
                seen[int(value[first[g]])] = (f_doc[g], f_rid[g], f_at[g])

    return run


def cut_text(raw: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """The text without the words in cut spans that no hold span covers, and how many went."""
    buffer = np.frombuffer(raw, dtype=np.uint8)
    starts, _, _ = word_spans(buffer, np.array([0, len(raw)]))
    n = len(starts)
    cover = [np.zeros(n + 1, dtype=np.int64) for _ in range(2)]
    for x in spans:
        cover[x["hold"]][x["s"]] += 1
        cover[x["hold"]][min(x["e"], n)] -= 1
    gone = (np.cumsum(cover[0])[:n] > 0) & ~(np.cumsum(cover[1])[:n] > 0)
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    at = np.r_[starts, len(raw)]
    kept, done = [], 0
    for i, j in zip(edges[::2], edges[1::2], strict=True):
        kept.append(raw[done : at[i]])
        done = at[j]
    kept.append(raw[done:])
    return b"".join(kept), int(gone.sum())


def _cutter(columns: list[str], text: str, chars: str | None, spans: str, sources: bool):
    """Rows with their texts cut; with ``sources``, only rows that lose words, as (doc_id, keep_doc_ids, cut_words, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = np.flatnonzero(np.asarray(batch.column(spans).is_valid()))
            if sources:
                batch, marked = batch.take(pa.array(marked)), np.arange(len(marked))
            raw, found = batch.column(text).take(pa.array(marked)).cast(pa.binary()).to_pylist(), batch.column(spans).take(pa.array(marked)).to_pylist()
            cut = [cut_text(r or b"", s) for r, s in zip(raw, found, strict=True)]
            texts = pa.array([c[0] for c in cut], pa.binary()).cast(pa.string())
            if sources:
                lost = [i for i, c in enumerate(cut) if c[1]]
                from_ = [sorted({x["source"] for x in s if not x["hold"]}) for s in found]
                ids = [[None if x == LAST_ID else x for x in from_[i]] for i in lost]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(lost, pa.int64())), pa.array(ids, pa.list_(pa.int64())), pa.array([cut[i][1] for i in lost], pa.int32()), texts.take(pa.array(lost, pa.int64()))], names=["doc_id", "keep_doc_ids", "cut_words", "text"])
                continue
            out = {c: batch.column(c) for c in columns}
            if len(marked):
                place = np.full(batch.num_rows, -1)
                place[marked] = np.arange(len(marked))
                mask, where = pa.array(place >= 0), pa.array(np.maximum(place, 0))
                out[text] = pa.compute.if_else(mask, texts.take(where).cast(out[text].type), out[text])
                if chars:
                    out[chars] = pa.compute.if_else(mask, pa.compute.utf8_length(texts).take(where).cast(out[chars].type), out[chars])
            yield pa.RecordBatch.from_arrays(list(out.values()), names=columns)

    return run


def _plan(docs: DataFrame, window: int, hot: int) -> tuple[DataFrame, str, str]:
    """docs joined with the spans of each row; names of the spans' and the text column."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rid, order, flags, spans = (fresh(docs, x) for x in ("rid", "order", "flags", "spans"))
    doc_id, (text,) = ident(docs), pick(docs, "text")
    text_name = next((c for c in docs.columns if c.lower() == "text"), "text")
    base = docs.withColumn(order, F.coalesce(doc_id, F.lit(LAST_ID))).withColumn(rid, F.xxhash64(doc_id, text))
    runs = written(mapped(base.select(F.col(rid).alias("rid"), text), "text", _first_pass(window), "key bigint, rid bigint"), "runs")
    salts = F.ceil(F.col("n") / hot).cast("int").alias("salts")
    twice = runs.join(runs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", salts), "key")

    def rows_of(marked: DataFrame) -> DataFrame:
        marks = marked.groupBy("rid").agg(F.collect_set(F.struct("key", "salts")).alias(flags)).withColumnRenamed("rid", rid)
        return base.join(marks, rid).mapInArrow(_second_pass(window, rid, text_name, order, flags), "key bigint, salts int, doc bigint, rid bigint, position int, prints array<bigint>")

    # the windows of a key that many rows share are compared in several tasks: in each with the first of them all
    salted = lambda salt: F.when(F.col("salts") > 1, F.xxhash64("key", salt)).otherwise(F.col("key")).alias("key")
    windows = rows_of(twice.filter("salts > 1")).select("key", "salts", "doc", "rid", "position", F.posexplode("prints").alias("i", "print"))
    first = windows.groupBy("key", "salts", "print").agg(F.min(F.struct("doc", "rid", (F.col("position") + F.col("i")).alias("at"))).alias("f"), F.count("*").alias("n")).filter("n > 1")
    heads = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(salted(F.col("salt")), "f.doc", "f.rid", F.col("f.at").alias("position"), F.array("print").alias("prints"))
    rows = rows_of(twice).select(salted(F.pmod("rid", "salts").cast("int")), "doc", "rid", "position", "prints").unionByName(heads)
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "doc", "rid", "position")
    found = rows.mapInArrow(_compare(window), "rid bigint, s int, e int, source bigint, hold boolean")
    by_row = found.groupBy("rid").agg(F.collect_list(F.struct("s", "e", "source", "hold")).alias(spans)).withColumnRenamed("rid", rid)
    return base.join(by_row, rid, "left"), spans, text_name


def repeated_passages(docs: DataFrame, window: int = 50, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_doc_ids, cut_words, text) of each row that loses words: whence its cut passages stay, and what is left."""
    slim = docs.select(ident(docs), *pick(docs, "text"))
    joined, spans, text = _plan(slim, window, hot)
    return joined.mapInArrow(_cutter([], text, None, spans, True), "doc_id bigint, keep_doc_ids array<bigint>, cut_words int, text string")


def drop_repeated_passages(docs: DataFrame, window: int = 50, hot: int = HOT) -> DataFrame:
    """``docs`` with repeated passages cut from the texts; no row goes."""
    # mapInArrow resolves columns by name and can't bear dots in them, so the others get plain names on the way
    plain = [c.lower() if c.lower() in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(docs.columns)]
    joined, spans, text = _plan(docs.toDF(*plain), window, hot)
    chars = next((c for c, f in zip(plain, docs.schema, strict=True) if c == "n_chars" and isinstance(f.dataType, (T.IntegerType, T.LongType))), None)
    fields = [T.StructField(c, f.dataType, f.nullable or c in ("text", "n_chars")) for c, f in zip(plain, docs.schema, strict=True)]
    return joined.mapInArrow(_cutter(plain, text, chars, spans, False), T.StructType(fields)).toDF(*docs.columns)


ORACLE = """
WITH words AS (
    SELECT doc_id, text, regexp_extract_all(text, '\\S+\\s*') AS w, regexp_extract(text, '^\\s*') AS lead FROM documents
), places AS (
    SELECT doc_id, unnest(range(0, len(w) - 49)) AS p, w FROM words WHERE len(w) >= 50
), grams AS (
    SELECT doc_id, p, array_to_string(list_transform(w[p + 1:p + 50], lambda x : trim(x, chr(32) || chr(9) || chr(10) || chr(12) || chr(13))), ' ') AS g FROM places
), ranked AS (
    SELECT doc_id, p, count(*) OVER (PARTITION BY g) AS n, first_value(doc_id) OVER (PARTITION BY g ORDER BY doc_id, p) AS fd, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM grams
), covered AS (
    SELECT doc_id, unnest(range(p, p + 50)) AS i, k = 1 AS hold, fd FROM ranked WHERE n > 1
), gone AS (
    SELECT doc_id, i FROM covered GROUP BY doc_id, i HAVING NOT bool_or(hold)
), lost AS (
    SELECT doc_id, list(i) AS gi, count(*)::INT AS cut_words FROM gone GROUP BY doc_id
), sources AS (
    SELECT doc_id, list_sort(list_distinct(list(fd))) AS keep_doc_ids FROM ranked WHERE n > 1 AND k > 1 GROUP BY doc_id
)
SELECT doc_id, keep_doc_ids, cut_words, lead || coalesce(array_to_string(list_filter(w, lambda x, j : NOT list_contains(gi, j - 1)), ''), '') AS text
FROM lost JOIN sources USING (doc_id) JOIN words USING (doc_id)
"""
