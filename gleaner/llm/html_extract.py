"""Main text of web pages by nearest-URL page differencing.

Pages become lines of text: comments, head, scripts and styles go, block tags end lines, character references are resolved, white
space is collapsed. Within each host, pages are sorted by URL path; the nearest page is, of the next ones before and behind in that
order that have lines and other lines than the page itself, the one that shares the longer prefix of the path (the longest shared prefix with
any such page is with one of these two; of equals, the one before). Lines of both pages are aligned by
longest common subsequence, and the shared lines, which belong to the site and not to the page, are deleted.

Only line hashes take part in the pairing: they are sorted globally by range, so that a host of any size is spread over the cluster, and
each partition gets the rows at its neighbours' edges: the outermost two of each end that have lines and differ. The texts are shuffled once, to meet the lines that they keep.

Defined cases: null and empty html give an empty text. A null url, or one without a host, has the host ''. A page alone on its host keeps all
lines. Pages without lines and pages with the very same lines tell nothing and are passed over, however many there are in a row; a page keeps all
its lines only if its host has no other page that differs. A page_id that is no integer counts as null. Equal rows
count as one page and get equal results. Empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._spark import checkpointed, ident, mapped, pick, shuffle_partitions
from gleaner.llm._text import hash_spans, text_bytes

_HIDDEN = re.compile(r"<!--|<(script|style|head|noscript|template|svg|iframe)\b", re.I)
_CLOSED = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "head", "noscript", "template", "svg", "iframe")}
_TAG = re.compile(r"<(?:/?([a-zA-Z][a-zA-Z0-9]*+)(?:\"[^\"]*\"|'[^']*'|[^'\"<>]++)*+|[!?/a-zA-Z][^>]*+)>")
SHORT = 2000  # lines of a page for which memory is no matter
_SPACE = re.compile(r"[ \t\r\n\f\v\xa0]+")
_BLOCK = frozenset("address article aside blockquote body br canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
_URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)(\?[^#]*)?")


def _end(tag: re.Match) -> str:
    return "\n" if (tag[1] or "").lower() in _BLOCK else ""


def shown(html: str) -> str:
    """The page without comments and elements that hold no text to read; one that isn't closed ends with the page. In linear time."""
    out, at = [], 0
    while (m := _HIDDEN.search(html, at)) is not None:
        if m[1] is None:
            end = html.find("-->", m.end())
            close = end + 3
        else:
            opened = html.find(">", m.end())
            if opened < 0:  # no tag ends from here on
                break
            tag = _CLOSED[m[1].lower()].search(html, opened + 1)
            end, close = (tag.start(), tag.end()) if tag else (-1, 0)
        out += [html[at : m.start()], " "]
        if end < 0:
            return "".join(out)
        at = close
    return "".join([*out, html[at:]])


def text_lines(html: str | None) -> list[str]:
    """The lines of text of a page."""
    if not html:
        return []
    flat = _SPACE.sub(" ", shown(html))
    last = flat.rfind(">") + 1  # behind it there is no tag
    text = _TAG.sub(_end, flat[:last]) + flat[last:]
    if "&" in text:
        text = "\n".join(_SPACE.sub(" ", entities.unescape(line)) for line in text.split("\n"))
    return [line for x in text.split("\n") if (line := _SPACE.sub(" ", x).strip())]


def host_path(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m[1].lower(), (m[2] or "/") + (m[3] or "")) if m else ("", url or "")


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def _bits(at: list[int], size: int) -> int:
    """A number with the bits ``at`` set."""
    out = bytearray(size // 8 + 1)
    for j in at:
        out[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(out, "little")


def kept_lines(own: list[int], other: list[int]) -> list[int]:
    """Indices of the lines outside the longest common subsequence, by bit-parallel rows (Crochemore's recurrence).

    Memory grows with the lines to the power of 1.5, by an eighth of a byte. Where several subsequences are longest, lines are matched from the end, each at its last place.
    """
    low = 0
    while low < min(len(own), len(other)) and own[low] == other[low]:
        low += 1
    high = 0
    while high < min(len(own), len(other)) - low and own[-1 - high] == other[-1 - high]:
        high += 1
    a, b = own[low : len(own) - high], other[low : len(other) - high]
    places: dict[int, list[int]] = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    often = isqrt(len(b)) if len(b) > SHORT else 0
    where = {x: _bits(at, len(b)) for x, at in places.items() if len(at) > often}  # those of rarer lines are made when needed

    full = (1 << len(b)) - 1
    step = isqrt(len(a)) + 1

    def after(i: int, v: int) -> int:
        x = a[i]
        u = v & (where[x] if x in where else _bits(places[x], len(b)) if x in places else 0)
        return ((v + u) | (v - u)) & full

    saved = [full]  # row 0, step, 2 * step ...; a zero at bit j of row i: b[:j + 1] has a longer subsequence with a[:i] than b[:j]
    v = full
    for i in range(len(a)):
        v = after(i, v)
        if (i + 1) % step == 0:
            saved.append(v)
    block, rows = -1, []

    def length(i: int, j: int) -> int:
        """Of the longest common subsequence of a[:i] and b[:j]. Rows between saved ones are made again, so that few are held."""
        nonlocal block, rows
        if i // step != block:
            block = i // step
            rows = [saved[block]]
            for k in range(block * step, min((block + 1) * step - 1, len(a))):
                rows.append(after(k, rows[-1]))
        return j - (rows[i - block * step] & ((1 << j) - 1)).bit_count()

    out, i, j = [], len(a), len(b)
    now = length(i, j)
    while i:
        if now and length(i - 1, j) == now:
            i -= 1
            out.append(low + i)
        elif now:
            while length(i, j - 1) == now:
                j -= 1
            i, j, now = i - 1, j - 1, now - 1
        else:
            i -= 1
            out.append(low + i)
    return out[::-1]


def runs_of(kept: list[int]) -> list[dict]:
    """Runs of kept lines as (start from 1, length)."""
    out: list[dict] = []
    for i in kept:
        if out and out[-1]["start"] + out[-1]["length"] == i + 1:
            out[-1]["length"] += 1
        else:
            out.append({"start": i + 1, "length": 1})
    return out


def _light(batch: pa.RecordBatch) -> pa.RecordBatch:
    where = [host_path(u) for u in batch.column("url").to_pylist()]
    lines = [text_lines(h) for h in batch.column("html").to_pylist()]
    raw, offsets = text_bytes(pa.array([x for page in lines for x in page], pa.large_string()))
    hashes = hash_spans(raw, offsets[:-1], offsets[1:]).view(np.int64)
    bounds = np.r_[0, np.cumsum([len(page) for page in lines], dtype=np.int64)].astype(np.int32)
    return pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("rid2"), pa.array([h for h, _ in where], pa.string()), pa.array([p for _, p in where], pa.string()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes))], names=["rid", "rid2", "host", "path", "hashes"])


def _lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    lines = [text_lines(h) for h in batch.column("html").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("rid2"), batch.column("page_id"), batch.column("url"), pa.array(lines, pa.list_(pa.string()))], names=["rid", "rid2", "page_id", "url", "lines"])


class _Side:
    """The rows next to a place in the sorted order on one side: the nearest of its host with lines, and the nearest with others than that one's."""

    def __init__(self, rows: Iterable[tuple] = ()) -> None:
        self.rows: list[tuple] = []
        for row in rows:
            self.add(row)

    def add(self, row: tuple) -> None:
        """A (host, path, hashes) row that is nearer than those before it."""
        if not row[2]:
            return
        rest = [x for x in self.rows if x[0] == row[0]]
        # of rows with the same lines the nearer one counts; the other kept row is the nearest that differs
        self.rows = [row, *([x for x in rest if x[2] != row[2]][:1])]

    def other(self, here: tuple) -> tuple | None:
        return next((x for x in self.rows if x[0] == here[0] and x[2] != here[2]), None)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each end of the partition, with its number, the rows that a page beyond it may be compared with, farthest first."""
    head: list[tuple] = []  # the first row with lines, and the first of its host that differs
    tail = _Side()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            tail.add(row)
            if row[2] and (not head or len(head) == 1 and row[0] == head[0][0] and row[2] != head[0][2]):
                head.append(row)
    rows = [(0, *r) for r in reversed(head)] + [(1, *r) for r in reversed(tail.rows)]
    if rows:
        end, host, path, hashes = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32()), pa.array(end, pa.int32()), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], names=["part", "end", "host", "path", "hashes"])


def nearest(here: tuple, before: tuple | None, behind: tuple | None) -> tuple | None:
    """Of (host, path, hashes) rows, the next that differ on each side, the one that a page is compared with."""
    fit = [(shared_prefix(here[1], x[1]), x) for x in (before, behind) if x is not None]
    return max(fit, key=lambda f: f[0])[1] if fit else None


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_lines, n_deleted) of every page; the text has its own lines, one a line."""
    spark = pages.sparkSession
    # two hashes tell rows apart
    base = pages.select(ident(pages, "page_id"), *pick(pages, "url", "html")).withColumns({"rid": F.xxhash64("page_id", "url", "html"), "rid2": F.xxhash64("html", "url", F.lit(5))})
    light = mapped(base.select("rid", "rid2", "url", "html"), "html", _light, "rid bigint, rid2 bigint, host string, path string, hashes array<bigint>").dropDuplicates(["rid", "rid2"])
    key = ["host", "path", "rid", "rid2"]
    sorted_ = checkpointed(light.repartitionByRange(shuffle_partitions(spark), *key).sortWithinPartitions(*key))
    ends: dict[tuple[int, int], list[tuple]] = defaultdict(list)
    for r in sorted_.mapInArrow(_edges, "part int, end int, host string, path string, hashes array<bigint>").collect():  # four rows a partition at most
        ends[r.part, r.end].append((r.host, r.path, list(r.hashes)))
    full = sorted({p for p, _ in ends})
    before, behind = _Side(), _Side()
    lower, upper = {}, {}  # by partition with lines, what lies before its first row and behind its last
    for p in full:
        lower[p] = before.rows
        before = _Side([*before.rows[::-1], *ends[p, 1]])
    for p in reversed(full):
        upper[p] = behind.rows
        behind = _Side([*behind.rows[::-1], *ends[p, 0]])
    sent = spark.sparkContext.broadcast((lower, upper))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = _Side(sent.value[0].get(part, [])[::-1])
        after = sent.value[1].get(part, [])
        held: list[tuple[tuple, tuple | None]] = []  # rows with the same lines, or none, and what lies before each, until a row behind differs

        def solve(row: tuple, before: tuple | None, behind: tuple | None) -> tuple:
            other = nearest(row[2:], before, behind)
            own = row[4]
            kept = list(range(len(own))) if other is None else kept_lines(own, other[2])
            return row[0], row[1], runs_of(kept), len(kept)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], kind), pa.array([o[3] for o in out], pa.int32())], names=["rid", "rid2", "runs", "n_kept"])

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if held and (row[2] != held[0][0][2] or row[4] and row[4] != held[0][0][4]):
                    behind = row[2:] if row[2] == held[0][0][2] else None
                    out += [solve(x, y, behind) for x, y in held]
                    held = []
                if row[4]:
                    row = (*row[:4], held[0][0][4] if held else row[4])  # one copy of the lines for all of them
                    held.append((row, before.other(row[2:])))
                    before.add(row[2:])
                else:
                    out.append(solve(row, None, None))
            if out:
                yield batch_of(out)
        if held:
            behind = _Side(after[::-1]).other(held[0][0][2:])
            yield batch_of([solve(x, y, behind) for x, y in held])

    kept = sorted_.mapInArrow(pair, "rid bigint, rid2 bigint, runs array<struct<start:int,length:int>>, n_kept int")
    lines = mapped(base, "html", _lines, "rid bigint, rid2 bigint, page_id bigint, url string, lines array<string>")
    own = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice("lines", r["start"], r["length"]))), "\n")
    return lines.join(kept, ["rid", "rid2"]).select("page_id", "url", own.alias("text"), F.size("lines").alias("n_lines"), (F.size("lines") - F.col("n_kept")).alias("n_deleted"))
