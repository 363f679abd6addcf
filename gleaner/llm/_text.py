"""Vectorised text primitives shared by the operators: words, word hashes and Arrow plumbing.

A *word* is a maximal run of bytes other than ASCII white space (the class ``\\s`` of Java regexes), so
words here agree with ``split(text, '\\\\s+')`` in Spark SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the count of words before each row (one more than rows)."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    after[cut] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) * _C1 + np.uint64(seed))
    live, step = np.arange(len(starts)), 0
    while len(live):
        at, left = starts[live] + step, length[live] - step
        h[live] = mix((h[live] ^ (eight[at] & _MASKS[np.minimum(left, 8)])) * _C1)
        live, step = live[left > 8], step + 8
    return h


_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def plain_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As text_bytes, in lower case and without ASCII punctuation."""
    raw, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    keep = ~_PUNCTUATION[raw]
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return raw[keep], before[offsets]


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of ``values`` between ``bounds``; zero for an empty segment."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=np.result_type(values.dtype, np.int32))
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=out.dtype)
    return out
