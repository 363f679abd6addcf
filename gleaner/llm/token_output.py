"""Token ids as Parquet list columns, laid out for selective reads.

Each text's tokens (byte-level BPE under a public vocabulary, whose file is a parameter) become one list value beside the document's
metadata. The writer's encodings are controlled: ``delta`` stores ids by DELTA_BINARY_PACKED, ``dictionary`` by a dictionary of the ids in a row group; metadata
columns have dictionaries. Row groups hold about ``row_group_bytes``, pages ``page_bytes`` and ``page_rows`` rows at most; the writer
adds column and offset indexes, and rows are sorted by doc_id in each file, so that a reader of some documents skips the other row groups
and pages, and a reader of metadata touches no token. Spark's commit protocol makes files whole or absent if executors are lost.

Texts fall into units (white space before a word, and the word, cut where a symbol follows a letter or digit) that the pre-tokenizer's pattern never joins. The distinct units of
a batch are found by Arrow's dictionary encoding and looked up in a cache once each; the ids of the texts are then gathered by numpy. The cache
is emptied when full, which does not change results.

Defined cases: null text has null token_ids and n_tokens; empty text has none and 0. A null doc_id stays, and one that
is no integer becomes null. Rows alike in doc_id are written each, in any order; repeated rows too.
Empty tables give empty results. Metadata columns that are missing are written as null.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._spark import fresh_path, ident, mapped, pick
from gleaner.llm._text import text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNIT = re.compile(r"\s+(?!\S)| ?\S+|\s")
_ODD = re.compile("[\x1c-\x1f\x85]")  # white space to only one of the two regex engines
#: Other than single spaces and line ends between words; for RE2, whose \s is ASCII alone.
_RAGGED = r"[\t\v\f\r\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]"
_KIND = np.array([0] * 33 + [1 if chr(b).isalnum() else 2 for b in range(33, 127)] + [0] * 129, dtype=np.uint8)  # 1 letter or digit, 2 symbol, in ASCII
WRITTEN = "doc_id bigint, lang string, source string, n_tokens int, token_ids array<int>"


class Coder:
    """A byte-level BPE encoding and a cache of units (UTF-8): their token ids, as bytes of 32-bit integers."""

    def __init__(self, vocabulary: str, most: int = 400_000) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.units: dict[bytes, bytes] = {}
        self.most, self.line = most, ranks[b"\n"]

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).view("<i4")

    def known(self, units: list[bytes]) -> list[bytes]:
        """Token ids of each unit; those not in the cache are encoded in one call, with line ends between them."""
        found = list(map(self.units.get, units))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            if len(self.units) + len(new) > self.most:
                self.units.clear()
            blank = [i for i in new if units[i].decode().isspace()]
            worded = sorted(set(new).difference(blank))
            for i in blank:
                self.units[units[i]] = found[i] = self.ids(units[i].decode()).tobytes()
            if worded:
                ids = self.ids(b"\n".join([units[i] for i in worded]).decode())
                ends = np.r_[np.flatnonzero(ids == self.line), len(ids)]
                raw = ids.tobytes()
                start = 0
                for i, end in zip(worded, (4 * ends).tolist(), strict=True):
                    found[i] = raw[start:end]
                    start = end + 4
                    if len(units[i]) < 64:
                        self.units[units[i]] = found[i]
        return found

    def encode(self, text: str) -> np.ndarray:
        """The token ids of a text with any white space."""
        if _ODD.search(text):
            return self.ids(text)
        return np.frombuffer(b"".join(self.known([u.encode() for u in _UNIT.findall(text)])), dtype="<i4")

    def encode_plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and how many each has; white space is single spaces and line ends, at most one between words."""
        raw, offsets = text_bytes(column)
        if not len(raw):
            return np.zeros(0, dtype="<i4"), np.zeros(len(column), dtype=np.int64)
        # a unit starts at a space, at a line end, behind a line end, at a symbol behind a letter or digit, and with the text
        line = raw == 10
        starts = (raw == 32) | line
        kind = _KIND[raw]
        starts[1:] |= line[:-1] | (kind[1:] == 2) & (kind[:-1] == 1)
        starts[offsets[:-1][offsets[:-1] < len(raw)]] = True
        at = np.flatnonzero(starts)
        units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        known = self.known(units.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(known), dtype="<i4")
        size = np.array([len(x) for x in known], dtype=np.int64) // 4
        code = units.indices.to_numpy(zero_copy_only=False)
        many = size[code]
        done = np.cumsum(many)
        flat = ids[np.repeat((np.cumsum(size) - size)[code] - (done - many), many) + np.arange(done[-1])]
        return flat, np.diff(np.r_[0, done][np.searchsorted(at, offsets)])

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and how many each has; null has none."""
        column = column.fill_null("")
        ragged = pc.match_substring_regex(column, _RAGGED)
        flat, size = self.encode_plain(pc.if_else(ragged, "", column))
        odd = np.flatnonzero(ragged.to_numpy(zero_copy_only=False))
        if len(odd):
            found = [self.encode(t) for t in column.take(pa.array(odd)).to_pylist()]
            ends = np.cumsum(size)
            size[odd] = [len(x) for x in found]
            pieces, done = [], 0
            for i, x in zip(odd, found, strict=True):
                pieces += [flat[done : ends[i]], x]
                done = ends[i]
            flat = np.concatenate([*pieces, flat[done:]])
        return flat, size


_coders: dict[str, Coder] = {}


def coder_of(vocabulary: str) -> Coder:
    """One coder for each vocabulary and Python worker."""
    if vocabulary not in _coders:
        _coders[vocabulary] = Coder(vocabulary)
    return _coders[vocabulary]


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids) of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, size = coder_of(vocabulary).encode_all(batch.column("text"))
        missing = np.asarray(batch.column("text").is_null())
        offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32), mask=np.r_[missing, False])
        lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), pa.array(size.astype(np.int32), mask=missing), lists], names=["doc_id", "lang", "source", "n_tokens", "token_ids"])

    text, lang, source = pick(docs, "text", "lang", "source")
    slim = docs.select(ident(docs), text, lang.cast("string").alias("lang"), source.cast("string").alias("source"))
    return mapped(slim, "text", work, WRITTEN)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, encoding: str = "delta", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000) -> None:
    """Writes the token table under ``path``."""
    if encoding not in ("delta", "dictionary"):
        raise ValueError("encoding must be 'delta' or 'dictionary'")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",  # without a dictionary, integers are then packed as deltas
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#token_ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.dictionary.page.size": 1 << 20,
    }
    tokenized(docs, vocabulary).sortWithinPartitions("doc_id").write.options(**options).parquet(path)


def read_tokens(spark, path: str, ids: tuple[int, int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The token table, or what it holds of documents from ``ids[0]`` to ``ids[1]`` in some columns; both reach the scan."""
    df = spark.read.schema(WRITTEN).parquet(path)
    if ids is not None:
        df = df.filter(F.col("doc_id").between(*ids))
    return df.select(*columns) if columns else df


def token_table(docs: DataFrame, **options) -> DataFrame:
    """The table as written to the shared folder and read again: (doc_id, n_tokens, token_ids)."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path, columns=["doc_id", "n_tokens", "token_ids"])
