"""Vector functions on array columns, and a deterministic embedder for text."""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of vectors of length 1."""
    return dot(a, b)


@lru_cache(100_000)
def _hashes(word: str) -> tuple[int, ...]:
    """Of the word and its letter trigrams."""
    return tuple(zlib.crc32(g.encode()) for g in [word, *(f"^{word}$"[i : i + 3] for i in range(len(word)))])


def embed_text(text: str | None, dimensions: int = 128) -> list[float]:
    """Signed hashes of words and letter trigrams, at length 1. It stands in for a sentence model, which needs a download;
    results are not those of any such model. Pass another embedder where one is at hand."""
    out = np.zeros(dimensions)
    for w, times in Counter(re.findall(r"\w+", (text or "").lower())).items():
        for h in _hashes(w):
            out[h % dimensions] += times if h >> 31 else -times
    n = np.linalg.norm(out)
    return (out / n if n else out).tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def hashed_embedding(text: pd.Series) -> pd.Series:
    return text.map(embed_text)


_models: dict[bytes, Callable[[list[str]], np.ndarray]] = {}


def model_embedding(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """An embedder by a model: ``load`` gives a function from texts to rows of vectors. It is called when a Python worker first needs it, and once in each.

    Vectors are brought to length 1; null texts count as empty. ``load`` travels to the workers, so it must not hold the model itself.
    """
    key = uuid.uuid4().bytes

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(text: pd.Series) -> pd.Series:
        if key not in _models:
            _models[key] = load()
        v = np.asarray(_models[key](text.fillna("").tolist()), dtype=np.float64).reshape(len(text), -1)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return pd.Series(list(v / np.where(n > 0, n, 1)), index=text.index)

    return embed
