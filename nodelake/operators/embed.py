"""Embedding of texts: an interface and a deterministic default that needs no model.

The default hashes words and character trigrams to dimensions with signs and normalises the vector. It finds texts that
share words; it knows nothing of meaning. Another embedder is any function from a pandas Series of texts to a Series of
lists of floats."""

from __future__ import annotations

import importlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 384
#: Texts that an embedder gets at once.
BATCH = 100
Embedder = Callable[[pd.Series], pd.Series]


@lru_cache(100_000)
def _places(word: str, size: int) -> list[int]:
    """Dimensions of a word and its trigrams; a negative sign is a dimension in the second half."""
    hashes = [zlib.crc32(part.encode()) for part in (word, *(word[i : i + 3] for i in range(len(word) - 2)))]
    return [h % size + (0 if h >> 31 else size) for h in hashes]


def hashed(texts: pd.Series, size: int = SIZE) -> pd.Series:
    """All texts of a batch are counted together; a word is hashed once for all of its occurrences."""
    found = [re.findall(r"\w+", text.lower()) for text in texts.fillna("")]
    number, words = pd.factorize(np.array([w for ws in found for w in ws], object))
    places = [_places(w, size) for w in words]
    n = np.array([len(p) for p in places], np.int64)
    flat, first = np.array([x for p in places for x in p], np.int64), np.cumsum(n) - n
    owner = np.repeat(np.arange(len(found)), [len(ws) for ws in found])
    times = n[number]
    at = np.repeat(first[number] - np.cumsum(times) + times, times) + np.arange(times.sum())
    count = np.bincount(np.repeat(owner, times) * 2 * size + flat[at], minlength=len(found) * 2 * size).reshape(len(found), 2, size)
    v = (count[:, 0] - count[:, 1]).astype(float)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return pd.Series(list((v / np.where(norm > 0, norm, 1)).astype(np.float32)), dtype=object)


#: Embedders by name.
EMBEDDERS: dict[str, Embedder] = {"hashed": hashed}


def embedder(name: str) -> Embedder:
    """An embedder by its name in :data:`EMBEDDERS`, or as ``module:function``."""
    if name in EMBEDDERS:
        return EMBEDDERS[name]
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"unknown embedder {name!r}")
    return getattr(importlib.import_module(module), function)


def embed(text: Column, embedder: Embedder = hashed, batch: int = BATCH) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [embedder(texts.iloc[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype=object)

    return run(text)


def query_vector(text: str, embedder: Embedder = hashed) -> list[float]:
    return [float(x) for x in embedder(pd.Series([text]))[0]]
