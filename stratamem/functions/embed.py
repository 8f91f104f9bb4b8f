"""Text to vector without a network: signed feature hashing of words and word pairs, as an Arrow-batched function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

Embedder = Callable[[list[str]], np.ndarray]


def hashing(dimension: int = 64) -> Embedder:
    """Unit vectors; texts that share words are near. An empty text is the zero vector."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            words = t.lower().split()
            for w in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dimension] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)

    return run


def embed(embedder: Embedder):
    """A pandas UDF around any function from texts to a matrix; NULL counts as an empty text."""

    @pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(list(embedder(texts.fillna("").tolist()).astype(np.float32)))

    return run
