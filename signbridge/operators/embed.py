"""Pluggable embedding functions applied per Arrow batch.

A user function ``fn(list[str]) -> ndarray (n x dim)`` (a sentence encoder, an API
client, …) runs inside ``pandas_udf`` batches; texts can be de-duplicated first so each
distinct text is embedded once and joined back. We ship no model: ``hashing_embedder``
is a deterministic stand-in for tests and benchmarks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EmbedFn = Callable[[list], np.ndarray]


def hashing_embedder(dim: int = 64, n: int = 3) -> EmbedFn:
    """Character n-gram feature hashing, L2-normalised (deterministic across runs)."""
    import xxhash

    def fn(texts: list) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, t in enumerate(texts):
            s = f" {t or ''} "
            idx = [xxhash.xxh32_intdigest(s[i:i + n]) % dim for i in range(max(1, len(s) - n + 1))]
            np.add.at(out[row], idx, 1.0)
            norm = np.linalg.norm(out[row])
            if norm > 0:
                out[row] /= norm
        return out
    return fn


def letter_embedder(letters: str = "aeinorst") -> EmbedFn:
    """How often each letter occurs: a stand-in whose vectors plain SQL can check."""
    def fn(texts: list) -> np.ndarray:
        return np.array([[(t or "").count(c) for c in letters] for t in texts], dtype=np.float32).reshape(-1, len(letters))
    return fn


def embed_column(df: DataFrame, text_col: str, fn: EmbedFn | None = None, out_col: str = "embedding",
                 dedupe: bool = True) -> DataFrame:
    """Add ``out_col`` ARRAY<FLOAT> = fn(text) computed per Arrow batch."""
    fn = fn or hashing_embedder()

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        if len(texts) == 0:
            return pd.Series([], dtype=object)
        m = np.asarray(fn(texts.tolist()), dtype=np.float32)
        return pd.Series(list(m))

    if not dedupe:
        return df.withColumn(out_col, embed(F.col(text_col)))
    distinct = df.select(text_col).where(F.col(text_col).isNotNull()).distinct()
    vectors = distinct.withColumn(out_col, embed(F.col(text_col)))
    return df.join(vectors, text_col, "left")
