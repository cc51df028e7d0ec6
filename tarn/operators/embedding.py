"""Turning texts into vectors through a pluggable, vectorised model.

The model is loaded once a Python worker, texts go through it in Arrow batches. Without a model at hand,
the default hashes words into signed dimensions: deterministic and lexical, good for tests and plumbing,
no substitute for a trained model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], np.ndarray]


def hashing_model(dim: int = 384) -> Model:
    """Signed feature hashing of keyword tokens, vectors of length one (or zero without tokens)."""
    places: dict[str, tuple[int, float]] = {}

    def place(token: str) -> tuple[int, float]:
        if token not in places:
            digest = hashlib.md5(token.encode()).hexdigest()
            places[token] = (int(digest[:8], 16) % dim, 1.0 if int(digest[8], 16) < 8 else -1.0)
        return places[token]

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for token in re.findall("[a-z0-9]+", text.lower()):
                column, sign = place(token)
                out[row, column] += sign
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def embed(df: DataFrame, text: str = "text", output: str = "embedding", load: Callable[[], Model] = hashing_model) -> DataFrame:
    """``df`` with the vector of ``text`` in ``output``; null for null. ``load`` runs once a worker and only if there are texts."""

    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for texts in batches:
            known = texts.dropna()
            if len(known):
                model = model or load()
            vectors = iter(model(known.tolist()).astype(np.float32)) if len(known) else iter(())
            yield pd.Series([None if text is None else next(vectors) for text in texts], dtype=object)

    return df.withColumn(output, vector(F.col(text)))
