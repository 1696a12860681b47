"""Embedders: a user's model over Arrow batches, and an offline hashing default."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from evalspark.functions.text import collapse_whitespace

# Size of the offline vectors and texts per model call.
HASH_DIMENSIONS = 64
BATCH = 64
#: Words whose bucket a worker remembers.
RECENT_WORDS = 400_000


class _Buckets(dict):
    """Bucket by word, for the words a worker met lately; emptied when full, which bounds its memory and not the input."""

    def __missing__(self, word: str) -> int:
        if len(self) >= RECENT_WORDS:
            self.clear()
        place = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % HASH_DIMENSIONS
        return place


_buckets = _Buckets()


@F.arrow_udf(ArrayType(DoubleType()))
def _hashed_words(texts: pa.Array) -> pa.Array:
    counts = np.zeros((len(texts), HASH_DIMENSIONS))
    for row, text in zip(counts, texts):
        places = list(map(_buckets.__getitem__, filter(None, (text.as_py() or "").split(" "))))
        row[:] = np.bincount(np.array(places, dtype=np.int64), minlength=HASH_DIMENSIONS)
        row /= np.linalg.norm(row) or 1.0
    offsets = np.arange(len(texts) + 1, dtype=np.int32) * HASH_DIMENSIONS
    return pa.ListArray.from_arrays(offsets, counts.ravel())


def hashed_words(text: Column) -> Column:
    """Unit vector of word-bucket counts over the whole text; an empty text is the zero vector."""
    return _hashed_words(F.lower(collapse_whitespace(text)))


def model_embedder(factory: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = BATCH):
    """A column function from an embedding model.

    ``factory`` runs once per task; the model gets at most ``batch`` texts per call and
    its rows are scaled to unit length (a zero row stays zero).
    """
    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            parts = []
            for start in range(0, len(texts), batch):
                rows = np.asarray(model(list(texts.iloc[start:start + batch])), dtype=np.float32)
                norms = np.linalg.norm(rows, axis=1, keepdims=True)
                parts.append(rows / np.where(norms == 0, 1.0, norms))
            yield pd.Series(list(np.concatenate(parts)) if parts else [], index=texts.index)
    return embed
