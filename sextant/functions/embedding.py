"""Embedding providers: a column of vectors from a column of text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: A provider takes a text column and gives an array column; see ``hash_provider`` for one without a model.
Provider = Callable[[Column], Column]


def _vector(text: str | None, size: int) -> list[float]:
    """Bytes of a SHA-256 chain as numbers from -1 to 1, scaled to length 1; zeros for a blank text."""
    plain = " ".join((text or "").lower().split())
    if not plain:
        return [0.0] * size
    block, raw = hashlib.sha256(plain.encode()).digest(), b""
    while len(raw) < size:
        block = hashlib.sha256(block).digest()
        raw += block
    v = np.frombuffer(raw[:size], np.uint8) / 255.0 * 2 - 1
    return (v / (np.linalg.norm(v) or 1.0)).tolist()


def hash_provider(size: int = 384) -> Provider:
    """Deterministic vectors for tests; equal texts (case and white space aside) have equal ones."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(text: pd.Series) -> pd.Series:
        return pd.Series([_vector(t, size) for t in text])

    return embed
