"""Vectors as arrays of floats; sums are of doubles, in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 768


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, 0.0).otherwise(dot(a, b) / F.when(lengths == 0, 1.0).otherwise(lengths))


def l2_normalize(a: Column) -> Column:
    """To length 1; a zero vector stays as it is."""
    length = norm(a)
    safe = F.when(length == 0, 1.0).otherwise(length)
    return F.transform(a, lambda x: (x.cast("double") / safe).cast("float"))


def _packed(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def pack_vector(vector: Column) -> Column:
    """Little-endian 32-bit floats."""
    return F.pandas_udf(_packed, "binary")(vector)


def _unpacked(data: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> np.ndarray | None:
        if b is not None and len(b) % 4:
            raise ValueError(f"{len(b)} bytes are no vector of 32-bit floats")
        return None if b is None else np.frombuffer(b, "<f4")

    return data.map(one)


def unpack_vector(data: Column) -> Column:
    """An error if the length is no multiple of 4."""
    return F.pandas_udf(_unpacked, "array<float>")(data)
