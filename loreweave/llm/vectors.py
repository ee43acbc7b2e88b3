"""Packed vectors: the rows of an embedding table that take part in a search, as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(vector: str) -> Column:
    """Whether a vector takes part: neither null nor empty nor zero, without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def pack(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, dim, width) of the rows that take part: components as little-endian floats of ``width`` bytes."""
    kind = df.schema[vector_col].dataType
    width = 4 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else 8
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{'float' if width == 4 else 'double'}>").alias("_v"))

    def packed(batches):
        for batch in batches:
            found = [np.asarray(v.values, dtype=f"<f{width}") for v in batch.column("_v")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([v.tobytes() for v in found], pa.binary()), pa.array([len(v) for v in found], pa.int32()),
                 pa.array([width] * len(found), pa.int32())], names=["id", "vec", "dim", "width"],
            )

    return rows.filter(F.col("id").isNotNull() & usable("_v")).mapInArrow(packed, "id long, vec binary, dim int, width int")


def matrix(column, width: int) -> np.ndarray:
    """Packed vectors of equal length as rows of doubles."""
    return np.stack([np.frombuffer(v.as_py(), f"<f{width}") for v in column]).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, after a scaling by the largest component that keeps squares in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows of ``a`` with those of ``b``, in doubles, summed alike for every row."""
    scale = lambda x: x / np.abs(x).max(axis=1, keepdims=True) if np.abs(x).max(initial=0) > 1e100 or np.abs(x).max(initial=1) < 1e-100 else x
    a, b = scale(a), scale(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
