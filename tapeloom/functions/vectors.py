"""Vector scores.  The arithmetic runs on Arrow batches inside the tasks.

A vector column is ``array<float>`` of any one length; rows whose vector is
null, has another length than the query, or has no direction score null.
Scores are rounded to 12 decimals so that equal vectors tie wherever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

SCORE_DECIMALS = 12


def matrix_of(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """``(usable, matrix)``: which rows have ``dims`` numbers, and those rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    usable = lengths == dims
    if not usable.all():
        vectors = vectors.filter(pa.array(usable))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return usable, flat.astype(np.float64, copy=False).reshape(-1, dims)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def score_batch(vectors: pa.Array, query: np.ndarray, metric: str) -> np.ndarray:
    """Scores of a batch of vectors; NaN where there is none."""
    usable, rows = matrix_of(vectors, len(query))
    if metric == "cosine":
        rows, query = unit_rows(rows), unit_rows(query[None, :])[0]
    out = np.full(len(usable), np.nan)
    out[usable] = np.round(rows @ query, SCORE_DECIMALS)
    return out


def _score(vector: Column, query: Sequence[float], metric: str) -> Column:
    target = np.asarray(query, dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def score(vectors: pa.Array) -> pa.Array:
        scores = score_batch(vectors, target, metric)
        return pa.array(scores, mask=np.isnan(scores))

    return score(vector)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity of a vector column and one query vector."""
    return _score(vector, query, "cosine")


def inner_product(vector: Column, query: Sequence[float]) -> Column:
    """Dot product of a vector column and one query vector."""
    return _score(vector, query, "inner_product")


def unit_vector(vector: Column) -> Column:
    """The vector scaled to length one; null when it has no direction."""
    floats = T.ArrayType(T.FloatType())

    @F.arrow_udf(floats)
    def scale(vectors: pa.Array) -> pa.Array:
        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        norms = np.sqrt(np.bincount(row, weights=flat * flat, minlength=len(lengths)))
        usable = norms > 0
        kept = usable[row]
        units = (flat[kept] / norms[row[kept]]).astype(np.float32)
        starts = np.concatenate([[0], np.cumsum(np.where(usable, lengths, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(units), mask=pa.array(~usable))

    return scale(vector)
