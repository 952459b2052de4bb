"""Text to vector.  Any callable from a list of texts to a matrix will do."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from .text import CHARS_PER_TOKEN, MAX_TOKENS, split_words, truncate_for_embedding

Embedder = Callable[[Sequence[str]], np.ndarray]


class HashedWords:
    """Deterministic stand-in for an embedding model.

    Words and word pairs are hashed to signed slots, then scaled to unit length.
    """

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in enumerate(texts):
            found = split_words(text)
            for piece in found + [f"{a} {b}" for a, b in zip(found, found[1:])]:
                code = zlib.crc32(piece.encode())
                out[row, code % self.dims] += 1.0 if code & (1 << 31) else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def embed(text: Column, embedder: Embedder, max_tokens: int = MAX_TOKENS) -> Column:
    """Vector of each text, computed in the row it belongs to; null for null text."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        known = [i for i, t in enumerate(rows) if t is not None]
        vectors = np.asarray(embedder([rows[i] for i in known]), dtype=np.float32) if known else []
        out: list = [None] * len(rows)
        for i, v in zip(known, vectors):
            out[i] = v
        return pa.array(out, type=pa.list_(pa.float32()))

    return run(truncate_for_embedding(text, max_tokens))


def embed_one(text: str, embedder: Embedder, max_tokens: int = MAX_TOKENS) -> list[float]:
    """Vector of one typed query, on the driver."""
    limit = int(max_tokens * CHARS_PER_TOKEN)
    shown = text[:limit] + "..." if len(text) > limit else text
    return [float(x) for x in embedder([shown])[0]]
