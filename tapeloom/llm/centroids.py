"""Centroid clustering in whole numbers, with Ptolemy's inequality as the filter.

For any four points, ``d(x,c) d(p,q) >= |d(x,p) d(c,q) - d(x,q) d(c,p)|``.  The pivots
``p, q`` are a few of the first centroids, far apart, and stay fixed through all rounds.

1. One pass turns components into whole numbers and writes each vector with its
   distances to the pivots.  No later round measures them again.
2. In a round a task takes lower bounds of a vector's distances to all centroids from
   the cached distances and the pivot pairs.  The centroid with the smallest bound is
   measured first; centroids whose bound is above the least distance so far are out,
   and the survivors are measured exactly.  Bounds are rounded down by more than the
   floating-point error, and only a strictly larger bound drops a centroid, so ties
   and results are those of a full comparison.
3. Tasks add up whole components by cluster; one sum per cluster and component comes
   to the driver, which takes the floored means.

Centroids, pivots and sums are ``k`` times the dimension in size whatever the input.

Defined results: a vector that is null, of another length, or that holds a null or
non-finite component is left out.  Repeated rows are rows of their own; vectors with
the same id are ordered by their components among the first centroids.  A null id is
hashed as an empty one.  With fewer vectors than ``k`` there are as many centroids as
vectors; an empty table gives an empty result.  A component of 2**18 or more in size
ends the job with an error that says so, as squared distances would not fit a long.
Rows travel inside one struct, so names of other columns do not matter.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..session import to_scratch
from .common import arrow

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
PIVOTS = 6
LIMIT = 1 << 26  # of a whole component
SLACK = 2.0**-48  # relative; products of two distances are off by less than 2 ** -50
BLOCK = 4096  # vectors whose bounds are held at once
SCOUTS = 3  # candidates measured one by one before the rest


def whole_vectors(vectors: DataFrame, row: Column, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``(row, id, v)`` of the vectors that are kept, in whole numbers."""
    vec = F.col(vec_col)
    # A nan is greater than any number for Spark, so the comparison rules it out as well.
    usable = (F.size(vec) == dims) & F.coalesce(F.forall(vec, lambda x: F.abs(x) < F.lit(float("inf"))), F.lit(False))
    number = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    fits = F.forall(vec, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(float(LIMIT)))
    whole = F.when(fits, F.transform(vec, lambda x: number(x).cast("int"))).otherwise(
        F.raise_error(F.lit(f"a component of {LIMIT // scale} or more: squared distances would not fit a long"))
    )
    rows = vectors.where(usable).select(row.alias("row"), F.col(id_col).alias("id"), whole.alias("v"))
    return rows


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    found = rows.select(F.sha2(named.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return np.array([r.v for r in found.collect()], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    away = a - b
    return np.einsum("...i,...i->...", away, away)


def pivots_of(points: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` different points, each as far as possible from those before it."""
    if not len(points):
        return points
    chosen, least = [0], squared(points, points[0])
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squared(points, points[chosen[-1]]))
    return points[chosen]


def to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(points[:, None, :], pivots[None, :, :]).astype(np.float64))


class Bounds:
    """Lower bounds of distances to the centroids, from distances to fixed pivots."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids, between = centroids, to_pivots(pivots, pivots)
        self.pairs = [(p, q, between[p, q]) for p, q in combinations(range(len(pivots)), 2)]
        self.far = to_pivots(centroids, pivots).T.copy()

    def below(self, cached: np.ndarray) -> np.ndarray:
        """A number not above the distance, for each vector and centroid."""
        least = np.zeros((len(cached), len(self.centroids)))
        for p, q, apart in self.pairs:
            one = cached[:, p, None] * self.far[q]
            other = cached[:, q, None] * self.far[p]
            gap = np.abs(one - other) - SLACK * (one + other)
            np.maximum(least, gap / apart, out=least)
        return least * (1 - SLACK)

    def nearest(self, v: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid (the smaller of equals), squared distance, and distances measured."""
        best, label, measured = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64), 0

        def measure(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
            return squared(v[rows], self.centroids[which])

        least = self.below(cached)
        for _ in range(min(SCOUTS, len(self.centroids))):
            which = least.argmin(axis=1)
            rows = np.flatnonzero(least[np.arange(len(v)), which] <= np.sqrt(best.astype(np.float64)) * (1 + SLACK))
            which = which[rows]
            d = measure(rows, which)
            measured += len(rows)
            closer = (d < best[rows]) | ((d == best[rows]) & (which < label[rows]))
            best[rows[closer]], label[rows[closer]] = d[closer], which[closer]
            least[rows, which] = np.inf
        rows, which = np.nonzero(least <= (np.sqrt(best.astype(np.float64)) * (1 + SLACK))[:, None])
        if len(rows):
            d = measure(rows, which)
            measured += len(rows)
            order = np.lexsort((which, d, rows))
            rows, which, d = rows[order], which[order], d[order]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            rows, which, d = rows[first], which[first], d[first]
            closer = (d < best[rows]) | ((d == best[rows]) & (which < label[rows]))
            best[rows[closer]], label[rows[closer]] = d[closer], which[closer]
        return label, best, measured


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)


def with_pivots(rows: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """Adds each vector's distances to the pivots as ``far``."""
    schema = StructType([*rows.schema, StructField("far", ArrayType(DoubleType()))])
    names = rows.columns

    def task(batches):
        for batch in batches:
            v = _matrix(batch.column(2), np.int64, dims)
            far = np.concatenate([to_pivots(v[i : i + BLOCK], pivots) for i in range(0, len(v), BLOCK)])
            yield {**{name: batch.column(i) for i, name in enumerate(names)}, "far": list(far)}

    return arrow(rows, task, schema)


def _assigned(batch: pa.RecordBatch, bounds: Bounds, dims: int, pivots: int):
    """Blocks of ``(first row, vectors, labels, squared distances)`` of a batch with ``v`` and ``far`` last."""
    v = _matrix(batch.column(batch.num_columns - 2), np.int64, dims)
    far = _matrix(batch.column(batch.num_columns - 1), np.float64, pivots)
    for low in range(0, len(v), BLOCK):
        label, best, _ = bounds.nearest(v[low : low + BLOCK], far[low : low + BLOCK])
        yield low, v[low : low + BLOCK], label, best


def moved(rows: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def task(batches):
        bounds, n, sums = Bounds(centroids, pivots), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, v, label, _ in _assigned(batch, bounds, dims, len(pivots)):
                order = np.argsort(label, kind="stable")
                used, first = np.unique(label[order], return_index=True)
                sums[used] += np.add.reduceat(v[order], first, axis=0)
                n += np.bincount(label, minlength=k)
        used = np.flatnonzero(n)
        yield {"cluster": used, "n": n[used], "sums": list(sums[used])}

    parts = arrow(rows.select("v", "far"), task, StructType.fromDDL("cluster bigint, n bigint, sums array<bigint>"))
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    whole = "decimal(38,0)"  # exact beyond the range of a long
    total = each.groupBy("cluster", "at").agg(F.sum(F.col("n").cast(whole)).alias("n"), F.sum(F.col("x").cast(whole)).alias("x"))
    found = centroids.copy()
    for r in total.collect():  # one row for each centroid and component
        found[r["cluster"], r["at"]] = int(r["x"]) // int(r["n"])
    return found


def _fitted(
    vectors: DataFrame, row: Column, id_col: str, vec_col: str, dims: int, k: int, rounds: int, seed: int, scale: int
) -> tuple[DataFrame, np.ndarray]:
    """``(row, id, cluster, distance)`` of the kept vectors, and the final centroids."""
    rows = whole_vectors(vectors, row, id_col, vec_col, dims, scale)
    centroids = first_centroids(rows, k, seed).reshape(-1, dims)
    pivots = pivots_of(centroids)
    rows = to_scratch(with_pivots(rows, pivots, dims), "whole-vectors")
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids, pivots)
    final = centroids
    schema = StructType([rows.schema["row"], rows.schema["id"], *[StructField(c, LongType()) for c in ("cluster", "distance")]])

    def task(batches):
        bounds = Bounds(final, pivots)
        for batch in batches:
            for low, v, label, best in _assigned(batch, bounds, dims, len(pivots)):
                part = batch.slice(low, len(v))
                yield {"row": part.column(0), "id": part.column(1), "cluster": label, "distance": best}

    return to_scratch(arrow(rows, task, schema), "clusters"), centroids


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMENSIONS,
    k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """The kept rows as struct ``row`` with ``cluster`` and squared ``distance``, and the final centroids."""
    whole = F.struct(*[F.col(f"`{c}`") for c in vectors.columns])
    found, centroids = _fitted(vectors, whole, id_col, vec_col, dims, k, rounds, seed, scale)
    return found.select("row", "cluster", "distance"), centroids


def cluster_digest(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMENSIONS,
    k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE,
) -> DataFrame:
    """One row per kept vector: id, ``cluster``, ``distance``, the inertias and a hash of its centroid."""
    found, centroids = _fitted(vectors, F.lit(0), id_col, vec_col, dims, k, rounds, seed, scale)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {r["cluster"]: int(r["s"]) for r in sums.collect()}  # one row for each centroid
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def looked_up(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster").cast("int"))

    return found.select(
        F.col("id").alias(id_col), F.col("cluster").cast(IntegerType()).alias("cluster"), "distance",
        looked_up([inertia.get(i, 0) for i in range(len(names))], "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), looked_up(names, "string").alias("centroid_sha256"),
    )
