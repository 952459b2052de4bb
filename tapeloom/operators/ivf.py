"""Approximate nearest vectors: vectors are filed by nearest centroid, and a
query reads only the files of the centroids closest to it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.vectors import matrix_of, unit_rows, unit_vector
from .nearest import merged_best, nearest, nearest_for_queries, queries_by_length

# Centroids go to every task, so their total size is checked before they are trained.
CENTROID_BYTES = 256 * 2**20
# Cell of vectors that have no direction.  Their cosine with any query is null;
# their inner product is 0, so searches by inner product always read this cell.
NO_CELL = -1
# Scores of vectors against centroids that are held at once.
SCORES_AT_ONCE = 1 << 22


@dataclass(frozen=True)
class IvfIndex:
    """Where an index lives, how many cells it has, and its metric."""

    path: str
    cells: int
    metric: str = "cosine"

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")

    def centroids(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/centroids")


def _dimensions(df: DataFrame, vector: str) -> int:
    """The one length of the table's non-empty vectors."""
    size = F.when(F.size(vector) > 0, F.size(vector))
    low, high = df.agg(F.min(size), F.max(size)).first()
    if low is None:
        raise ValueError("there are no vectors to index")
    if low != high:
        raise ValueError(f"an index holds vectors of one length; these have {low} to {high} numbers")
    return low


def train_centroids(
    df: DataFrame, cells: int, vector: str = "embedding", seed: int = 7, iterations: int = 10
) -> np.ndarray:
    """Cluster centers of all rows, by direction.  An iteration is one scan with sums per task."""
    dims = _dimensions(df, vector)
    if cells * dims * 8 > CENTROID_BYTES:
        raise ValueError("centroids would be too large to send to every task; use fewer cells")
    rows = df.select(unit_vector(F.col(vector)).alias("v")).where(F.col("v").isNotNull())
    features = rows.select(array_to_vector("v").alias("features")).persist()
    try:
        means = KMeans(k=cells, maxIter=iterations, seed=seed, distanceMeasure="cosine", initSteps=1)
        centers = np.array(means.fit(features).clusterCenters())
    finally:
        features.unpersist()
    return centers


def nearest_cell(vector: Column, centers: np.ndarray) -> Column:
    """Number of the closest centroid."""
    units = unit_rows(centers)

    @F.arrow_udf(T.IntegerType())
    def assign(vectors: pa.Array) -> pa.Array:
        usable, rows = matrix_of(vectors, units.shape[1])
        out = np.full(len(usable), NO_CELL, dtype=np.int32)
        best, step = np.zeros(len(rows), np.int32), max(1, SCORES_AT_ONCE // len(units))
        for low in range(0, len(rows), step):
            scores = rows[low : low + step] @ units.T
            best[low : low + step] = np.argmax(np.where(np.isnan(scores), -np.inf, scores), axis=1)
        out[usable] = np.where(np.linalg.norm(rows, axis=1) > 0, best, NO_CELL)
        return pa.array(out)

    return assign(vector)


def build(
    df: DataFrame,
    path: str,
    cells: int = 500,
    vector: str = "embedding",
    metric: str = "cosine",
    seed: int = 7,
    iterations: int = 10,
    training: DataFrame | None = None,
    centers: np.ndarray | None = None,
) -> IvfIndex:
    """Write an index of ``df`` below ``path``, which must not exist yet.

    Centroids are given as ``centers``, or trained on all rows of the table, or on
    all rows of ``training``, such as a few of its files, which saves reading a very
    large table several times.

    ``rebalance`` brings a cell's rows together and lets adaptive execution
    split a cell that holds much of the table.
    """
    spark = df.sparkSession
    if centers is None:
        centers = train_centroids(df if training is None else training, cells, vector, seed, iterations)
    if _dimensions(df, vector) != centers.shape[1]:
        raise ValueError("the vectors and the centers differ in length")
    filed = df.withColumn("cell", nearest_cell(F.col(vector), centers))
    filed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    spark.createDataFrame(rows, "cell int, center array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return IvfIndex(path, len(centers), metric)


def cells_to_probe(centroids: DataFrame, query: Sequence[float], probes: int) -> list[int]:
    """The ``probes`` cells whose centroids are closest to the query."""
    ranked = nearest(centroids, query, probes, vector="center", id_col="cell")
    return [row["cell"] for row in ranked.collect()]


def search(
    spark: SparkSession,
    index: IvfIndex,
    query: Sequence[float],
    n: int = 10,
    probes: int = 50,
    vector: str = "embedding",
    id_col: str = "id",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The ``n`` most similar rows among the probed cells, best first.

    The cells are literals in the scan, so only their folders are read.  With
    as many probes as cells the result is the exact one.
    """
    chosen = cells_to_probe(index.centroids(spark), query, probes)
    if index.metric == "inner_product":
        chosen.append(NO_CELL)
    scan = index.vectors(spark).where(F.col("cell").isin(*chosen)).drop("cell")
    scan = scan.select(*columns, vector) if columns else scan
    return nearest(scan, query, n, vector, id_col, index.metric)


def search_for_queries(
    spark: SparkSession,
    index: IvfIndex,
    queries: DataFrame,
    n: int,
    probes: int = 50,
    vector: str = "embedding",
    id_col: str = "id",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """``search`` for each query in one scan: query id, id, ``cos_sim``, ``rn``.

    The queries and their cells go to every task, and a cell's vectors meet only
    the queries that probe it.
    """
    near = nearest_for_queries(index.centroids(spark), queries, probes, "center", "cell", query_id, query_vector)
    listed = queries.select(query_id, query_vector).join(near.select(query_id, "cell"), query_id).toArrow()
    listed = listed.combine_chunks()
    cells = listed["cell"].to_numpy()
    by_cell = {int(c): listed.filter(pa.array(cells == c)) for c in np.unique(cells)}
    if index.metric == "inner_product" and len(cells):
        first = np.unique(np.array(listed[query_id].to_pylist(), object), return_index=True)[1]
        by_cell[NO_CELL] = listed.take(pa.array(first))
    names = [query_id, id_col, "cos_sim"]
    scan = index.vectors(spark).where(F.col("cell").isin(*by_cell)).select("cell", id_col, vector)
    types = [queries.schema[query_id].dataType, scan.schema[id_col].dataType, T.DoubleType()]
    layout = T.StructType([T.StructField(c, t) for c, t in zip(names, types)])

    def task(batches):
        sets = {}
        for batch in batches:
            here = batch.column(0).to_numpy()
            for c in np.unique(here):
                if c not in sets:
                    own = by_cell[int(c)].combine_chunks().to_batches()[0]
                    sets[c] = queries_by_length(own[query_id], own[query_vector], n, names, index.metric)
                rows = batch.filter(pa.array(here == c))
                for best in sets[c]:
                    best.add(rows.column(1), rows.column(2))
        for best in (b for found in sets.values() for b in found):
            for rows in best.tables():
                yield from rows.to_batches()

    return merged_best(scan.mapInArrow(task, layout), query_id, id_col, n)
