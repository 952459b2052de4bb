"""Exact nearest vectors, for one query and for many."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.vectors import SCORE_DECIMALS, cosine, inner_product, matrix_of, score_batch, unit_rows
from .rows import top_k, top_per_group

# Query vectors up to this size go to every task; more are handled block-wise.
QUERY_BYTES = 64 * 2**20
# Scores of vectors against queries that are held at once.
SCORES_AT_ONCE = 1 << 22
# Task winners of one query are merged in so many groups before they meet.
MERGE_GROUPS = 64
# Query and vector rows per cell of the block-wise grid.
GRID_QUERIES = 4096
GRID_VECTORS = 20_000


def score(df: DataFrame, query: Sequence[float], vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """``df`` without its vectors but with ``cos_sim``, null where there is no score.

    The vectors leave the plan here, before any shuffle.  Drop null scores with
    `scored` after ranking: a filter right here would be pushed below the
    scoring and score every vector twice.
    """
    fn = {"cosine": cosine, "inner_product": inner_product}[metric]
    return df.withColumn("cos_sim", fn(F.col(vector), query)).drop(vector)


def scored(ranked: DataFrame) -> DataFrame:
    """The rows of a ranking that have a score; the others rank last."""
    return ranked.where(F.col("cos_sim").isNotNull())


def by_similarity(id_col: str = "id") -> list:
    return [F.col("cos_sim").desc_nulls_last(), F.col(id_col)]


def first_rows(rows: pa.Table, n: int, id_col: str) -> pa.Table:
    """The ``n`` best rows of a table, equal scores by id."""
    if rows.num_rows <= n:
        return rows
    order = pc.sort_indices(rows, sort_keys=[("cos_sim", "descending"), (id_col, "ascending")])
    return rows.take(order[:n])


def contenders(scores: np.ndarray, best: pa.Table | None, n: int) -> np.ndarray:
    """Positions of scores that may enter the ``n`` best; NaN never does."""
    floor = pc.min(best["cos_sim"]).as_py() if best is not None and best.num_rows >= n else -np.inf
    picked = np.flatnonzero(scores >= floor)
    if len(picked) > n:
        picked = picked[scores[picked] >= np.partition(scores[picked], -n)[-n]]
    return picked


def nearest(
    df: DataFrame,
    query: Sequence[float],
    n: int = 10,
    vector: str = "embedding",
    id_col: str = "id",
    metric: str = "cosine",
) -> DataFrame:
    """The ``n`` most similar rows, best first, without their vectors.

    Every task keeps its own ``n`` best rows while it reads, so neither all
    scores nor any vector comes back to the JVM.
    """
    target = np.asarray(query, dtype=np.float64)
    rest = [c for c in df.columns if c != vector]
    layout = T.StructType([df.schema[c] for c in rest]).add("cos_sim", T.DoubleType())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            scores = score_batch(rows[vector], target, metric)
            picked = contenders(scores, best, n)
            if len(picked):
                found = rows.select(rest).take(pa.array(picked)).append_column("cos_sim", pa.array(scores[picked]))
                best = first_rows(found if best is None else pa.concat_tables([best, found]), n, id_col)
        if best is not None:
            yield from best.to_batches()

    return top_k(df.mapInArrow(scan, layout), by_similarity(id_col), n)


def nearest_per_group(
    df: DataFrame, query: Sequence[float], group: str, n: int, vector: str = "embedding", id_col: str = "id"
) -> DataFrame:
    """The ``n`` most similar rows of each group, numbered in ``rn``."""
    return scored(top_per_group(score(df, query, vector), [group], by_similarity(id_col), n, rank="rn"))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class _Best:
    """The best rows of every query among the vectors seen so far.

    Queries are taken in tiles, so that a block of scores stays within
    ``SCORES_AT_ONCE`` however many queries or rows there are.
    """

    def __init__(self, query_ids: pa.Array, queries: np.ndarray, n: int, names: list[str], metric: str = "cosine"):
        self.query_ids, self.queries, self.n, self.names = query_ids, queries, n, names
        self.scaled = unit_rows if metric == "cosine" else np.asarray
        self.floor = np.full(len(query_ids), -np.inf)
        self.found: list[pa.Table] = []
        self.waiting = 0

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        usable, matrix = matrix_of(vectors, self.queries.shape[1])
        if not len(matrix):
            return
        kept, units = ids.filter(pa.array(usable)), self.scaled(matrix)
        tile = max(1, SCORES_AT_ONCE // len(units))
        for low in range(0, len(self.queries), tile):
            scores = np.round(units @ self.queries[low : low + tile].T, SCORE_DECIMALS)
            floor = self.floor[low : low + tile]
            if len(units) > self.n:
                # The n-th best of this batch for each query; NaN is never among them.
                known = np.where(np.isnan(scores), -np.inf, scores)
                floor = np.maximum(floor, np.partition(known, -self.n, axis=0)[-self.n])
            rows, queries = np.nonzero(scores >= floor)
            if len(rows):
                columns = [pa.array(queries + low), kept.take(pa.array(rows)), pa.array(scores[rows, queries])]
                self.found.append(pa.table(columns, ["_q", *self.names[1:]]))
                self.waiting += len(rows)
                if self.waiting > max(1 << 16, 4 * self.n * len(self.queries)):
                    self.prune()

    def prune(self) -> None:
        """Keep the best ``n`` of each query, equal scores by id."""
        rows = pa.concat_tables(self.found)
        keys = [("_q", "ascending"), (self.names[2], "descending"), (self.names[1], "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys))
        query = rows["_q"].to_numpy()
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = nth == self.n - 1
        self.floor[query[last]] = rows[self.names[2]].to_numpy()[last]
        self.found = [rows.filter(pa.array(nth < self.n))]
        self.waiting = self.found[0].num_rows

    def tables(self) -> Iterator[pa.Table]:
        if self.found:
            self.prune()
            rows = self.found[0]
            yield rows.set_column(0, self.names[0], self.query_ids.take(rows["_q"].combine_chunks()))


def queries_by_length(
    ids: pa.Array, vectors: pa.Array, n: int, names: list[str], metric: str = "cosine"
) -> list[_Best]:
    """Query vectors, one matrix per vector length; an empty vector has no neighbours."""
    found = []
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    for dims in sorted(d for d in lengths if d):
        usable, matrix = matrix_of(vectors, dims)
        scaled = unit_rows(matrix) if metric == "cosine" else matrix
        found.append(_Best(ids.filter(pa.array(usable)), scaled, n, names, metric))
    return found


def nearest_for_queries(
    df: DataFrame,
    queries: DataFrame,
    n: int,
    vector: str = "embedding",
    id_col: str = "id",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The ``n`` most similar rows for each query: query id, id, ``cos_sim``, ``rn``.

    Each task multiplies its batches of vectors with the matrix of queries and
    passes on its ``n`` best rows per query.  A query set too large to
    send to every task is laid out with the vectors on a grid of blocks.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    query_type = queries.schema[query_id].dataType.simpleString()
    layout = f"`{query_id}` {query_type}, `{id_col}` {id_type}, cos_sim double"
    queries = queries.select(query_id, query_vector).where(F.size(query_vector) > 0)
    names = [query_id, id_col, "cos_sim"]
    id_bytes = F.octet_length(F.col(query_id).cast("string"))
    n_queries, size = queries.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(8 * F.size(query_vector) + F.coalesce(id_bytes, F.lit(0))), F.lit(0))
    ).first()
    if size <= query_bytes:
        listed = queries.toArrow()
        ids, vectors = _whole(listed[query_id]), _whole(listed[query_vector])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = queries_by_length(ids, vectors, n, names)
            for batch in batches:
                for best in sets:
                    best.add(batch.column(0), batch.column(1))
            for best in sets:
                for rows in best.tables():
                    yield from rows.to_batches()

        candidates = df.select(id_col, vector).mapInArrow(scan, layout)
    else:
        candidates = _grid(df, queries, n, vector, id_col, query_id, query_vector, n_queries, layout)
    return merged_best(candidates, query_id, id_col, n)


def merged_best(candidates: DataFrame, query_id: str, id_col: str, n: int) -> DataFrame:
    """The ``n`` best of each query among the winners of every task; groups of tasks are merged first."""
    merged = candidates.withColumn("_merge", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    merged = top_per_group(merged, [query_id, "_merge"], by_similarity(id_col), n).drop("_merge")
    return top_per_group(merged, [query_id], by_similarity(id_col), n, rank="rn")


def _grid(df, queries, n, vector, id_col, query_id, query_vector, n_queries, layout) -> DataFrame:
    """Every query block meets every vector block, each pair in a task of its own."""
    q_blocks = -(-n_queries // GRID_QUERIES)
    v_blocks = max(1, -(-df.count() // GRID_VECTORS))
    v_block = F.pmod(F.xxhash64(id_col), F.lit(v_blocks))
    q_block = F.pmod(F.xxhash64(query_id), F.lit(q_blocks))
    left = df.select(id_col, vector, v_block.alias("_v")).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    right = queries.withColumn("_q", q_block).withColumn(
        "_v", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1)))
    )

    names = [query_id, id_col, "cos_sim"]

    def meet(vectors: pa.Table, block: pa.Table) -> pa.Table:
        ids, rows = _whole(vectors[id_col]), _whole(vectors[vector])
        types = [block.schema.field(query_id).type, ids.type, pa.float64()]
        parts = [pa.table([pa.array([], t) for t in types], names)]
        for best in queries_by_length(_whole(block[query_id]), _whole(block[query_vector]), n, names):
            best.add(ids, rows)
            parts += best.tables()
        return pa.concat_tables(parts)

    return left.groupBy("_v", "_q").cogroup(right.groupBy("_v", "_q")).applyInArrow(meet, layout)
