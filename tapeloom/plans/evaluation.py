"""Approximate against exact search over a grid of index settings."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import ivf
from ..operators.nearest import by_similarity, nearest_for_queries
from ..operators.quality import compare_rankings
from ..operators.rows import top_per_group
from ..session import to_scratch
from .chunk_search import SearchTables

SETTINGS = ["configuration", "nearest_neighbors_to_screen", "probes"]


def _rankings(tables: SearchTables, candidates: DataFrame, min_chunks: int, n: int) -> DataFrame:
    """``neural_ranking`` of each query's candidates: query, url and ``rank`` from 1."""
    chunks = tables.embeddings.select("id", "url").join(candidates.select("query", "id", "cos_sim"), "id")
    best = top_per_group(chunks, ["query", "url"], by_similarity(), 5)
    stats = best.groupBy("query", "url").agg(F.count("cos_sim").alias("n_chunks"), F.max("cos_sim").alias("highest"))
    spread = stats.groupBy("query").agg(F.avg("highest").alias("_mean"), F.stddev_samp("highest").alias("_sd"))
    score = F.try_divide(F.col("highest") - F.col("_mean"), F.col("_sd")) * F.col("n_chunks")
    scored = stats.join(spread, "query").withColumn("score", score).where(F.col("n_chunks") >= min_chunks)
    order = [F.round("score", 12).desc_nulls_last(), F.col("url")]
    return top_per_group(scored, ["query"], order, n, rank="rank").select("query", "url", "rank")


def _timed(found: DataFrame, n_queries: int, configuration: str, screen: int | None, probe: int | None) -> DataFrame:
    """The rankings, written once, with their setting and the seconds per query."""
    started = time.perf_counter()
    rows = to_scratch(found, "rankings")
    seconds = (time.perf_counter() - started) / max(1, n_queries)
    setting = {"configuration": configuration, "nearest_neighbors_to_screen": screen, "probes": probe}
    typed = {k: F.lit(v).cast("string" if k == "configuration" else "int") for k, v in setting.items()}
    return rows.withColumns(typed | {"query_time": F.lit(seconds)})


def sweep(
    tables: SearchTables,
    queries: DataFrame,
    folder: str,
    lists: Sequence[int] = (10, 50, 100),
    probes: Sequence[int] = (1, 4, 10),
    screens: Sequence[int] = (1000, 10_000, 50_000),
    metric: str = "inner_product",
    n: int = 10,
    n_chunks: int = 1500,
    min_chunks: int = 2,
) -> DataFrame:
    """Overlap, tau and time per query and setting, for ``queries(query, vector)``.

    All queries of a setting are answered by one plan, so the time of a query
    is that of its setting divided by their number.
    One index per number of lists is built below ``folder``.  Settings that
    probe more cells than exist are skipped.
    """
    spark = tables.embeddings.sparkSession
    queries = to_scratch(queries.select("query", "vector"), "sweep-queries")
    n_queries = queries.count()
    near = nearest_for_queries(tables.embeddings, queries, n_chunks, query_id="query", query_vector="vector")
    exact = _timed(_rankings(tables, near, min_chunks, n), n_queries, "exact", None, None)
    parts = []
    for cells in lists:
        index = ivf.build(tables.embeddings, f"{folder}/lists={cells}", cells, metric=metric)
        for probe in (p for p in probes if p <= cells):
            for screen in screens:
                near = ivf.search_for_queries(
                    spark, index, queries, min(screen, n_chunks), probe, query_id="query", query_vector="vector"
                )
                label = f"ivfflat@lists={cells}_probes={probe}"
                parts.append(_timed(_rankings(tables, near, min_chunks, n), n_queries, label, screen, probe))
    found = reduce(DataFrame.unionByName, parts, exact.limit(0))
    compared = compare_rankings(exact, found, SETTINGS, n)
    times = found.groupBy("query", *SETTINGS).agg(F.max("query_time").alias("query_time"))
    return compared.join(times, ["query", *SETTINGS])
