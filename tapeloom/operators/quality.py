"""How close an approximate ranking comes to the exact one."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import to_scratch


def _orders_by_inversions(n: int) -> list[int]:
    """How many orders of ``n`` items have 0, 1, 2, ... inversions."""
    counts = [1]
    for size in range(2, n + 1):
        longer = [0] * (len(counts) + size - 1)
        for inversions, ways in enumerate(counts):
            for extra in range(size):
                longer[inversions + extra] += ways
        counts = longer
    return counts


def tau_p_value(n: int, discordant: int) -> float:
    """Two-sided exact p-value of Kendall's tau for ``n`` items without ties."""
    counts = _orders_by_inversions(n)
    tail = min(discordant, len(counts) - 1 - discordant)
    return min(1.0, 2.0 * sum(counts[: tail + 1]) / math.factorial(n))


def kendall_tau(ranks: Column) -> Column:
    """Tau of a short list of second ranks, listed in order of the first rank."""
    n = F.size(ranks)
    pairs = n * (n - 1) / F.lit(2)
    return F.try_divide(pairs - 2 * discordant_pairs(ranks), pairs)


def discordant_pairs(ranks: Column) -> Column:
    """Pairs of the list whose order is reversed; the list is at most a top ten."""

    def later_smaller(value: Column, i: Column) -> Column:
        rest = F.slice(ranks, i + 2, F.greatest(F.size(ranks) - i - 1, F.lit(0)))
        return F.size(F.filter(rest, lambda other: other < value))

    return F.aggregate(F.transform(ranks, later_smaller), F.lit(0), lambda a, b: a + b)


def compare_rankings(
    exact: DataFrame, approximate: DataFrame, settings: list[str], n: int = 10, query: str = "query", item: str = "url"
) -> DataFrame:
    """Overlap and tau of the first ``n`` items per query and setting.

    Both frames need ``rank``, 1 for the best.  Tau is taken over the ranks of
    the common items and is null for fewer than two of them.
    """
    best = exact.where(F.col("rank") <= n).select(query, item, F.col("rank").alias("_exact"))
    listed = approximate.where(F.col("rank") <= n)
    joined = listed.join(best, [query, item], "left")
    pair = F.when(F.col("_exact").isNotNull(), F.struct("_exact", "rank"))
    lists = joined.groupBy(query, *settings).agg(F.array_sort(F.collect_list(pair)).alias("_pairs"))
    ranks = F.transform(F.col("_pairs"), lambda p: p["rank"])
    table = F.array(*[
        F.array(*[F.lit(tau_p_value(size, d)) for d in range(size * (size - 1) // 2 + 1)]) for size in range(2, n + 1)
    ])
    size = F.size("_pairs")
    return lists.select(
        query,
        *settings,
        size.alias("n_overlap"),
        kendall_tau(ranks).alias("kendall_tau"),
        F.when(size >= 2, F.get(F.get(table, size - 2), discordant_pairs(ranks))).alias("p_value"),
    )


def mean_by(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"))


def quantiles(df: DataFrame, value: str, by: list[str], shares: Mapping[str, float]) -> DataFrame:
    """Quantiles per group, interpolated between neighbours, as columns named by ``shares``.

    Values are counted, dealt out by ranges of group and value, and numbered by
    running counts inside each range plus the counts of the ranges before.  So
    no task holds the values of a whole group, however few groups there are.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    dealt = to_scratch(counted.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "quantiles")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    parts = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_rows"))
    parts = parts.withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    parts = parts.withColumn("_total", F.sum("_rows").over(whole)).drop("_rows").alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*by, "_part")]
    inside = Window.partitionBy(*by, "_part").orderBy(value)
    numbered = dealt.withColumn("_upto", F.sum("_n").over(inside)).alias("a").join(parts, same)
    end = F.col("a._upto") + F.col("b._shift")
    start = end - F.col("a._n")
    columns = []
    for name, share in shares.items():
        spot = (F.col("_total") - 1) * F.lit(share)
        for side, place in (("low", F.floor(spot)), ("high", F.ceil(spot))):
            here = (place >= start) & (place < end)
            columns.append(F.max(F.when(here, F.col(f"a.{value}"))).alias(f"_{side}_{name}"))
        columns.append(F.max(spot - F.floor(spot)).alias(f"_rest_{name}"))
    picked = numbered.groupBy(*[F.col(f"a.{k}").alias(k) for k in by]).agg(*columns)
    between = {
        n: F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_rest_{n}") for n in shares
    }
    return picked.select(*by, *[c.alias(n) for n, c in between.items()])


def five_numbers(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    names = {"lowest": 0.0, "quartile_1": 0.25, "median": 0.5, "quartile_3": 0.75, "highest": 1.0}
    return quantiles(df, value, by, names)
