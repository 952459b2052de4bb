"""Score arithmetic shared by the searches."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the constant of reciprocal rank fusion.
FUSION_K = 60


def rank_share(rank: Column, k: int = FUSION_K) -> Column:
    """``k / (k + rank)``; 0 for a missing rank."""
    return F.coalesce(F.lit(float(k)) / (rank + F.lit(float(k))), F.lit(0.0))


def reciprocal_rank(rank: Column, k: int = FUSION_K) -> Column:
    """``1 / (k + rank)``; 0 for a missing rank."""
    return F.coalesce(F.lit(1.0) / (rank + F.lit(float(k))), F.lit(0.0))


def weighted_sum(a: Column, weight_a: float, b: Column, weight_b: float) -> Column:
    return a * F.lit(float(weight_a)) + b * F.lit(float(weight_b))


def weighted_mean(a: Column, weight_a: float, b: Column, weight_b: float) -> Column:
    total = F.lit(float(weight_a) + float(weight_b))
    return F.try_divide(weighted_sum(a, weight_a, b, weight_b), total)


def null_to_zero(values: Column) -> Column:
    """A list of doubles with nulls and NaN replaced by 0."""
    zero = F.lit(0.0)
    return F.transform(values, lambda x: F.coalesce(F.nanvl(x, zero), zero))
