"""Statistics over a whole result, and fusion of two rankings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def add_z_scores(df: DataFrame, outputs: Mapping[str, str]) -> DataFrame:
    """Standard scores over all rows, as ``{value column: new column}``.

    They are null for one row or no spread.  Means and deviations are one row,
    so they are broadcast; a window without partition keys would move every
    row into one task.  The statistics and the result both read the rows, so a
    caller whose rows are costly to make writes them first.
    """
    stats = df.agg(
        *[F.avg(v).alias(f"_mean_{v}") for v in outputs], *[F.stddev_samp(v).alias(f"_sd_{v}") for v in outputs]
    )
    scores = {
        out: F.try_divide(F.col(v) - F.col(f"_mean_{v}"), F.col(f"_sd_{v}")) for v, out in outputs.items()
    }
    return df.crossJoin(F.broadcast(stats)).withColumns(scores).drop(*stats.columns)


def first_known(name: str, left: str, right: str) -> Column:
    return F.coalesce(F.col(f"{left}.{name}"), F.col(f"{right}.{name}")).alias(name)
