"""Deltas, restrictions and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def _on(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def keys_of(df: DataFrame, columns: str | Sequence[str], rename: str | Sequence[str] | None = None) -> DataFrame:
    """Distinct non-null keys.

    The partial half of the aggregate shrinks a hot key to one row per task
    before the shuffle, and the shuffle is the one the join needs anyway.
    """
    columns, names = _on(columns), _on(rename or columns)
    picked = df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)])
    return picked.na.drop(subset=names).distinct()


def absent(df: DataFrame, known: DataFrame, on: str | Sequence[str], known_on: str | Sequence[str] | None = None) -> DataFrame:
    """Rows whose key is not in ``known``; rows with a null key stay."""
    return df.join(keys_of(known, known_on or on, on), _on(on), "left_anti")


def present(df: DataFrame, known: DataFrame, on: str | Sequence[str], known_on: str | Sequence[str] | None = None) -> DataFrame:
    """Rows whose key is in ``known``, each once."""
    return df.join(keys_of(known, known_on or on, on), _on(on), "left_semi")


def absent_null_aware(df: DataFrame, known: DataFrame, on: str, known_on: str | None = None) -> DataFrame:
    """SQL ``NOT IN``: a null among the known keys leaves nothing.

    Spark can run ``NOT IN`` only by broadcasting the known side.  Here the
    keys are shuffled as in a plain anti join, and the null rules ride on a
    one-row summary.
    """
    key = F.col(known_on or on)
    summary = known.agg(
        F.count(F.lit(1)).alias("_known"), F.count_if(key.isNull()).alias("_known_null")
    )
    kept = absent(df, known, on, known_on).crossJoin(F.broadcast(summary))
    rule = (F.col("_known") == 0) | ((F.col("_known_null") == 0) & F.col(on).isNotNull())
    return kept.where(rule).drop("_known", "_known_null")


# Up to this many keys go into the scan as literals, where they prune files
# and row groups.
LITERAL_KEYS = 100
# Up to this many keys are held as a list.  Its frame has a size the planner
# knows, so a join with it need not shuffle the other side.
LISTED_KEYS = 10_000

Keys = Sequence[str] | DataFrame


def short_list(keys: Keys) -> Keys:
    """A list when there are few keys; otherwise the keys as they are."""
    if not isinstance(keys, DataFrame):
        return keys
    found = keys_of(keys, keys.columns[0]).limit(LISTED_KEYS + 1).collect()
    return keys if len(found) > LISTED_KEYS else [row[0] for row in found]


def restrict(df: DataFrame, keys: Keys, on: str) -> DataFrame:
    """Rows whose key is in a supplied list or one-column frame."""
    if isinstance(keys, DataFrame):
        return present(df, keys, on, keys.columns[0])
    unique = sorted({k for k in keys if k is not None})
    if not unique:
        return df.where(F.lit(False))
    if len(unique) <= LITERAL_KEYS:
        return df.where(F.col(on).isin(*unique))
    return df.join(df.sparkSession.createDataFrame(pa.table({on: unique})), on, "left_semi")


def first_keys(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """A work list: the ``n`` smallest distinct keys, or all of them."""
    keys = keys_of(df, key)
    return keys if n is None else keys.orderBy(key).limit(n)


def for_first_absent(
    df: DataFrame, known: DataFrame, on: str, known_on: str | None = None, n: int | None = None
) -> DataFrame:
    """All rows of the ``n`` smallest keys that are not known, or of all such keys.

    The keys are chosen from the key columns alone, and the rows meet them in one
    semi join, so adaptive execution can split a key that holds many rows.
    """
    if n is None:
        return absent(df, known, on, known_on)
    waiting = first_keys(absent(df.select(on), known, on, known_on), on, n)
    return present(df, waiting, on)


def expand_range(df: DataFrame, start: str, end: str, out: str, keep_empty: bool = False) -> DataFrame:
    """One row per integer in ``[start, end)``; an empty range gives null or nothing."""
    span = F.when(F.col(end) > F.col(start), F.sequence(F.col(start), F.col(end) - 1))
    return df.withColumn(out, (F.explode_outer if keep_empty else F.explode)(span))


def interval_join(
    ranges: DataFrame,
    points: DataFrame,
    on: str,
    point: str,
    start: str = "start_segment",
    end: str = "end_segment",
    how: str = "inner",
) -> DataFrame:
    """Join points to the half-open integer ranges that hold them.

    Ranges are expanded to their integers, so the join is an equi join on
    ``(on, point)``.  Rows spread by both keys, and one group with a third of
    the data is no slower than many small ones.
    """
    outer = how == "left"
    expanded = expand_range(ranges, start, end, point, keep_empty=outer)
    return expanded.join(points, [on, point], "left" if outer else "inner")


def flag_null(name: str, kind: str) -> Column:
    """A typed column of nulls."""
    return F.lit(None).cast(kind).alias(name)
