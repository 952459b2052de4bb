"""Row picking and numbering inside groups, and top-k over everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import to_scratch

# From this k on, per-task winners are merged in two steps: a top-k over
# 100,000 tasks would otherwise send tasks x k rows into one place.
WIDE_TOP_K = 256
MERGE_GROUPS = 256


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows by ``order``, which must end in a unique key."""
    if k < WIDE_TOP_K:
        return df.orderBy(*order).limit(k)
    # Each task keeps its own first k before the shuffle (window group limit),
    # then each merge group keeps k, and only groups x k rows meet at the end.
    grouped = df.withColumn("_merge", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    return top_per_group(grouped, ["_merge"], order, k).drop("_merge").orderBy(*order).limit(k)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each group, with their number in ``rank`` if named."""
    name = rank or "_rn"
    window = Window.partitionBy(*keys).orderBy(*order)
    picked = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return picked if rank else picked.drop(name)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    return top_per_group(df, keys, order, 1)


def latest_per_key(df: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """The newest row of each key; the larger ``tie`` wins among equals."""
    return keep_first(df, [key], [F.col(when).desc_nulls_last(), F.col(tie).desc()])


def union_first_wins(frames: Sequence[DataFrame], keys: Sequence[str], tie: Sequence[Column]) -> DataFrame:
    """Union by name, one row per key; earlier frames win, then ``tie``."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    whole = tagged[0]
    for frame in tagged[1:]:
        whole = whole.unionByName(frame)
    return keep_first(whole, keys, [F.col("_source"), *tie]).drop("_source")


def before_known(df: DataFrame, known: DataFrame, key: str, position: str) -> DataFrame:
    """Rows that come before the first row whose key is in ``known``.

    ``position`` numbers the list; without a known key the whole list stays.
    """
    first = df.join(known.select(key).distinct(), key, "left_semi").agg(F.min(position).alias("_cut"))
    return (
        df.crossJoin(F.broadcast(first))
        .where(F.col("_cut").isNull() | (F.col(position) < F.col("_cut")))
        .drop("_cut")
    )


def dense_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Dense rank of ``value`` inside each group, largest first.

    Only distinct pairs of key and value are ranked; rows then look their rank up,
    so a group that holds most rows costs no more than its distinct values.
    """
    pairs = df.select(*keys, value).distinct()
    window = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    ranked = pairs.withColumn(out, F.dense_rank().over(window)).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, value)]
    return df.alias("a").join(ranked, same).select("a.*", f"b.{out}")


# Groups above this many rows are numbered slice by slice.
HOT_GROUP_ROWS = 2_000_000


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """0-based position of each row in its group, by the ``order`` columns.

    A group is normally numbered in one task.  A group of more than
    ``hot_rows`` rows is cut into slices along its first order column, which
    must be numeric; slices are numbered on their own and shifted by the size
    of the slices before them.  Rows with a null in that column come first.
    """
    keys = list(keys)
    lead = F.col(order[0]).cast("double")
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(lead).alias("_low"), F.max(lead).alias("_high")
    )
    hot = to_scratch(sizes.where(F.col("_n") > hot_rows), "hot-groups")
    by_order = [F.col(c) for c in order]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*by_order)) - 1
    if hot.isEmpty():
        return df.withColumn(out, number)

    def same_group(left: str, right: str) -> list[Column]:
        return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]

    share = F.try_divide(lead - F.col("_low"), F.col("_high") - F.col("_low"))
    slices = F.ceil(F.col("_n") / F.lit(hot_rows))
    slice_no = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * slices), slices - 1)
    sliced = df.alias("a").join(hot.alias("b"), same_group("a", "b"), "left")
    sliced = sliced.select("a.*", F.coalesce(slice_no, F.lit(0)).alias("_slice"), F.col("_n").isNotNull().alias("_hot"))

    # One short row per slice of a hot group.
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = to_scratch(
        sliced.where("_hot")
        .groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .where(F.col("_slice") > 0),
        "slice-shifts",
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*by_order)) - 1
    numbered = sliced.withColumn(out, inside).alias("a")
    same_slice = [*same_group("a", "b"), F.col("a._slice") == F.col("b._slice")]
    total = (F.col(out) + F.coalesce(F.col("_shift"), F.lit(0))).cast("int")
    return numbered.join(shifts.alias("b"), same_slice, "left").select(
        *[F.col(f"a.{c}") for c in df.columns], total.alias(out)
    )
