"""Mix sources to target weights by thresholds on a hash, found from histograms.

1. A source's target follows from the sources' sizes and weights (``targets``).
2. What a target asks for beyond whole passes over its source is a budget of
   words.  Rows of a source are taken in the order of a 60-bit hash up to a
   threshold.  The threshold is found digit by digit, as in a radix search: sum the
   sizes by source and hash bucket (4,096 rows per source at most), find the bucket
   in which the running sum meets the budget, and refine only that bucket until it
   holds one row.
3. Rows are then filtered by a comparison with their source's threshold.  Nothing
   is sorted but the buckets, and thresholds of growing budgets are nested: a row
   that a smaller budget takes is also taken by a larger one.

All sums are partial aggregates, so a source with a third of all rows costs no
more than others.  The table of sources is a table like any other; only counts per
range of sources and one-row sums come to the driver.

Defined results: a null text has size 0; a null source is a source of its own, in
the last place.  The hash covers id and text, so reruns agree whatever the layout;
fully repeated rows share a hash and are taken or left together.  A source of size
0 has target 0.  The boundary row is taken if that brings the sum closer to the
target, not on a tie.  An empty table gives an empty result.  Rows travel inside
one struct, so names of other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import to_scratch
from .common import WORD, field, packed, text_or_empty, unpacked

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
DIGITS = 15  # hexadecimal digits of the hash
STEP = 3  # digits that a histogram resolves
BUCKETS = 16**STEP


def with_size_and_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text_or_empty(text_col))
    return docs.withColumns({
        "_m_size": F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long"),
        "_m_hash": F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("long"),
    })


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of each source by code point, null last.

    Sources are dealt out by ranges; a source's place is its place in its range
    plus the sizes of the ranges before, one number for each task.
    """
    by = F.col("source").asc_nulls_last()
    dealt = to_scratch(sources.repartitionByRange(by).withColumn("part", F.spark_partition_id()), "mix-ranges")
    sizes = dict(dealt.groupBy("part").count().collect())
    before, pairs = 0, [F.lit(-1), F.lit(0)]
    for part in sorted(sizes):
        pairs += [F.lit(part), F.lit(before)]
        before += sizes[part]
    inside = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return dealt.withColumn("rank", inside + F.element_at(F.create_map(*pairs), F.col("part"))).drop("part")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``: shares of the sum of all sizes by weight.

    No target exceeds ``passes`` times its source; the excess is shared out again
    by weight until none does.  Each round is one sum over the sources.
    """
    table = F.array(*[F.lit(w) for w in weights])
    df = ranked(sizes).withColumn("weight", F.get(table, F.col("rank") % len(weights))).drop("rank")
    df = to_scratch(df.withColumn("most", F.col("source_size") * passes), "mix-sources")
    total, weight = df.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total or 0) / (weight or 1), -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most")
        found = df.agg(
            F.count(F.when(above, 1)),
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)),
            F.sum(F.when(~above, F.col("weight"))),
        ).first()
        if found[0] == full or not found[2]:
            break
        full, level = found[0], (total - found[1]) / found[2]
    target = F.least(F.col("weight") * F.lit(level), F.col("most").cast("double"))
    return df.select("source", "source_size", target.alias("target"))


def _with(rows: DataFrame, found: DataFrame, also: Column | None = None) -> DataFrame:
    """``rows`` with what was found for their source, which may be null."""
    named = found.withColumnRenamed("source", "_m_source")
    same = F.col("source").eqNullSafe(F.col("_m_source"))
    return rows.join(named, same if also is None else same & also).drop("_m_source")


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``(source, passes, limit)``: rows with ``hash < limit`` get one more than ``passes``.

    ``rows`` are ``(source, size, hash)``.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goals.select(
        "source",
        passes.cast("long").alias("passes"),
        (F.col("target") - passes * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("before"),
        F.lit(0).cast("long").alias("inside"),
        F.col("source_size").alias("n"),
    )
    open_now, shift, solved = state.where("budget > 0"), 4 * DIGITS, [state.where("budget <= 0").withColumn("shift", F.lit(60))]
    while True:
        shift -= 4 * STEP
        own = open_now.select("source", "prefix", "budget", "before", "passes")
        wide = _with(rows, own, F.shiftright("hash", shift + 4 * STEP) == F.col("prefix"))
        wide = wide.withColumn("bucket", F.shiftright("hash", shift))
        sums = wide.groupBy("source", "prefix", "budget", "before", "passes", "bucket").agg(
            F.sum("size").alias("inside"), F.count(F.lit(1)).alias("n")
        )
        order = Window.partitionBy("source").orderBy("bucket")
        running = F.col("before") + F.sum("inside").over(order.rowsBetween(Window.unboundedPreceding, 0))
        reached = sums.withColumn("running", running).where(F.col("running") >= F.col("budget"))
        first = reached.withColumn("no", F.row_number().over(order)).where("no = 1")
        state = to_scratch(
            first.select(
                "source", "passes", "budget", F.col("bucket").alias("prefix"),
                (F.col("running") - F.col("inside")).alias("before"), "inside", "n",
            ),
            "mix-thresholds",
        )
        done = F.lit(shift == 0) | (F.col("n") == 1)
        solved.append(state.where(done).withColumn("shift", F.lit(shift)))
        open_now = state.where(~done)
        if open_now.isEmpty():
            break
    whole = solved[0]
    for part in solved[1:]:
        whole = whole.unionByName(part)
    closer = (F.col("budget") > 0) & (2 * (F.col("budget") - F.col("before")) > F.col("inside"))
    limit = F.expr("shiftleft(prefix, shift)") + F.when(closer, F.expr("shiftleft(1L, shift)")).otherwise(0)
    return whole.select("source", "passes", F.when(F.col("budget") > 0, limit).otherwise(0).alias("limit"))


def plan(rows: DataFrame, weights: Sequence[int], passes: int) -> DataFrame:
    """``(source, source_size, target, passes, limit)`` from ``(source, size, hash)``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, passes)
    goals = to_scratch(goals, "mix-targets")
    cuts = thresholds(rows, goals)
    return to_scratch(_with(goals, cuts), "mix-plan")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, passes: int = MAX_PASSES,
) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size``, ``target`` and ``taken`` in words, and ``copies``."""
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")
    )
    rows = with_size_and_hash(narrow, "id", "text")
    rows = to_scratch(rows.select("id", "source", F.col("_m_size").alias("size"), F.col("_m_hash").alias("hash")), "mix-rows")
    found = plan(rows.select("source", "size", "hash"), weights, passes)
    copies = F.col("passes") + (F.col("hash") < F.col("limit")).cast("long")
    return _with(rows, found).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
    )


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, passes: int = MAX_PASSES,
) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, with all its columns."""
    whole = packed(docs, source=F.col(source_col))
    sized = with_size_and_hash(whole, field(docs, id_col), field(docs, text_col))
    rows = sized.select(
        "source", F.col("_m_size").alias("size"), F.col("_m_hash").alias("hash")
    )
    found = plan(to_scratch(rows, "mix-rows"), weights, passes)
    cuts = found.select(F.col("source").alias("_m_source"), F.col("passes").alias("_m_passes"), F.col("limit").alias("_m_limit"))
    copies = F.col("_m_passes") + (F.col("_m_hash") < F.col("_m_limit")).cast("long")
    joined = sized.join(cuts, F.col("source").eqNullSafe(F.col("_m_source")))
    # The filter is on what the generator puts out, so it stays above it and repeats no hashing below.
    each = joined.withColumn("_m_no", F.explode_outer(F.array_repeat(F.lit(1), copies.cast("int")))).where("_m_no = 1")
    return unpacked(each, docs)
