"""Tables that are written, replaced and appended to, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.corpus import table
from ..session import scratch_dir
from ..sources import sinks, snapshots


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def snapshot_table(spark, sf_dir):
    """A table replaced by a frame that reads it, then appended to, after a drop in between."""
    root, orders = scratch_dir(spark, "snapshots"), _orders(spark, sf_dir)
    snapshots.replace(orders.limit(0), root)
    snapshots.drop(spark, root)
    snapshots.replace(orders.where("o_orderkey % 2 = 0"), root)
    snapshots.replace(snapshots.current(spark, root).read(spark).where("o_custkey % 3 <> 0"), root)
    snapshots.append(orders.where("o_orderkey % 2 = 1"), root)
    return snapshots.current(spark, root).read(spark)


def snapshot_pinned(spark, sf_dir):
    """A reader keeps its version while the table is replaced; rows per version."""
    root, orders = scratch_dir(spark, "snapshots"), _orders(spark, sf_dir)
    versions = [snapshots.replace(orders.where(f"o_orderkey % 4 < {n}"), root) for n in (1, 2, 4)]
    counts = [v.read(spark).agg(F.lit(v.number).alias("version"), F.count(F.lit(1)).alias("n_rows")) for v in versions]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def appended_parts(spark, sf_dir):
    """Two appends to a Parquet path, columns matched by name."""
    path, orders = f"{scratch_dir(spark, 'appended')}/orders", _orders(spark, sf_dir)
    sinks.append(orders.where("o_orderkey % 2 = 0"), path)
    sinks.append(orders.where("o_orderkey % 2 = 1").select("o_totalprice", "o_custkey", "o_orderkey"), path)
    return spark.read.parquet(path)


_ALL = "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders"

CHECKS = {
    "snapshot_table": (snapshot_table, f"{_ALL} WHERE o_orderkey % 2 = 1 OR o_custkey % 3 <> 0"),
    "snapshot_pinned": (
        snapshot_pinned,
        """SELECT v + 1 AS version, (SELECT count(*) FROM orders WHERE o_orderkey % 4 < n) AS n_rows
FROM (VALUES (0, 1), (1, 2), (2, 4)) AS t(v, n)""",
    ),
    "appended_parts": (appended_parts, _ALL),
}
