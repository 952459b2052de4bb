"""Tables replaced in one step: a stop at any point leaves one whole version."""

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import snapshots


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "table")


def test_replace_read_append_drop(spark, root):
    assert not snapshots.exists(spark, root)
    with pytest.raises(ValueError, match="no table"):
        snapshots.current(spark, root).read(spark)
    first = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, name string")
    one = snapshots.replace(first, root)
    two = snapshots.append(spark.createDataFrame([("c", 3)], "name string, id bigint"), root)
    assert _rows(snapshots.current(spark, root).read(spark).where("id > 1").na.fill("-")) == [(2, "-"), (3, "c")]
    # The table may be replaced by a frame that reads it, also with other columns.
    three = snapshots.replace(snapshots.current(spark, root).read(spark).select((F.col("id") * 2).alias("twice")), root)
    assert _rows(snapshots.current(spark, root).read(spark)) == [(2,), (4,), (6,)]
    assert one.read(spark).count() == 2 and two.read(spark).count() == 3
    snapshots.drop(spark, root)
    assert not snapshots.exists(spark, root) and three.read(spark).count() == 3
    snapshots.replace(first.limit(0), root)
    assert snapshots.current(spark, root).read(spark).count() == 0
    assert [v.number for v in snapshots.history(spark, root)] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("stop", ["rows", "manifest"])
def test_a_stop_leaves_the_old_table_whole(spark, root, monkeypatch, stop):
    old = spark.range(10).toDF("id")
    snapshots.replace(old, root)
    if stop == "rows":
        broken = spark.range(100).select(F.when(F.col("id") < 50, F.col("id")).otherwise(F.raise_error(F.lit("stop"))).alias("id"))
        with pytest.raises(Exception, match="stop"):
            snapshots.replace(broken, root)
    else:

        def stopped(*_):
            raise RuntimeError("stop")

        with monkeypatch.context() as m:
            m.setattr(snapshots, "_publish", stopped)
            with pytest.raises(RuntimeError):
                snapshots.replace(spark.range(99).toDF("id"), root)
    assert _rows(snapshots.current(spark, root).read(spark)) == [(i,) for i in range(10)]
    snapshots.replace(spark.range(3).toDF("id"), root)
    assert _rows(snapshots.current(spark, root).read(spark)) == [(0,), (1,), (2,)]


def test_two_writers_of_one_number(spark, root):
    start = snapshots.replace(spark.range(1).toDF("id"), root)
    for folder, n in (("b" * 32, 5), ("a" * 32, 7)):
        spark.range(n).toDF("id").write.parquet(f"{root}/data/{folder}")
        snapshots._publish(spark, root, start, folder, start.layout, False)
    assert snapshots.current(spark, root).folder == "a" * 32
    assert snapshots.current(spark, root).read(spark).count() == 7


def test_sweep_keeps_the_last_versions(spark, root):
    versions = [snapshots.replace(spark.range(n).toDF("id"), root) for n in (1, 2, 3, 4)]
    assert snapshots.sweep(spark, root, keep=2) == 2
    assert [v.read(spark).count() for v in versions[2:]] == [3, 4]
    assert snapshots.current(spark, root).read(spark).count() == 4
