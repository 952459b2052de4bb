"""A vector index through additions, deletions and splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import growing_index as growing, ivf, nearest

DIMS = 16


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    middles = rng.normal(0, 1, (12, DIMS))
    made = [(f"v{i}", (middles[i % 12] + rng.normal(0, 0.4, DIMS)).astype(np.float32).tolist()) for i in range(1200)]
    made += [("zero", [0.0] * DIMS), ("none", None)]
    return spark.createDataFrame(made, "id string, embedding array<float>").repartition(4).cache()


@pytest.fixture(scope="module")
def grown(spark, rows, tmp_path_factory):
    """Five additions in all, a deletion and splits."""
    part = F.pmod(F.xxhash64("id"), F.lit(5))
    first = rows.where(part == 0)
    centers = np.array([r.embedding for r in first.where(F.col("embedding").isNotNull() & (F.col("id") != "zero")).limit(4).collect()])
    versions = [growing.create(first, str(tmp_path_factory.mktemp("index") / "i"), centers=centers)]
    for k in (1, 2, 3, 4):
        versions.append(growing.add(versions[-1], rows.where(part == k)))
    versions.append(growing.delete(versions[-1], rows.where(part == 2).limit(30).select("id")))
    for _ in range(2):
        versions.append(growing.split(versions[-1], spark, 150))
    return versions


def _top(found):
    return [(r.id, round(r.cos_sim, 9)) for r in found.collect()]


def _queries(rows):
    return [r.embedding for r in rows.where("id IN ('v3', 'v40', 'v77', 'v500', 'v911')").collect()]


def test_all_probes_equal_a_full_search(spark, rows, grown):
    deleted = spark.read.parquet(f"{grown[-1].path}/deletes/*")
    left = rows.join(deleted, "id", "left_anti").cache()
    for query in _queries(rows):
        want = _top(nearest.nearest(left, query, 10))
        assert len(want) == 10
        for index in (grown[5], grown[-1], growing.latest(spark, grown[-1].path)):
            assert _top(ivf.search(spark, index, query, 10, index.cells)) == want
    assert grown[-1].vectors(spark).count() == left.count() == 1202 - 30


def test_versions_stay_readable(spark, rows, grown):
    assert grown[4].vectors(spark).count() == 1202
    assert growing.latest(spark, grown[0].path) == grown[-1]
    assert grown[-1].cells > grown[4].cells == 4


def test_recall_of_few_probes(spark, rows, grown):
    """After all changes a third of the cells finds nearly everything."""
    index, found, total = grown[-1], 0, 0
    live = index.vectors(spark)
    for query in _queries(rows):
        want = {i for i, _ in _top(nearest.nearest(live, query, 10))}
        got = {i for i, _ in _top(ivf.search(spark, index, query, 10, -(-index.cells // 3)))}
        found, total = found + len(want & got), total + 10
    assert found / total >= 0.9


def test_counts_and_sums_are_those_of_the_vectors(spark, grown):
    for index in (grown[4], grown[-1]):
        held = {r.cell: (r.n, r.total) for r in index._state(spark).collect()}
        units = {}
        for r in index.filed(spark).collect():
            v = np.array(r.embedding if r.embedding is not None else [0.0] * DIMS)
            units.setdefault(r.cell, []).append(v / np.linalg.norm(v) if v.any() else v)
        for cell, own in units.items():
            n, total = held[cell]
            assert n == len(own) and np.allclose(total, np.sum(own, axis=0), atol=1e-5)
    assert all(-1e-9 <= r.drift < 1.2 for r in growing.drift(grown[-1], spark).collect())


def test_full_cells_are_split_and_no_other_is_moved(spark, grown):
    before, after = ({r.cell: r.n for r in v._state(spark).where("cell >= 0").collect()} for v in grown[5:7])
    assert all(c in after for c, n in before.items() if n <= 150)
    assert not any(c in after for c, n in before.items() if n > 150)


def test_one_direction_cannot_be_split(spark, tmp_path):
    same = spark.createDataFrame([(f"s{i}", [1.0, 2.0]) for i in range(20)], "id string, embedding array<float>")
    index = growing.create(same, str(tmp_path / "i"), centers=np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert growing.split(index, spark, 5) == index


def test_an_unfinished_change_is_not_seen(spark, rows, tmp_path):
    few = rows.where("id < 'v2'")
    index = growing.create(few, str(tmp_path / "i"), centers=np.eye(3, DIMS))
    growing._write_part(index, few.withColumn("cell", F.lit(0)))  # the writer stopped before its version
    assert growing.latest(spark, index.path).vectors(spark).count() == few.count()


def test_a_search_reads_only_probed_cells(spark, rows, grown, plan_of):
    plan = plan_of(ivf.search(spark, grown[4], _queries(rows)[0], 5, 1))
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
