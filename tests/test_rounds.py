"""Completeness of the index, batches of queries, hot groups, and limits that mean none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import ivf, nearest, quality, rows
from tapeloom.session import fixed, scratch_dir, settled


def _vectors(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id bigint, embedding array<float>")


def test_zero_vectors_belong_to_results_by_inner_product(spark):
    rng = np.random.default_rng(1)
    df = _vectors(spark, [[0.0, 0.0], *[[float(-x), float(y)] for x, y in rng.random((40, 2))]])
    index = ivf.build(df, scratch_dir(spark, "zero"), 4, metric="inner_product")
    want = nearest.nearest(df, [1.0, 0.0], 3, metric="inner_product").collect()
    got = ivf.search(spark, index, [1.0, 0.0], 3, probes=4)
    assert [r.id for r in got.collect()] == [r.id for r in want] and want[0].id == 0


def test_an_index_refuses_mixed_lengths_and_wrong_centers(spark):
    with pytest.raises(ValueError, match="one length"):
        ivf.build(_vectors(spark, [[1.0, 0.0], [1.0, 0.0, 0.0]]), scratch_dir(spark, "mixed"), 1)
    with pytest.raises(ValueError, match="differ in length"):
        ivf.build(_vectors(spark, [[1.0, 0.0]]), scratch_dir(spark, "other"), 1, centers=np.eye(3))
    with pytest.raises(ValueError, match="too large"):
        ivf.train_centroids(_vectors(spark, [[1.0, 0.0]]), 1 << 28)


@pytest.mark.parametrize("query_bytes", [1 << 20, 0])
@pytest.mark.parametrize("scores_at_once", [1 << 22, 64])
def test_batches_skip_empty_queries_and_agree_in_any_tile(spark, monkeypatch, query_bytes, scores_at_once):
    monkeypatch.setattr(nearest, "SCORES_AT_ONCE", scores_at_once)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(120, 6)).round(1)
    df = _vectors(spark, [[float(x) for x in v] for v in vectors])
    queries = [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(vectors[:9])] + [("empty", []), ("null", None)]
    asked = spark.createDataFrame(queries, "query_id string, query_vector array<double>")
    found = nearest.nearest_for_queries(df, asked, 5, query_bytes=query_bytes).collect()
    assert {r.query_id for r in found} == {f"q{i}" for i in range(9)}
    for name, vector in queries[:9]:
        want = [r.id for r in nearest.nearest(df, vector, 5).collect()]
        assert [r.id for r in sorted(found, key=lambda r: r.rn) if r.query_id == name] == want


def test_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=3_000)
    data = [("hot", float(v)) for v in values] + [("one", 5.0), (None, 1.0), (None, 2.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    got = {r.k: r for r in quality.five_numbers(df, "v", ["k"]).collect()}
    want = np.quantile(values, [0, 0.25, 0.5, 0.75, 1])
    assert [got["hot"][c] for c in ("lowest", "quartile_1", "median", "quartile_3", "highest")] == pytest.approx(want)
    assert got["one"].median == 5.0 and got[None].median == 1.5 and "none" not in got


def test_dense_ranks_look_up_distinct_values(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("a", 1), ("a", None), (None, 7)], "k string, v int")
    got = sorted((str(r.k), str(r.v), r.place) for r in rows.dense_ranks(df, ["k"], "v", "place").collect())
    assert got == [("None", "7", 1), ("a", "1", 2), ("a", "3", 1), ("a", "3", 1), ("a", "None", 3)]


@pytest.mark.parametrize("bound", [10, 10**9])
def test_long_intermediate_lists_are_written(spark, bound):
    df = spark.range(7).select(F.col("id").cast("string").alias("url"))
    frame, keys = settled(df, bound, "url")
    assert frame.count() == 7
    assert isinstance(keys, list) == (fixed(df, bound, "url")[1] is not None)


def test_unit_vectors(spark):
    from tapeloom.functions.vectors import unit_vector

    df = _vectors(spark, [[3.0, 4.0], [0.0, 0.0], [], None, [2.0]])
    got = [r.u for r in df.select("id", unit_vector(F.col("embedding")).alias("u")).orderBy("id").collect()]
    assert got == [pytest.approx([0.6, 0.8]), None, None, None, [1.0]]
