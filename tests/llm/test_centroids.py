"""Clustering in whole numbers with Ptolemaic bounds."""

import hashlib
import math

import numpy as np
import pytest

from tapeloom.llm import centroids

DIMS = 64


def _brute(rows, k=40, rounds=5):
    kept = [
        (key, [math.floor(256 * x) for x in v])
        for key, v in rows
        if v is not None and len(v) == DIMS and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda key: hashlib.sha256(f"2:{'' if key is None else key}".encode()).hexdigest()
    points = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        found = []
        for key, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in points]
            found.append((key, d.index(min(d)), min(d), v))
        return found

    for _ in range(rounds):
        groups = {}
        for _, c, _, v in assign():
            groups.setdefault(c, []).append(v)
        points = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else p for i, p in enumerate(points)]
    found = assign()
    sums = {}
    for _, c, d, _ in found:
        sums[c] = sums.get(c, 0) + d
    shas = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted((str(key), c, d, sums[c], sum(sums.values()), shas[c]) for key, c, d, _ in found)


def _got(frame):
    return sorted((str(r[0]), *r[1:]) for r in frame.collect())


def _frame(spark, rows, parts=3):
    schema = "vec_id bigint, embedding array<float>, label int, row int, id string, cluster int, v int, far string"
    return spark.createDataFrame([(k, v, 1, 2, "x", 3, 4, "y") for k, v in rows], schema).repartition(parts)


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, parts):
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(150).collect()
    rows = [(r.vec_id, r.embedding) for r in data]
    assert _got(centroids.cluster_digest(_frame(spark, rows, parts))) == _brute(rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    fine = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, DIMS)]) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, []), (102, [0.5] * 63), (103, [None] + [0.5] * 63), (104, [nan] + [0.5] * 63),
           (105, [0.5] * 63 + [-inf]), (106, [0.5] * 65)]
    ties = [(200 + i, [0.25] * DIMS) for i in range(30)] + [(5, fine[5][1])] * 3 + [(None, [0.0] * DIMS), (None, [-0.001] * DIMS)]
    rows = fine + bad + ties
    assert _got(centroids.cluster_digest(_frame(spark, rows))) == _brute(rows)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i % 3)] * DIMS) for i in range(7)]
    assert _got(centroids.cluster_digest(_frame(spark, rows))) == _brute(rows)
    assert centroids.cluster_digest(_frame(spark, [])).collect() == []
    assert centroids.cluster_digest(_frame(spark, [(1, None)])).collect() == []


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster_digest(_frame(spark, [(1, [3e5] * DIMS), (2, [0.0] * DIMS)]))


def test_bounds_hold_and_drop_far_centroids():
    """No bound is above the distance, and clear groups need few measured distances."""
    rng = np.random.default_rng(7)
    middles = rng.integers(-4000, 4000, (40, DIMS))
    v = middles[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, DIMS))
    pivots = centroids.pivots_of(middles)
    cached = centroids.to_pivots(v, pivots)
    bounds = centroids.Bounds(middles, pivots)
    full = centroids.squared(v[:, None, :], middles[None])
    assert (bounds.below(cached) <= np.sqrt(full)).all()
    label, best, measured = bounds.nearest(v, cached)
    assert (label == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert measured < 10 * len(v)


def test_rows_keep_their_columns(spark):
    rows = [(i, [float(i % 5)] * DIMS) for i in range(20)]
    found, points = centroids.cluster(_frame(spark, rows), k=5)
    assert len(points) == 5
    assert sorted(r["row"]["vec_id"] for r in found.collect()) == list(range(20))
    assert {r["row"]["far"] for r in found.collect()} == {"y"}
