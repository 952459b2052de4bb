"""Numbering, top-k, joins, chunks and fusion, with one group holding a third of the rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import chunks, fusion, joins, nearest, quality, rows
from tapeloom.operators.filters import Filters
from tapeloom.session import local, pin


@pytest.fixture(scope="module")
def skewed(spark):
    pick = random.Random(3)
    data = [("hot" if i % 3 == 0 else (None if i % 29 == 0 else f"u{i % 40}"), float(pick.randint(0, 300)), i) for i in range(6000)]
    return spark.createDataFrame(data, "url string, at double, id int").repartition(8).cache()


def test_sliced_numbering_equals_plain_numbering(skewed):
    plain = rows.number_rows(skewed, ["url"], ["at", "id"], "pos")
    sliced = rows.number_rows(skewed, ["url"], ["at", "id"], "pos", hot_rows=150)
    assert sliced.count() == 6000
    assert sliced.exceptAll(plain).count() == 0


def test_sliced_numbering_spreads_the_hot_group(skewed, plan_of):
    plan = plan_of(rows.number_rows(skewed, ["url"], ["at", "id"], "pos", hot_rows=150))
    assert "_slice" in plan


def test_numbering_with_one_value_everywhere(spark):
    df = spark.createDataFrame([("a", 1.0, i) for i in range(50)] + [("a", None, 99)], "url string, at double, id int")
    got = {r.id: r.pos for r in rows.number_rows(df, ["url"], ["at", "id"], "pos", hot_rows=10).collect()}
    assert got[99] == 0 and sorted(got.values()) == list(range(51)) and got[0] == 1 and got[49] == 50


def test_wide_top_k_equals_sort(skewed):
    order = [F.col("at").desc(), F.col("id")]
    wanted = skewed.orderBy(*order).limit(700).collect()
    assert rows.top_k(skewed, order, 700).collect() == wanted


def test_top_per_group_limits_before_the_shuffle(skewed, plan_of):
    plan = plan_of(rows.top_per_group(skewed, ["url"], [F.col("at").desc(), F.col("id")], 2))
    assert plan.count("WindowGroupLimit") == 2


def test_before_known(spark):
    listed = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "url string, position int")
    known = spark.createDataFrame([("b",)], "url string")
    assert [r.url for r in rows.before_known(listed, known, "url", "position").collect()] == ["a"]
    assert rows.before_known(listed, known.where("url = 'z'"), "url", "position").count() == 3


def test_union_first_wins(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    two = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    got = rows.union_first_wins([one, two], ["k"], [F.col("v")]).collect()
    assert {(r.k, r.v) for r in got} == {("a", 1), ("b", 2), ("c", 4)}


def test_anti_joins_and_nulls(spark, plan_of):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    full = spark.createDataFrame([("a",)], "k string")
    null = spark.createDataFrame([("a",), (None,)], "k string")
    none = full.where("false")

    def keys(df):
        return sorted(str(r.k) for r in df.collect())

    assert keys(joins.absent(left, null, "k")) == ["None", "b"]
    assert "LeftAnti" in plan_of(joins.absent(left, null, "k"))
    for known in (full, null, none):
        known.createOrReplaceTempView("known_keys")
        left.createOrReplaceTempView("left_keys")
        wanted = keys(spark.sql("SELECT k FROM left_keys WHERE k NOT IN (SELECT k FROM known_keys)"))
        assert keys(joins.absent_null_aware(left, known, "k")) == wanted


def test_restrict(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "k string")
    assert joins.restrict(df, ["k1", "k2", "k2", None], "k").count() == 2
    assert joins.restrict(df, [], "k").count() == 0
    assert joins.restrict(df, [f"k{i}" for i in range(1500)] * 2, "k").count() == 1500
    assert joins.restrict(df, df.limit(5).union(df.limit(5)), "k").count() == 5


def test_work_lists_take_whole_groups(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("c", 4), ("d", 5)], "url string, n int")
    known = spark.createDataFrame([("d",)], "video_url string")
    for n, want in ((2, [1, 2, 3]), (9, [1, 2, 3, 4]), (None, [1, 2, 3, 4])):
        found = joins.for_first_absent(df, known, "url", "video_url", n)
        assert sorted(r.n for r in found.collect()) == want


def test_long_key_lists_give_the_same_rows(spark, monkeypatch):
    df = spark.range(200).selectExpr("concat('k', id) AS k")
    want = sorted(r.k for r in joins.restrict(df, joins.short_list(df.limit(50)), "k").collect())
    monkeypatch.setattr(joins, "LISTED_KEYS", 10)
    keys = joins.short_list(df.limit(50))
    assert not isinstance(keys, list)
    assert sorted(r.k for r in joins.restrict(df, keys, "k").collect()) == want


def test_interval_join_of_a_hot_url(spark):
    ranges = spark.createDataFrame([(f"c{i}", "hot", i * 3, i * 3 + 3) for i in range(200)] + [("e", "x", 5, 5)], "id string, url string, start_segment int, end_segment int")
    points = spark.createDataFrame([("hot", i) for i in range(0, 590)], "url string, segment_id int")
    got = joins.interval_join(ranges, points, "url", "segment_id")
    assert got.count() == 590
    left = joins.interval_join(ranges, points, "url", "segment_id", how="left")
    assert left.where("id = 'e'").count() == 1


def chunk_rows(spark, ids, sizes=(3,), hot=10**9):
    df = spark.createDataFrame([("https://www.youtube.com/watch?v=v", i, float(n), f" t{n} ") for n, i in enumerate(ids)], "url string, segment_id int, segment_start double, text string")
    return df, chunks.chunk_segments(df, sizes, hot).orderBy("segment_length", "start_segment").collect()


@pytest.mark.parametrize("hot", [10**9, 2])
def test_chunks_of_seven_segments(spark, hot):
    _, got = chunk_rows(spark, range(7), hot=hot)
    assert [(r.id, r.start_segment, r.end_segment) for r in got] == [("v_0_3", 0, 3), ("v_3_6", 3, 6), ("v_6_9", 6, 9)]
    assert got[0].text == "t0   t1   t2" and got[2].text == "t6"


def test_chunks_partition_segments(spark):
    _, got = chunk_rows(spark, range(10), sizes=(4, 8))
    for size in (4, 8):
        texts = [r.text.split() for r in got if r.segment_length == size]
        assert sum(texts, []) == [f"t{n}" for n in range(10)]


def test_chunk_text_with_gapped_ids(spark):
    df, got = chunk_rows(spark, [0, 1, 5, 6])
    df = df.withColumn("segment_end", F.col("segment_start") + 1)
    stored = spark.createDataFrame(got).select("id", F.col("video_url").alias("url"), "start_segment", "end_segment")
    texts = {r.id: (r.text, r.segment_start, r.segment_end) for r in chunks.chunk_to_text(stored, df).collect()}
    assert texts == {"v_0_3": (" t0  t1 ", 0.0, 2.0), "v_3_6": (" t2 ", 2.0, 3.0)}
    spaced = {r.id: r.text for r in chunks.with_spaced_text(stored, df.union(df)).collect()}
    assert spaced == {"v_0_3": "t0 t1", "v_3_6": "t2"}
    assert chunks.chunk_to_text(stored, df.where("false")).first().text == ""


def test_chunk_text_on_and_off_the_grid(spark, plan_of):
    df = spark.createDataFrame([(u, i, f"{u}{i} ", float(i), i + 1.0) for u in "ab" for i in range(40)], "url string, segment_id int, text string, segment_start double, segment_end double")
    regular = [(f"{u}{s}x{n}", u, s, s + n) for u in "abz" for n in (3, 4) for s in range(0, 44, n)]
    layout = "id string, url string, start_segment int, end_segment int"
    on_grid = spark.createDataFrame(regular, layout)
    off_grid = spark.createDataFrame(regular + [("odd", "a", 5, 8), ("none", "a", 7, 7)], layout)
    one, two = chunks.chunk_to_text(on_grid, df), chunks.chunk_to_text(off_grid, df)
    assert two.where("id NOT IN ('odd', 'none')").exceptAll(one).isEmpty() and one.count() == len(regular)
    assert {r.id: r.text for r in two.where("id IN ('odd', 'none')").collect()} == {"odd": "a5 a6 a7 ", "none": ""}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # One exchange per side of the join and none for the grouping.
        assert plan_of(chunks.chunk_to_text(on_grid, df)).count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_z_scores(spark):
    df = spark.range(5).select(F.col("id").cast("double").alias("x"))
    got = [r.z for r in fusion.add_z_scores(df, {"x": "z"}).orderBy("x").collect()]
    assert got == pytest.approx([-1.2649, -0.6325, 0, 0.6325, 1.2649], abs=1e-4)
    assert fusion.add_z_scores(df.limit(1), {"x": "z"}).first().z is None
    assert fusion.add_z_scores(df.select(F.lit(2.0).alias("x")), {"x": "z"}).first().z is None


def test_open_filters():
    assert not Filters(release_date=[None, None], review_score=[None, None], video_type=[]).active()
    assert Filters(review_score=[None, 3]).active()


@pytest.fixture(scope="module")
def vectors(spark):
    pick = random.Random(9)
    data = [(f"i{n:04d}", [pick.gauss(0, 1) for _ in range(6)]) for n in range(400)]
    data += [("zero", [0.0] * 6), ("null", None), ("short", [1.0])]
    # Equal vectors, in different partitions, must come in order of their id.
    data += [(f"twin{n}", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for n in range(9)]
    return spark.createDataFrame(data, "id string, embedding array<float>").repartition(7).cache()


def brute(rows_, query, n):
    def cos(v):
        return sum(a * b for a, b in zip(v, query)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in query))

    scored = [(round(cos(r.embedding), 9), r.id) for r in rows_ if r.embedding and len(r.embedding) == 6 and any(r.embedding)]
    return [i for _, i in sorted(scored, key=lambda s: (-s[0], s[1]))][:n]


def test_nearest_matches_brute_force(vectors):
    query = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    got = [r.id for r in nearest.nearest(vectors, query, 20).collect()]
    assert got == brute(vectors.collect(), query, 20) and got[:9] == [f"twin{n}" for n in range(9)]
    assert nearest.nearest(vectors, query, 1000).count() == 409


@pytest.mark.parametrize("limit", [10**9, 0])
def test_many_queries_match_brute_force(spark, vectors, limit, monkeypatch):
    monkeypatch.setattr(nearest, "GRID_QUERIES", 3)
    monkeypatch.setattr(nearest, "GRID_VECTORS", 100)
    pick = random.Random(1)
    asked = [(n, [pick.gauss(0, 1) for _ in range(6)]) for n in range(7)] + [(50, [1.0, 2.0]), (51, None)]
    queries = spark.createDataFrame(asked, "query_id int, query_vector array<double>")
    found = nearest.nearest_for_queries(vectors, queries, 4, query_bytes=limit).collect()
    everything = vectors.collect()
    for n, vector in asked[:7]:
        mine = [r.id for r in sorted(found, key=lambda r: r.rn) if r.query_id == n]
        assert mine == brute(everything, vector, 4)
    assert {r.query_id for r in found} == set(range(7))


def test_tau_and_overlap(spark):
    exact = [("q", u, i) for i, u in enumerate("abcdef", 1)]
    near = [("q", u, i, "s") for i, u in enumerate("bacdxe", 1)] + [("q", u, i, "t") for i, u in enumerate("xyz", 1)]
    got = quality.compare_rankings(
        spark.createDataFrame(exact, "query string, url string, rank int"),
        spark.createDataFrame(near, "query string, url string, rank int, setting string"),
        ["setting"],
    )
    rows_ = {r.setting: r for r in got.collect()}
    assert rows_["s"].n_overlap == 5 and rows_["s"].kendall_tau == pytest.approx(0.8)
    assert rows_["s"].p_value == pytest.approx(2 * (1 + 4) / 120)
    assert rows_["t"].n_overlap == 0 and rows_["t"].kendall_tau is None and rows_["t"].p_value is None


def test_pinned_rows_keep_their_types(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-01 05:00:00' AS a, timestamp'2024-01-01 05:00:00' AS b, array('x') AS c,"
        " CAST(NULL AS double) AS d, 1 AS e, named_struct('f', date'2024-01-01') AS g"
    )
    again = local(spark, pin(df))
    assert again.dtypes == df.dtypes and again.collect() == df.collect()
    with pytest.raises(ValueError):
        pin(spark.range(5), max_rows=4)
