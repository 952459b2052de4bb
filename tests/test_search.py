"""Whole searches on a small fixture: invariants and edge cases."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import ivf
from tapeloom.operators.filters import Filters
from tapeloom.plans import chunk_search, corpus, video_search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    made = corpus.search_tables(spark, SF)
    return replace(
        made,
        embeddings=made.embeddings.cache(), transcripts=made.transcripts.cache(),
        metadata=made.metadata.cache(), chunk_text=made.chunk_text.cache(),
    )


@pytest.fixture(scope="module")
def vector(spark):
    return corpus.vector_row(spark, SF)


def test_probing_every_cell_is_exact(spark, tables, vector, tmp_path):
    index = ivf.build(tables.embeddings, str(tmp_path / "ivf"), 6, iterations=3)
    assert index.vectors(spark).count() == tables.embeddings.count()
    exact = [(r.id, r.cos_sim) for r in chunk_search.similar_chunks(tables, vector, 15).collect()]
    assert [(r.id, r.cos_sim) for r in ivf.search(spark, index, vector, 15, probes=6).collect()] == exact
    some = {r.id for r in ivf.search(spark, index, vector, 15, probes=2).collect()}
    assert 0 < len(some) <= 15
    indexed = replace(tables, index=index, probes=6)
    same = chunk_search.similar_chunks_filtered(indexed, vector, 15, 100)
    assert [(r.id, r.cos_sim) for r in same.collect()] == exact


def test_index_reads_only_probed_cells(spark, tables, vector, tmp_path, plan_of):
    index = ivf.build(tables.embeddings, str(tmp_path / "ivf"), 4, iterations=2)
    plan = plan_of(ivf.search(spark, index, vector, 5, probes=2))
    assert "PartitionFilters: [cell#" in plan and " IN (" in plan


def test_odd_vectors_are_filed_but_not_found(spark, tmp_path):
    rows = [(f"v{i}", [float(i + 1), 1.0]) for i in range(20)] + [("zero", [0.0, 0.0]), ("null", None)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    index = ivf.build(df, str(tmp_path / "ivf"), 3, iterations=2)
    assert index.vectors(spark).count() == 22
    assert index.vectors(spark).where(F.col("cell") == ivf.NO_CELL).count() == 2
    assert ivf.search(spark, index, [1.0, 1.0], 50, probes=3).count() == 20


def test_screened_and_exact_searches_agree_without_filters(tables, vector):
    a = chunk_search.similar_chunks_filtered(tables, vector, 12, 5000).collect()
    b = chunk_search.similar_chunks_filtered(tables, vector, 12, None).collect()
    assert a == b


def test_screening_may_return_fewer(tables, vector):
    filters = Filters(video_type=["album_review"])
    few = chunk_search.similar_chunks_filtered(tables, vector, 50, 20, filters).count()
    all_of_them = chunk_search.similar_chunks_filtered(tables, vector, 50, None, filters).count()
    assert few < all_of_them == 50


def test_vectors_are_scored_once_and_dropped(tables, vector, plan_of):
    found = chunk_search.similar_chunks_filtered(tables, vector, 10, None, Filters(review_score=[5, None]))
    lines = plan_of(found).splitlines()
    scoring = [i for i, line in enumerate(lines) if "ArrowEvalPython" in line]
    assert len(scoring) == 1 and "Project" in lines[scoring[0] - 1] and "embedding#" not in lines[scoring[0] - 1]


def test_one_keyword_result_scores_one(spark, tables):
    rare = spark.createDataFrame([("https://www.youtube.com/watch?v=3", "zanzibar", 0, 0, 0.0, 1.0)], tables.transcripts.schema)
    got = video_search.keyword_search(replace(tables, transcripts=tables.transcripts.union(rare)), "Zanzibar").collect()
    assert [(r.keyword_search_score, r.keyword_search_score_z_score) for r in got] == [(1.0, 0.5)]
    assert got[0].top_segment_chunks == ["zanzibar"]


def test_no_keyword_result(tables, vector):
    assert video_search.keyword_search(tables, "qqqqqq").count() == 0
    hybrid = video_search.hybrid_search(tables, "qqqqqq", vector=vector).collect()
    neural = video_search.neural_search(tables, vector, n_videos=5).collect()
    assert hybrid == neural


def test_no_result_at_all(tables, vector):
    nothing = Filters(video_type=["no such type"])
    assert video_search.neural_search(tables, vector, nothing).count() == 0
    assert video_search.hybrid_search(tables, "de la", nothing, vector=vector).count() == 0


def test_fusion_is_symmetric(spark):
    left = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "url string, position int, neural_search_score_z_score double")
    right = spark.createDataFrame([("b", 1, 0.1), ("c", 2, 0.2)], "url string, position int, keyword_search_score_z_score double")
    one = video_search.fuse_videos(left, right, 1, 1, 10).collect()
    names = ["url", "position", "neural_search_score_z_score"], ["url", "position", "keyword_search_score_z_score"]
    two = video_search.fuse_videos(right.toDF(*names[0]), left.toDF(*names[1]), 1, 1, 10).collect()
    assert {r.url: round(r.fused_score, 12) for r in one} == {r.url: round(r.fused_score, 12) for r in two}
    assert one[0].url == "b" and one[0].fused_score == pytest.approx(60 / 62 + 60 / 61)


def test_text_queries_use_the_embedder(tables):
    class Fixed:
        def __call__(self, texts):
            import numpy as np

            return np.ones((len(texts), 64))

    found = chunk_search.similar_chunks(replace(tables, embedder=Fixed()), "anything", 3).collect()
    same = chunk_search.similar_chunks(tables, [1.0] * 64, 3).collect()
    assert found == same


def test_rerank_methods(tables, vector):
    urls = [r.url for r in tables.metadata.limit(4).collect()]
    for method in ("neural", "hybrid", "keyword"):
        got = video_search.rerank_chunks_for_urls(tables, "de la", urls, method, vector=vector).collect()
        assert all(len(r.top_segment_chunks) == len(r.cos_sim) <= 3 for r in got)
    with pytest.raises(ValueError):
        video_search.rerank_chunks_for_urls(tables, "de la", urls, "other")


def test_keyword_limit_and_titles(tables):
    every = chunk_search.keyword_segments(tables, "de la der", None).collect()
    ten = chunk_search.keyword_segments(tables, "de la der", 10, include_text=True).collect()
    assert len(ten) == 10 < len(every)
    assert [(r.url, r.id) for r in ten] == [(r.url, r.id) for r in every[:10]]
    assert all(r.title for r in ten) and "text" in ten[0].asDict()


def test_long_lists_are_written_instead_of_held(tables, vector, monkeypatch):
    def results():
        return [
            video_search.neural_search(tables, vector).collect(),
            video_search.keyword_search(tables, "de la der", n_results_to_consider=20).collect(),
            chunk_search.keyword_segments(tables, "de la der", 12, include_text=True).collect(),
            chunk_search.similar_chunks_filtered(tables, vector, 12, 100, Filters(review_score=[5, None]), True).collect(),
        ]

    held = results()
    for module in ("tapeloom.session", "tapeloom.plans.chunk_search"):
        monkeypatch.setattr(f"{module}.PIN_ROWS", 11)
    assert results() == held
