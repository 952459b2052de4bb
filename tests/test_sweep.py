"""The sweep over index settings."""

from pyspark.sql import functions as F

from tapeloom import session
from tapeloom.checks import vectors
from tapeloom.plans import chunk_search, corpus, evaluation, video_search
from tapeloom.session import scratch_dir

SF = "/root/testdata/sf0.001"


def test_every_label_is_answered(spark):
    """Rankings of all label queries, each the same as the search for that query alone."""
    labels = {r.label for r in vectors.table(spark, SF, "embeddings").select("label").distinct().collect()}
    assert len(labels) > 2
    found = vectors.ann_quality(spark, SF).collect()
    assert {r.query for r in found} == {f"label {x}" for x in labels}
    tables = corpus.search_tables(spark, SF)
    centers = vectors.label_centers(spark, SF)
    queries = centers.select(F.col("label").cast("string").alias("query"), F.col("center").alias("vector"))
    near = evaluation.nearest_for_queries(tables.embeddings, queries, 50, query_id="query", query_vector="vector")
    got = {(r.query, r.rank): r.url for r in evaluation._rankings(tables, near, 2, 10).collect()}
    want = {}
    for row in queries.orderBy("query").limit(3).collect():
        single = chunk_search.similar_chunks_filtered(tables, row.vector, 50, None)
        urls = [r.url for r in video_search.neural_ranking(single).collect()]
        want |= {(row.query, i): u for i, u in enumerate(urls, 1)}
    assert want and {k: v for k, v in got.items() if k[0] in {q for q, _ in want}} == want


def test_batch_index_search_agrees_with_single_searches(spark):
    for metric in ("inner_product", "cosine"):
        rows = corpus.embeddings(spark, SF)
        index = evaluation.ivf.build(rows, scratch_dir(spark, "batch"), 6, metric=metric)
        centers = vectors.label_centers(spark, SF)
        queries = centers.select(F.col("label").cast("string").alias("query_id"), F.col("center").alias("query_vector"))
        found = evaluation.ivf.search_for_queries(spark, index, queries, 20, 2).collect()
        for row in queries.orderBy("query_id").limit(2).collect():
            alone = evaluation.ivf.search(spark, index, row.query_vector, 20, 2).collect()
            assert {r.id for r in alone} == {r.id for r in found if r.query_id == row.query_id}


def test_more_rows_than_the_driver_holds(spark, monkeypatch):
    """Candidates and rankings stay frames, so no bound for driver rows ends the sweep."""
    monkeypatch.setattr(session, "PIN_ROWS", 3)
    monkeypatch.setattr(session.pin, "__defaults__", (3,))
    queries = vectors.label_centers(spark, SF).select(
        F.col("label").cast("string").alias("query"), F.col("center").alias("vector")
    )
    found = evaluation.sweep(
        corpus.search_tables(spark, SF), queries, scratch_dir(spark, "sweep"), (2,), (1,), (50,), n_chunks=50
    )
    assert found.count() == queries.count()
