"""A serving database filled from a warehouse, twice, and searched."""

from dataclasses import replace

from pyspark.sql import functions as F

from tapeloom.operators import keyword
from tapeloom.operators.chunks import chunk_to_text
from tapeloom.plans import chunk_search, corpus, jobs, update, video_search
from tapeloom.schemas import SERVING_TABLES, VIDEO_METADATA

SF = "/root/testdata/sf0.001"


def warehouse(spark):
    videos = corpus.video_metadata(spark, SF).drop("event_type")
    stamp = F.col("publish_date")
    full = videos.withColumns({"channel_id": F.lit("c"), "channel_name": F.lit("n"), "scrape_date": stamp})
    absent = [f for f in VIDEO_METADATA if f.name not in full.columns]
    full = full.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent})
    return {
        "video_metadata": full.select(*VIDEO_METADATA.fieldNames()),
        "enriched_video_metadata": jobs.enrich(videos),
        "transcriptions": corpus.transcripts(spark, SF),
        "embeddings": corpus.warehouse_embeddings(spark, SF),
    }


def test_update_loads_deltas_once(spark, tmp_path):
    vectors = corpus.embeddings(spark, SF).select("id", "embedding")
    few = update.UpdateSettings(max_videos=5)
    source = warehouse(spark)

    def counts():
        return {n: spark.table(f"served.{n}").count() for n in SERVING_TABLES}

    tables = update.update_serving(spark, source, vectors, "served", few)
    first = counts()
    assert tables.embeddings.select("url").distinct().count() == 5
    assert first["video_metadata"] == source["video_metadata"].count()
    assert first["transcriptions"] == source["transcriptions"].count()
    assert first["embeddings"] == first["embeddings_to_text"]

    rest = update.UpdateSettings(max_videos=1000, cells=3, index_folder=str(tmp_path))
    tables = update.update_serving(spark, source, vectors, "served", rest)
    second = counts()
    assert second["embeddings"] == vectors.count() == second["embeddings_to_text"]
    assert second["transcriptions"] == first["transcriptions"]
    update.update_serving(spark, source, vectors, "served", few)
    assert counts() == second

    vector = corpus.vector_row(spark, SF)
    indexed = chunk_search.similar_chunks_filtered(tables, vector, 5, 50).collect()
    exact = chunk_search.similar_chunks(tables, vector, 5).collect()
    assert [r.id for r in indexed] == [r.id for r in exact]
    assert video_search.hybrid_search(tables, "de la", vector=vector).count() > 0
    spark.sql("DROP DATABASE served CASCADE")


def test_update_keeps_words_and_texts(spark, tmp_path):
    """Stored words and chunk texts follow two updates and equal the plain ones."""
    vectors, source = corpus.embeddings(spark, SF).select("id", "embedding"), warehouse(spark)
    half = {**source, "transcriptions": source["transcriptions"].where("url < 'https://www.youtube.com/watch?v=2'")}
    settings = update.UpdateSettings(1000, words_folder=str(tmp_path / "words"), text_folder=str(tmp_path / "texts"))
    for warehouse_now in (half, source):
        tables = update.update_serving(spark, warehouse_now, vectors, "stored", settings)
    want = chunk_to_text(tables.embeddings, tables.transcripts)
    columns = ["id", "text", "segment_start", "segment_end"]
    assert sorted(map(tuple, tables.chunk_text.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    known = keyword.vocabulary(keyword.postings(tables.transcripts))
    plain = replace(tables, postings=None, vocabulary=known)
    found, scanned = (chunk_search.keyword_segments(t, "de la", 20).collect() for t in (tables, plain))
    assert found and found == scanned
    spark.sql("DROP DATABASE stored CASCADE")
