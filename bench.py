"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tapeloom.checks import all_checks  # noqa: E402
from tapeloom.operators import ivf, keyword  # noqa: E402
from tapeloom.plans import corpus  # noqa: E402
from tapeloom.session import build_session, scratch_dir  # noqa: E402

HEADLINES = """
vec_topk vec_topk_wide vec_topk_batch vec_topk_per_group vec_topk_filtered vec_topk_filter_first neural_group_rank
neural_search_full keyword_documents phrase_documents keyword_segments keyword_group_rank keyword_search_full
phrase_chunks_per_group hybrid_chunks hybrid_search tsquery_strings chunk_segments chunk_text
chunk_text_spaced segments_in_chunks embed_chunks extract_scores truncate_text enrich_new_only worklist_embed
delta_metadata delta_transcripts delta_embeddings not_in_no_null latest_per_key dedupe_keep_last union_priority
""".split()
RUNS = 2


def seconds(run) -> float:
    """Best of a few complete runs; every row is computed and none is kept."""
    times = []
    for _ in range(RUNS):
        started = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - started)
    return round(min(times), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    checks = all_checks()
    checks["vec_topk"][0](spark, sf_dir).collect()  # starts the Python workers
    timed = {name: seconds(lambda: checks[name][0](spark, sf_dir)) for name in HEADLINES}

    # Indexes are built once, outside the timed searches, and timed on their own.
    started = time.perf_counter()
    index = ivf.build(corpus.embeddings(spark, sf_dir), scratch_dir(spark, "bench"), 16, iterations=5)
    timed["ivf_build"] = round(time.perf_counter() - started, 3)
    vector = corpus.vector_row(spark, sf_dir)
    timed["ivf_search"] = seconds(lambda: ivf.search(spark, index, vector, 10, probes=4).select(F.col("id"), "cos_sim"))

    started = time.perf_counter()
    path = scratch_dir(spark, "bench")
    keyword.write_postings(keyword.postings(corpus.table(spark, sf_dir, "documents"), ["doc_id"]), path, 16)
    timed["postings_build"] = round(time.perf_counter() - started, 3)
    stored = spark.read.parquet(path)
    timed["postings_words"] = seconds(lambda: keyword.word_hits(stored, "rethen onat der", ["doc_id"], 16))
    timed["postings_phrase"] = seconds(lambda: keyword.phrase_hits(stored, "thanedble the anea", ["doc_id"], 16))

    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(timed.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": timed, "sf": scale}))


if __name__ == "__main__":
    main()
