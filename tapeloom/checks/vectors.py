"""Vector search: exact, per group, filtered, for many queries, and indexed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import growing_index, ivf, nearest, quality
from ..operators.filters import Filters
from ..plans import chunk_search, corpus, evaluation, video_search
from ..plans.corpus import table, vector_row, with_ctes
from ..session import scratch_dir

DATES = ["2024-01-01T01:00:00.000Z", "2024-06-30T00:00:00.000Z"]


def _rows(spark, sf_dir):
    """The vector table under its own column names."""
    return table(spark, sf_dir, "embeddings")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def topk(spark, sf_dir):
    found = nearest.nearest(_rows(spark, sf_dir), vector_row(spark, sf_dir), 10, id_col="vec_id")
    return _rounded(found, "cos_sim")


TOPK = """SELECT vec_id, label, round(s, 6) AS cos_sim FROM (
  SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.qe), 12) AS s
  FROM embeddings e CROSS JOIN q ORDER BY s DESC, vec_id LIMIT {n})"""


def topk_wide(spark, sf_dir):
    found = nearest.nearest(_rows(spark, sf_dir), vector_row(spark, sf_dir), 300, id_col="vec_id")
    return _rounded(found, "cos_sim")


def inner_product(spark, sf_dir):
    found = nearest.nearest(
        _rows(spark, sf_dir), vector_row(spark, sf_dir), 10, id_col="vec_id", metric="inner_product"
    )
    return _rounded(found, "cos_sim")


def label_centers(spark, sf_dir):
    """Mean vector per label: the queries of the batch search."""
    parts = _rows(spark, sf_dir).select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pairs = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("label").agg(F.transform(pairs, lambda p: F.round(p["x"], 9)).alias("center"))


def topk_batch(spark, sf_dir):
    centers = label_centers(spark, sf_dir).select(F.col("label").alias("query_id"), F.col("center").alias("query_vector"))
    found = nearest.nearest_for_queries(_rows(spark, sf_dir), centers, 10, id_col="vec_id")
    return _rounded(found, "cos_sim")


TOPK_BATCH = """WITH parts AS (
  SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, round(avg(x), 9) AS x FROM parts GROUP BY label, pos),
centers AS (SELECT label, list(x ORDER BY pos) AS center FROM means GROUP BY label),
scored AS (
  SELECT c.label AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.center), 12) AS s
  FROM embeddings e CROSS JOIN centers c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rn FROM scored)
SELECT query_id, vec_id, round(s, 6) AS cos_sim, CAST(rn AS INT) AS rn FROM ranked WHERE rn <= 10"""


def per_group(spark, sf_dir):
    found = nearest.nearest_per_group(_rows(spark, sf_dir), vector_row(spark, sf_dir), "label", 5, id_col="vec_id")
    return _rounded(found, "cos_sim")


PER_GROUP = """SELECT vec_id, label, round(s, 6) AS cos_sim, CAST(rn AS INT) AS rn FROM (
  SELECT vec_id, label, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rn FROM (
    SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.qe), 12) AS s
    FROM embeddings e CROSS JOIN q)) WHERE rn <= 5"""


def per_url(spark, sf_dir):
    tables = corpus.search_tables(spark, sf_dir)
    restricted = corpus.age_restricted(spark, sf_dir)
    found = chunk_search.similar_chunks_for_urls(tables, vector_row(spark, sf_dir), restricted, 2)
    return _rounded(found, "cos_sim")


PER_URL = """SELECT id, url, start_segment, end_segment, segment_length, round(cos_sim, 6) AS cos_sim,
  segment_start, segment_end, text, CAST(rn AS INT) AS rn FROM (
  SELECT sc.*, ct.segment_start, ct.segment_end, ct.text,
    row_number() OVER (PARTITION BY sc.url ORDER BY cos_sim DESC, sc.id) AS rn
  FROM sc JOIN ct ON ct.url = sc.url AND ct.id = sc.id
  WHERE sc.url IN (SELECT video_url FROM ag)) WHERE rn <= 2"""


def filtered(spark, sf_dir):
    tables = corpus.search_tables(spark, sf_dir)
    filters = Filters(release_date=DATES, video_type=["album_review", "ep_review", "misc"], review_score=[5, None])
    found = chunk_search.similar_chunks_filtered(tables, vector_row(spark, sf_dir), 20, 400, filters)
    return _rounded(found, "cos_sim")


CONDITION = """publish_date BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-06-30 00:00:00'
  AND video_type IN ('album_review', 'ep_review', 'misc') AND review_score >= 5"""
FILTERED = f"""SELECT n.id, n.url, n.start_segment, n.end_segment, round(n.cos_sim, 6) AS cos_sim
FROM (SELECT * FROM sc ORDER BY cos_sim DESC, id LIMIT 400) n LEFT JOIN md ON md.url = n.url
WHERE {CONDITION} ORDER BY n.cos_sim DESC, n.id LIMIT 20"""


def filtered_first(spark, sf_dir):
    tables = corpus.search_tables(spark, sf_dir)
    filters = Filters(release_date=DATES, video_type=["album_review", "ep_review", "misc"], review_score=[5, None])
    found = chunk_search.similar_chunks_filtered(tables, vector_row(spark, sf_dir), 20, None, filters, include_text=True)
    return _rounded(found, "cos_sim")


FILTERED_FIRST = f"""SELECT f.id, f.url, f.start_segment, f.end_segment, round(f.cos_sim, 6) AS cos_sim,
  coalesce((SELECT string_agg(trim(tr.text), ' ' ORDER BY tr.segment_id) FROM tr
    WHERE tr.url = f.url AND tr.segment_id >= f.start_segment AND tr.segment_id < f.end_segment), '') AS text
FROM (SELECT sc.* FROM sc LEFT JOIN md ON md.url = sc.url
  WHERE {CONDITION} ORDER BY sc.cos_sim DESC, sc.id LIMIT 20) f"""


def group_rank(spark, sf_dir):
    """Groups by similarity to a query vector: the core of the video search."""
    chunks = nearest.nearest(_rows(spark, sf_dir), vector_row(spark, sf_dir), 200, id_col="vec_id")
    scored = video_search.group_scores(chunks, "label", 5, id_col="vec_id")
    best = video_search.best_groups(scored, "label", 2, 10)
    return best.select(
        "label",
        F.col("n_similar_chunks").alias("n"),
        F.round("median_similarity", 6).alias("med"),
        F.round("average_similarity", 6).alias("av"),
        F.round("weighted_z_score", 6).alias("score"),
        F.round("n_similar_chunks_z_score", 6).alias("n_z"),
        F.round("weighted_median_similarity", 6).alias("weighted_med"),
    )


GROUP_RANK = """WITH q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0),
c AS (SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.qe), 12) AS s
  FROM embeddings e CROSS JOIN q ORDER BY s DESC, vec_id LIMIT 200),
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rn FROM c),
a AS (SELECT label, median(s) AS med, avg(s) AS av, count(*) AS n, max(s) AS mx FROM t WHERE rn <= 5 GROUP BY label),
z AS (SELECT avg(mx) AS m, stddev_samp(mx) AS sd, avg(n) AS nm, stddev_samp(n) AS nsd FROM a)
SELECT label, n, round(med, 6) AS med, round(av, 6) AS av, round((mx - m) / nullif(sd, 0) * n, 6) AS score,
  round((n - nm) / nullif(nsd, 0), 6) AS n_z, round(med * n, 6) AS weighted_med
FROM a CROSS JOIN z WHERE n >= 2 ORDER BY (mx - m) / nullif(sd, 0) * n DESC NULLS LAST, label LIMIT 10"""


def _index(spark, sf_dir, cells):
    return ivf.build(
        corpus.embeddings(spark, sf_dir), scratch_dir(spark, "ivf"), cells, iterations=5
    )


def ivf_topk(spark, sf_dir):
    """An index whose centers are the labels' mean vectors, searched in its three closest cells."""
    centers = np.array([r["center"] for r in label_centers(spark, sf_dir).orderBy("label").collect()])
    path = scratch_dir(spark, "ivf")
    index = ivf.build(_rows(spark, sf_dir), path, len(centers), centers=centers)
    found = ivf.search(spark, index, vector_row(spark, sf_dir), 10, probes=3, id_col="vec_id")
    return _rounded(found.select("vec_id", "label", "cos_sim"), "cos_sim")


def _grown(spark, sf_dir):
    """An index under the labels' mean vectors, filled in four parts; a tenth of the ids is deleted."""
    rows, path = _rows(spark, sf_dir), scratch_dir(spark, "growing")
    centers = np.array([r["center"] for r in label_centers(spark, sf_dir).orderBy("label").collect()])
    part = F.col("vec_id") % 4
    index = growing_index.create(rows.where(part == 0), path, id_col="vec_id", centers=centers)
    for k in (1, 2, 3):
        index = growing_index.add(index, rows.where(part == k))
    return growing_index.delete(index, rows.where("vec_id % 10 = 1").select("vec_id"))


def grown_index_topk(spark, sf_dir):
    """The three closest cells after three additions and a deletion."""
    index = _grown(spark, sf_dir)
    found = ivf.search(spark, index, vector_row(spark, sf_dir), 10, probes=3, id_col="vec_id")
    return _rounded(found.select("vec_id", "label", "cos_sim"), "cos_sim")


def grown_index_all_cells(spark, sf_dir):
    """All cells, after those with many vectors were split."""
    index = growing_index.split(_grown(spark, sf_dir), spark, 40)
    found = ivf.search(spark, index, vector_row(spark, sf_dir), 10, probes=index.cells, id_col="vec_id")
    return _rounded(found.select("vec_id", "label", "cos_sim"), "cos_sim")


GROWN_ALL = """WITH q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], qe), 6) AS cos_sim FROM embeddings, q WHERE vec_id % 10 <> 1
ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], qe), 12) DESC, vec_id LIMIT 10"""

IVF_TOPK = """WITH q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0),
x AS (SELECT label, pos, round(avg(v::DOUBLE), 9) AS v FROM (
  SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos),
c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cell, list(v ORDER BY pos) AS center FROM x GROUP BY label),
p AS (SELECT cell FROM c, q ORDER BY round(list_cosine_similarity(center, qe), 12) DESC, cell LIMIT 3),
f AS (SELECT e.vec_id, e.label, e.embedding::DOUBLE[] AS v,
  arg_max(cell, list_cosine_similarity(e.embedding::DOUBLE[], center)) AS cell FROM embeddings e, c GROUP BY ALL)
SELECT vec_id, label, round(s, 6) AS cos_sim FROM (
  SELECT vec_id, label, round(list_cosine_similarity(v, qe), 12) AS s FROM f, q WHERE cell IN (SELECT cell FROM p)
  ORDER BY s DESC, vec_id LIMIT 10)"""


def ivf_all_cells(spark, sf_dir):
    """Probing every cell gives the exact result."""
    index = _index(spark, sf_dir, 8)
    found = ivf.search(spark, index, vector_row(spark, sf_dir), 10, probes=8)
    return _rounded(found.select("id", "url", "cos_sim"), "cos_sim")


def _quality(spark, sf_dir, lists, probes, screens):
    tables = corpus.search_tables(spark, sf_dir)
    name = F.concat(F.lit("label "), F.col("label").cast("string")).alias("query")
    queries = label_centers(spark, sf_dir).select(name, F.col("center").alias("vector"))
    return evaluation.sweep(
        tables, queries, scratch_dir(spark, "sweep"), lists=lists, probes=probes, screens=screens
    )


def ann_quality(spark, sf_dir):
    return _quality(spark, sf_dir, (2, 8), (1, 4), (100, 1000)).drop("query_time")


def ann_summary(spark, sf_dir):
    found = _quality(spark, sf_dir, (6,), (1, 4), (100,))
    means = quality.mean_by(found, "kendall_tau", ["configuration", "nearest_neighbors_to_screen"])
    spread = quality.five_numbers(found, "n_overlap", ["configuration"])
    return means.join(spread, "configuration")


CHECKS = {
    "vec_topk": (topk, with_ctes(TOPK.format(n=10), "q")),
    "vec_topk_wide": (topk_wide, with_ctes(TOPK.format(n=300), "q")),
    "vec_topk_inner_product": (
        inner_product,
        with_ctes(
            """SELECT vec_id, label, round(s, 6) AS cos_sim FROM (
  SELECT e.vec_id, e.label, round(list_inner_product(e.embedding::DOUBLE[], q.qe), 12) AS s
  FROM embeddings e CROSS JOIN q ORDER BY s DESC, vec_id LIMIT 10)""",
            "q",
        ),
    ),
    "vec_topk_batch": (topk_batch, TOPK_BATCH),
    "vec_topk_per_group": (per_group, with_ctes(PER_GROUP, "q")),
    "vec_topk_per_url_with_text": (per_url, with_ctes(PER_URL, "sc", "ct", "ag")),
    "vec_topk_filtered": (filtered, with_ctes(FILTERED, "sc", "md")),
    "vec_topk_filter_first": (filtered_first, with_ctes(FILTERED_FIRST, "sc", "md", "tr")),
    "neural_group_rank": (group_rank, GROUP_RANK),
    "ivf_topk": (ivf_topk, IVF_TOPK),
    "ivf_topk_all_cells": (
        ivf_all_cells,
        with_ctes("SELECT id, url, round(cos_sim, 6) AS cos_sim FROM sc ORDER BY sc.cos_sim DESC, id LIMIT 10", "sc"),
    ),
    "grown_index_topk": (grown_index_topk, IVF_TOPK.replace("WHERE cell IN", "WHERE vec_id % 10 <> 1 AND cell IN")),
    "grown_index_all_cells": (grown_index_all_cells, GROWN_ALL),
    "ann_quality": (ann_quality, None),
    "ann_summary": (ann_summary, None),
}
