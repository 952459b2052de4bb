"""Video searches, fusion and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.filters import Filters
from ..plans import chunk_search, corpus, video_search
from ..plans.corpus import vector_row, with_ctes
from .keyword import PAIRS, TOKENS

QUERY = "de la"
SEPARATOR = " || "
TYPES = ["album_review", "misc", "ep_review", "track_review", "tnd_podcast", "yunoreview"]


def _flat(df, *scores):
    """Lists as text and scores rounded, so that both sides compare as values."""
    flat = df.withColumns({c: F.round(c, 6) for c in scores})
    changed = {"top_segment_chunks": F.array_join("top_segment_chunks", SEPARATOR)}
    if "cos_sim" in df.columns and dict(df.dtypes)["cos_sim"].startswith("array"):
        sims = F.transform("cos_sim", lambda x: F.round(x * 1_000_000, 0).cast("bigint").cast("string"))
        changed["cos_sim"] = F.array_join(sims, " ")
    return flat.withColumns({k: v for k, v in changed.items() if k in df.columns})


def neural_search_full(spark, sf_dir):
    found = video_search.neural_search(corpus.search_tables(spark, sf_dir), vector_row(spark, sf_dir))
    return _flat(found, "neural_search_score", "neural_search_score_z_score")


def neural_search_filtered(spark, sf_dir):
    filters = Filters(video_type=TYPES, review_score=[0, 10])
    found = video_search.neural_search(corpus.search_tables(spark, sf_dir), vector_row(spark, sf_dir), filters)
    return _flat(found, "neural_search_score", "neural_search_score_z_score")


def neural(condition: str, n_videos: int) -> dict[str, str]:
    """CTEs of the vector search; the last one is ``neural``."""
    return {
        "n_c": f"""SELECT s.* FROM (SELECT * FROM sc ORDER BY cos_sim DESC, id LIMIT 5000) s
  LEFT JOIN md ON md.url = s.url WHERE {condition} ORDER BY s.cos_sim DESC, s.id LIMIT 1500""",
        "n_t": "SELECT *, row_number() OVER (PARTITION BY url ORDER BY cos_sim DESC, id) AS nth FROM n_c",
        "n_a": "SELECT url, count(*) AS n, max(cos_sim) AS mx FROM n_t WHERE nth <= 5 GROUP BY url",
        "n_s": "SELECT avg(mx) AS m, stddev_samp(mx) AS sd FROM n_a",
        "n_w": f"""SELECT url, n, (mx - m) / nullif(sd, 0) * n AS score FROM n_a CROSS JOIN n_s WHERE n >= 2
  ORDER BY round((mx - m) / nullif(sd, 0) * n, 12) DESC NULLS LAST, url LIMIT {n_videos}""",
        "n_v": "SELECT md.*, w.n, w.score FROM n_w w JOIN md ON md.url = w.url",
        "n_z": "SELECT avg(score) AS m, stddev_samp(score) AS sd FROM n_v",
        "n_x": """SELECT c.url, c.nth, coalesce((SELECT string_agg(trim(tr.text), ' ' ORDER BY tr.segment_id) FROM tr
    WHERE tr.url = c.url AND tr.segment_id >= c.start_segment AND tr.segment_id < c.end_segment), '') AS text
  FROM n_t c WHERE c.nth <= 3 AND c.url IN (SELECT url FROM n_w)""",
        "n_l": f"SELECT url, string_agg(text, '{SEPARATOR}' ORDER BY nth) AS top_segment_chunks FROM n_x GROUP BY url",
        "neural": """SELECT v.*, l.top_segment_chunks, (v.score - z.m) / nullif(z.sd, 0) AS z,
    row_number() OVER (ORDER BY round(v.score, 12) DESC NULLS LAST, v.url) AS position
  FROM n_v v JOIN n_l l ON l.url = v.url CROSS JOIN n_z z""",
    }


NEURAL = """SELECT url, top_segment_chunks, id, title, description, publish_date, length, video_type, review_score,
  n AS n_segment_matches, round(score, 6) AS neural_search_score, round(z, 6) AS neural_search_score_z_score,
  CAST(position AS INT) AS position FROM neural"""


def keyword_search_full(spark, sf_dir):
    found = video_search.keyword_search(corpus.search_tables(spark, sf_dir), QUERY)
    return _flat(found, "keyword_search_score", "keyword_search_score_z_score")


def keyword_search_considered(spark, sf_dir):
    """Only the 40 best segments are considered, of videos that pass a filter."""
    filters = Filters(video_type=TYPES)
    found = video_search.keyword_search(corpus.search_tables(spark, sf_dir), QUERY, filters, 40)
    return _flat(found, "keyword_search_score", "keyword_search_score_z_score")


COUNT = f"len(list_filter({TOKENS}, lambda w: w = 'de' OR w = 'la'))"


def keyword(condition: str, n_videos: int, considered: str = "") -> dict[str, str]:
    """CTEs of the word search; the last one is ``keyword``."""
    return {
        "k_r": f"SELECT tr.*, {COUNT} AS n_words FROM tr",
        "k_h": f"""SELECT k_r.*, n_words * 0.1::DOUBLE AS rank FROM k_r LEFT JOIN md ON md.url = k_r.url
  WHERE n_words > 0 AND {condition} {considered}""",
        "k_g": "SELECT url, median(rank) AS m, count(*) AS n FROM k_h GROUP BY url",
        "k_s": "SELECT avg(m) AS mm, stddev_samp(m) AS sd FROM k_g",
        "k_w": f"""SELECT url, m AS score, n, (m - mm) / nullif(sd, 0) AS z FROM k_g CROSS JOIN k_s
  ORDER BY round(m, 12) DESC, url LIMIT {n_videos}""",
        "k_l": f"""SELECT url, string_agg(text, '{SEPARATOR}' ORDER BY nth) AS top_segment_chunks FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank DESC, segment_id) AS nth FROM k_h)
  WHERE nth <= 3 GROUP BY url""",
        # A single result scores 1 with a standard score of 0.5.
        "keyword": """SELECT md.*, w.n, l.top_segment_chunks,
    CASE WHEN count(*) OVER () = 1 THEN 1 ELSE w.score END AS score,
    CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE w.z END AS z,
    row_number() OVER (ORDER BY round(w.score, 12) DESC, w.url) AS position
  FROM k_w w JOIN md ON md.url = w.url JOIN k_l l ON l.url = w.url""",
    }


KEYWORD = """SELECT url, n AS n_segment_matches, round(score, 6) AS keyword_search_score,
  round(z, 6) AS keyword_search_score_z_score, id, title, description, publish_date, length, video_type, review_score,
  top_segment_chunks, CAST(position AS INT) AS position FROM keyword"""


def hybrid_chunks(spark, sf_dir):
    tables = corpus.search_tables(spark, sf_dir)
    urls = corpus.age_restricted(spark, sf_dir)
    found = chunk_search.hybrid_chunks_for_urls(tables, QUERY, urls, 5, vector=vector_row(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("cos_sim", "rank")}).withColumn(
        "fused_score", F.round("fused_score", 9)
    )


def hybrid(urls: str, n: int, w_neural: float, w_keyword: float) -> dict[str, str]:
    """CTEs of the fused chunks of ``urls``; the last one is ``hc``."""
    return {
        "h_n": f"""SELECT sc.url, sc.id, sc.cos_sim, ct.text, ct.segment_start, ct.segment_end,
    row_number() OVER (PARTITION BY sc.url ORDER BY cos_sim DESC, sc.id) AS rn
  FROM sc JOIN ct ON ct.url = sc.url AND ct.id = sc.id WHERE sc.url IN ({urls})""",
        "h_p": f"""SELECT ct.url, ct.id, ct.text, ct.segment_start, ct.segment_end, p.n,
    row_number() OVER (PARTITION BY ct.url, ct.id ORDER BY p.n DESC, p.segment_id) AS nth
  FROM (SELECT *, {PAIRS} AS n FROM (SELECT *, {TOKENS} AS w FROM tr)) p
  JOIN ct ON ct.url = p.url AND p.segment_id >= ct.start_segment AND p.segment_id < ct.end_segment
  WHERE p.n > 0 AND ct.url IN ({urls})""",
        "h_k": "SELECT *, row_number() OVER (PARTITION BY url ORDER BY n DESC, id) AS rn FROM h_p WHERE nth = 1",
        "h_f": f"""SELECT coalesce(a.url, b.url) AS url, coalesce(a.id, b.id) AS id, coalesce(a.text, b.text) AS text,
    a.cos_sim, b.n * 0.1::DOUBLE AS rank,
    coalesce(1.0::DOUBLE / (60 + a.rn), 0) AS ns, coalesce(1.0::DOUBLE / (60 + b.rn), 0) AS ks,
    round(coalesce(1.0::DOUBLE / (60 + a.rn), 0) * {w_neural}::DOUBLE
      + coalesce(1.0::DOUBLE / (60 + b.rn), 0) * {w_keyword}::DOUBLE, 15) AS fused_score,
    least(a.segment_start, b.segment_start) AS segment_start, greatest(a.segment_end, b.segment_end) AS segment_end
  FROM (SELECT * FROM h_n WHERE rn <= {2 * n}) a FULL JOIN (SELECT * FROM h_k WHERE rn <= {2 * n}) b
    ON a.url = b.url AND a.id = b.id""",
        "h_r": """SELECT *, dense_rank() OVER (PARTITION BY url ORDER BY fused_score DESC) AS rn,
    row_number() OVER (PARTITION BY url ORDER BY fused_score DESC, ks DESC, ns DESC, id) AS place FROM h_f""",
        "hc": f"SELECT * FROM h_r WHERE place <= {n}",
    }


HYBRID_CHUNKS = """SELECT url, id, text, round(cos_sim, 6) AS cos_sim, round(rank, 6) AS rank, segment_start, segment_end,
  round(fused_score, 9) AS fused_score, CAST(rn AS INT) AS rn, CAST(place AS INT) AS place FROM hc"""

LISTS = f"""SELECT url, string_agg(trim(text), '{SEPARATOR}' ORDER BY {{order}}) AS top_segment_chunks,
  string_agg(CAST(CAST(round(coalesce(cos_sim, 0) * 1000000) AS BIGINT) AS VARCHAR), ' ' ORDER BY {{order}}) AS cos_sim
FROM {{source}} GROUP BY url"""


def _rerank(method):
    def run(spark, sf_dir):
        tables = corpus.search_tables(spark, sf_dir)
        urls = corpus.age_restricted(spark, sf_dir)
        found = video_search.rerank_chunks_for_urls(tables, QUERY, urls, method, vector=vector_row(spark, sf_dir))
        return _flat(found)

    return run


RERANK_KEYWORD = f"""SELECT ct.url, ct.text, NULL::DOUBLE AS cos_sim,
  row_number() OVER (PARTITION BY ct.url ORDER BY p.n DESC, ct.id, p.segment_id) AS rn
  FROM (SELECT *, {PAIRS} AS n FROM (SELECT *, {TOKENS} AS w FROM tr)) p
  JOIN ct ON ct.url = p.url AND p.segment_id >= ct.start_segment AND p.segment_id < ct.end_segment
  WHERE p.n > 0 AND ct.url IN (SELECT video_url FROM ag)"""


def hybrid_search(spark, sf_dir):
    tables = corpus.search_tables(spark, sf_dir)
    request = video_search.SearchRequest(QUERY, 0.4, 0.6, vector=vector_row(spark, sf_dir))
    found = video_search.search(tables, request)
    return _flat(
        found, "neural_score", "neural_search_score_z_score", "keyword_score", "keyword_search_score_z_score",
        "fused_score", "avg_z_score",
    )


def hybrid_search_filtered(spark, sf_dir):
    tables = corpus.search_tables(spark, sf_dir)
    filters = Filters(video_type=TYPES, review_score=[0, 10])
    request = video_search.SearchRequest(QUERY, 0.4, 0.6, filters, vector_row(spark, sf_dir))
    found = video_search.search(tables, request)
    return _flat(
        found, "neural_score", "neural_search_score_z_score", "keyword_score", "keyword_search_score_z_score",
        "fused_score", "avg_z_score",
    )


def hybrid_without_words(spark, sf_dir):
    """A query of stop words has no keyword result, so the vector result stands."""
    tables = corpus.search_tables(spark, sf_dir)
    request = video_search.SearchRequest("like the", 0.4, 0.6, vector=vector_row(spark, sf_dir))
    found = video_search.search(tables, request)
    return _flat(found, "neural_search_score", "neural_search_score_z_score")


def search_dispatch_neural(spark, sf_dir):
    tables = corpus.search_tables(spark, sf_dir)
    request = video_search.SearchRequest(QUERY, 1, 0, vector=vector_row(spark, sf_dir))
    return _flat(video_search.search(tables, request), "neural_search_score", "neural_search_score_z_score")


def search_dispatch_keyword(spark, sf_dir):
    tables = corpus.search_tables(spark, sf_dir)
    request = video_search.SearchRequest(QUERY, 0, 1, vector=vector_row(spark, sf_dir))
    return _flat(video_search.search(tables, request), "keyword_search_score", "keyword_search_score_z_score")


_DETAILS = ["id", "title", "description", "publish_date", "length", "video_type", "review_score"]


def hybrid_videos(condition: str) -> dict[str, str]:
    shared = ", ".join(f"coalesce(n.{c}, k.{c}) AS {c}" for c in _DETAILS)
    return {
        **neural(condition, 5),
        **keyword(condition, 5),
        "f_j": f"""SELECT coalesce(n.url, k.url) AS url, {shared},
    coalesce(60.0::DOUBLE / (60 + n.position), 0) AS neural_score, coalesce(n.z, 0) AS nz,
    coalesce(60.0::DOUBLE / (60 + k.position), 0) AS keyword_score, coalesce(k.z, 0) AS kz
  FROM neural n FULL JOIN keyword k ON k.url = n.url""",
        "f_s": """SELECT *, neural_score * 0.4::DOUBLE + keyword_score * 0.6::DOUBLE AS fused_score,
    (nz * 0.4::DOUBLE + kz * 0.6::DOUBLE) / 1.0::DOUBLE AS avg_z_score FROM f_j""",
        "f_t": """SELECT *, row_number() OVER (
    ORDER BY round(fused_score, 12) DESC, round(avg_z_score, 12) DESC NULLS LAST, url) AS position FROM f_s""",
        "fused": "SELECT * FROM f_t WHERE position <= 10",
        **hybrid("SELECT url FROM fused", 3, 0.6, 1.0),
        "lists": LISTS.format(source="hc", order="place"),
    }


HYBRID = f"""SELECT fused.url, round(neural_score, 6) AS neural_score, round(nz, 6) AS neural_search_score_z_score,
  round(keyword_score, 6) AS keyword_score, round(kz, 6) AS keyword_search_score_z_score, {', '.join(_DETAILS)},
  round(fused_score, 6) AS fused_score, round(avg_z_score, 6) AS avg_z_score, CAST(position AS INT) AS position,
  top_segment_chunks, cos_sim FROM fused LEFT JOIN lists ON lists.url = fused.url"""

_TYPED = f"md.video_type IN ({', '.join(repr(t) for t in TYPES)})"
_FILTERED = f"{_TYPED} AND md.review_score BETWEEN 0 AND 10"
_BASE = ("sc", "md", "tr", "ct")

CHECKS = {
    "neural_search_full": (neural_search_full, with_ctes(NEURAL, *_BASE, **neural("true", 10))),
    "neural_search_filtered": (neural_search_filtered, with_ctes(NEURAL, *_BASE, **neural(_FILTERED, 10))),
    "keyword_search_full": (keyword_search_full, with_ctes(KEYWORD, *_BASE, **keyword("true", 5))),
    "keyword_search_considered": (
        keyword_search_considered,
        with_ctes(
            KEYWORD, *_BASE, **keyword(_TYPED, 5, "ORDER BY n_words DESC, k_r.url, k_r.segment_id LIMIT 40")
        ),
    ),
    "hybrid_chunks": (
        hybrid_chunks,
        with_ctes(HYBRID_CHUNKS, "sc", "ct", "tr", "ag", **hybrid("SELECT video_url FROM ag", 5, 0.8, 1.0)),
    ),
    "rerank_lists": (
        _rerank("hybrid"),
        with_ctes(
            LISTS.format(source="hc", order="place"),
            "sc", "ct", "tr", "ag", **hybrid("SELECT video_url FROM ag", 3, 0.6, 1.0),
        ),
    ),
    "rerank_lists_neural": (
        _rerank("neural"),
        with_ctes(
            LISTS.format(source="h_n WHERE rn <= 3", order="rn"),
            "sc", "ct", "tr", "ag", **hybrid("SELECT video_url FROM ag", 3, 0.6, 1.0),
        ),
    ),
    "rerank_lists_keyword": (
        _rerank("keyword"),
        with_ctes(LISTS.format(source=f"({RERANK_KEYWORD}) WHERE rn <= 3", order="rn"), "ct", "tr", "ag"),
    ),
    "hybrid_search": (hybrid_search, with_ctes(HYBRID, *_BASE, **hybrid_videos("true"))),
    "hybrid_search_filtered": (hybrid_search_filtered, with_ctes(HYBRID, *_BASE, **hybrid_videos(_FILTERED))),
    "hybrid_search_without_words": (hybrid_without_words, with_ctes(NEURAL, *_BASE, **neural("true", 5))),
    "search_dispatch_neural": (search_dispatch_neural, with_ctes(NEURAL, *_BASE, **neural("true", 10))),
    "search_dispatch_keyword": (search_dispatch_keyword, with_ctes(KEYWORD, *_BASE, **keyword("true", 5))),
}
