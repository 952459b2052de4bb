"""Titles, descriptions, urls, and sizes of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings, text, titles
from ..plans import corpus, jobs
from ..plans.corpus import sql_score, sql_video_type, table, with_ctes


def enrich_titles(spark, sf_dir):
    videos = corpus.video_metadata(spark, sf_dir)
    return videos.select(
        "id",
        titles.video_type(F.col("title")).alias("video_type"),
        titles.is_album_review(F.col("title")).alias("is_review"),
    )


def extract_scores(spark, sf_dir):
    """Scores of the descriptions, and of every document with a score put behind it."""
    docs = table(spark, sf_dir, "documents")
    scored = F.concat(F.col("text"), F.lit(" rated "), F.pmod(F.col("n_chars"), F.lit(11)).cast("string"), F.lit("/10"))
    videos = corpus.video_metadata(spark, sf_dir)
    one = videos.select("id", titles.review_score(F.col("description")).alias("review_score"))
    two = docs.select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("id"), titles.review_score(scored).alias("review_score")
    )
    return one.unionByName(two)


def album_info(spark, sf_dir):
    videos = corpus.video_metadata(spark, sf_dir)
    return videos.select("id", titles.album_info(F.col("title")).alias("info")).select("id", "info.artist", "info.album_title")


def enrich_new_only(spark, sf_dir):
    return jobs.enrich_new(corpus.video_metadata(spark, sf_dir), corpus.enriched(spark, sf_dir))


def url_parts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    url = F.col("url")
    address = strings.blob_address(F.regexp_replace(url, "^http://", "gs://"))
    return pages.select(
        "page_id",
        strings.id_after_watch(url).alias("after_watch"),
        strings.id_after_equals(url).alias("after_equals"),
        strings.url_of(F.col("page_id").cast("string")).alias("watch_url"),
        address["bucket"].alias("bucket"),
        address["key"].alias("key"),
        strings.file_name(url).alias("name"),
        strings.file_stem(F.concat(F.lit("/vectors/"), F.col("page_id").cast("string"), F.lit(".part.npy"))).alias("stem"),
        strings.chunk_id(F.col("page_id").cast("string"), F.lit(0), F.lit(3)).alias("chunk"),
        strings.size_pretty(F.length("html") * F.lit(1000)).alias("size"),
    )


URL_PARTS = """SELECT page_id,
  list_last(string_split(url, 'watch?v=')) AS after_watch, list_last(string_split(url, '=')) AS after_equals,
  concat('https://www.youtube.com/watch?v=', page_id) AS watch_url,
  split_part(replace(url, 'http://', ''), '/', 1) AS bucket,
  substr(replace(url, 'http://', ''), length(split_part(replace(url, 'http://', ''), '/', 1)) + 2) AS "key",
  list_last(string_split(url, '/')) AS name, concat(page_id, '.part') AS stem, concat(page_id, '_0_3') AS chunk,
  CASE WHEN length(html) * 1000 < 10240 THEN concat(length(html) * 1000, ' bytes')
    WHEN length(html) * 1000 < 10485760 THEN concat(CAST(round(length(html) * 1000 / 1024.0) AS BIGINT), ' kB')
    ELSE concat(CAST(round(length(html) * 1000 / 1048576.0) AS BIGINT), ' MB') END AS size
FROM pages"""


def token_estimate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.preview(F.col("text")).alias("preview"))


def truncate_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cut = text.truncate_for_embedding(F.col("text"), 1000)
    return docs.select("doc_id", F.length(cut).alias("n"), F.md5(cut).alias("digest"))


TRUNCATE = """SELECT doc_id, CAST(length(t) AS INT) AS n, md5(t) AS digest FROM (
  SELECT doc_id, CASE WHEN ceil(length(text) / 3.5) > 1000 THEN concat(substr(text, 1, 3500), '...') ELSE text END AS t
  FROM documents)"""


CHECKS = {
    "enrich_titles": (
        enrich_titles,
        with_ctes(
            f"""SELECT id, {sql_video_type('title')} AS video_type,
  contains(lower(title), 'album review') AS is_review FROM vm""",
            "vm",
        ),
    ),
    "extract_scores": (
        extract_scores,
        with_ctes(
            f"""SELECT id, {sql_score('description')} AS review_score FROM vm UNION ALL
SELECT concat('doc ', doc_id), {sql_score("concat(text, ' rated ', n_chars % 11, '/10')")} FROM documents""",
            "vm",
        ),
    ),
    "album_info": (
        album_info,
        with_ctes(
            """SELECT id, CASE WHEN contains(h, '-') THEN trim(split_part(h, '-', 1)) END AS artist,
  CASE WHEN contains(h, '-') THEN trim(substr(h, instr(h, '-') + 1)) END AS album_title
FROM (SELECT id, split_part(lower(title), 'album review', 1) AS h FROM vm)""",
            "vm",
        ),
    ),
    "enrich_new_only": (
        enrich_new_only,
        with_ctes(
            f"""SELECT id, url, {sql_video_type('title')} AS video_type, {sql_score('description')} AS review_score
FROM vm WHERE NOT EXISTS (SELECT 1 FROM en WHERE en.url = vm.url)""",
            "vm",
            "en",
        ),
    ),
    "url_parts": (url_parts, URL_PARTS),
    "token_estimate": (
        token_estimate,
        """SELECT doc_id, CAST(ceil(length(text) / 3.5) AS INT) AS tokens,
  CASE WHEN length(text) > 50 THEN concat(left(text, 50), '...') ELSE text END AS preview FROM documents""",
    ),
    "truncate_text": (truncate_text, TRUNCATE),
}
