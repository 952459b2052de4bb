"""The logical tables, derived from general-purpose test tables.

Each table exists twice: as a frame, and as SQL in ``CTES`` for checking.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.strings import url_of
from ..operators import word_index
from ..operators.chunks import chunk_to_text
from ..session import scratch_dir
from ..sources.sinks import append_clustered
from .chunk_search import SearchTables
from .jobs import enrich, enrichments

# Titles given to the videos, by id modulo their number.
TITLES = [
    "Kanye West - Yeezus ALBUM REVIEW", "Jay-Z - 4:44 ALBUM REVIEW", "Best Album Review Ever",
    "Artist - Title EP REVIEW", "A Deep Review", "X - Y TRACK REVIEW", "X - Y MIXTAPE REVIEW",
    "Y U NO REVIEW: May", "BEST & WORST TRACKS: 1/1", "TND Podcast #12", "Vinyl Update", "Hello",
]
# Descriptions given to the videos, by id modulo their number.
DESCRIPTIONS = [
    "score: 7/10", "7/10", "x (7/10)", "a -7/10", "first 3/10 then 9/10", " 117/10", " 10/100", None, "none",
    "tie 8/10 end",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        url_of(F.col("conv_id").cast("string")).alias("url"),
        "text",
        turn.cast("int").alias("segment_id"),
        (turn * 1000).cast("int").alias("segment_seek"),
        (turn.cast("double") * 7.5).alias("segment_start"),
        (turn.cast("double") * 7.5 + 7.5).alias("segment_end"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "conversations").agg((F.max("conv_id") + 1).alias("n"))
    start = F.floor(F.col("vec_id") / F.col("n")).cast("int") % 3 * 3
    return (
        table(spark, sf_dir, "embeddings")
        .crossJoin(F.broadcast(videos))
        .select(
            F.col("vec_id").cast("string").alias("id"),
            url_of((F.col("vec_id") % F.col("n")).cast("string")).alias("url"),
            F.lit("segment_chunk").alias("embedding_type"),
            start.alias("start_segment"),
            (start + 3).alias("end_segment"),
            F.lit(3).alias("segment_length"),
            "embedding",
        )
    )


def warehouse_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pointer form: a blob address in place of the vector."""
    return embeddings(spark, sf_dir).select(
        "id",
        F.col("url").alias("video_url"),
        F.concat(F.lit("gs://vectors/"), "id", F.lit(".npy")).alias("gcs_uri"),
        "embedding_type",
        "start_segment",
        "end_segment",
        "segment_length",
    )


def pick(values: list[str | None], number) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def video_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("conv_id")
    videos = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    stamps = table(spark, sf_dir, "events").select(F.col("event_id").alias("conv_id"), "ts", "event_type")
    return videos.join(stamps, "conv_id").select(
        number.cast("string").alias("id"),
        url_of(number.cast("string")).alias("url"),
        pick(TITLES, number).alias("title"),
        pick(DESCRIPTIONS, number).alias("description"),
        F.col("ts").alias("publish_date"),
        (number * 37 % 1800).cast("int").alias("length"),
        "event_type",
    )


def served_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with type and score, as the searches use it."""
    return video_metadata(spark, sf_dir).drop("event_type").withColumns(enrichments())


def _marked(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return video_metadata(spark, sf_dir).where(F.col("event_type").isin(*kinds))


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos that have audio: those whose event is not a purchase."""
    return _marked(spark, sf_dir, "click", "error", "signup", "view").select(
        F.col("url").alias("video_url"),
        F.concat(F.lit("gs://audio/"), "id", F.lit(".mp3")).alias("audio_gcr_uri"),
        F.col("publish_date").alias("scrape_date"),
    )


def age_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted videos: those whose document is labelled toxic."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    return toxic.select(url_of(F.col("doc_id").cast("string")).alias("video_url")).distinct()


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched videos: those whose event is a click or a view."""
    return enrich(_marked(spark, sf_dir, "click", "view"))


def served(spark: SparkSession, sf_dir: str, with_null: bool = False) -> DataFrame:
    """Served videos: those whose event is a signup; with a null row if asked."""
    rows = _marked(spark, sf_dir, "signup").select("id", "url")
    if not with_null:
        return rows
    return rows.unionByName(rows.agg(F.lit(None).cast("string").alias("id")).withColumn("url", F.col("id")))


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_to_text(embeddings(spark, sf_dir), transcripts(spark, sf_dir))


_INDEXED: dict[tuple[str, str, bool], word_index.WordIndex] = {}
_STORED: dict[tuple[str, str], SearchTables] = {}


def search_tables(spark: SparkSession, sf_dir: str) -> SearchTables:
    """The serving tables as the daily jobs would leave them, read from storage.

    They are written once per application and data folder.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        root = scratch_dir(spark, "serving")
        made = {
            "embeddings": (embeddings(spark, sf_dir), ["url", "id"]),
            "transcripts": (transcripts(spark, sf_dir), ["url", "segment_id"]),
            "metadata": (served_metadata(spark, sf_dir), ["url"]),
            "chunk_text": (chunk_text(spark, sf_dir), ["url", "id"]),
        }
        for name, (df, by) in made.items():
            append_clustered(df, f"{root}/{name}", by)
        _STORED[key] = SearchTables(*[spark.read.parquet(f"{root}/{name}") for name in made])
    return _STORED[key]


def indexed_tables(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> SearchTables:
    """The serving tables with a stored word index, which was filled in two parts."""
    tables = search_tables(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, stemmed)
    if key not in _INDEXED:
        late = F.pmod(F.xxhash64("url"), F.lit(3)) == 0
        index = word_index.WordIndex(scratch_dir(spark, "word-index"), buckets=8, blocks=32, stemmed=stemmed)
        for half in (~late, late):
            index = word_index.add(index, tables.transcripts.where(half))
        _INDEXED[key] = index
    return replace(tables, postings=_INDEXED[key].opened(spark))


def vector_row(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The query vector of the checks: one row of the vector table."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


# ------------------------------------------------------------------- SQL twins

_WATCH = "'https://www.youtube.com/watch?v='"


def _sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_pick(values: list[str | None], number: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {_sql_text(v)}" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {arms} END"


def sql_video_type(title: str) -> str:
    return f"""CASE WHEN {title} IS NULL THEN NULL
      WHEN contains(lower({title}), 'album review') AND contains({title}, '-') THEN 'album_review'
      WHEN contains(lower({title}), 'ep review') THEN 'ep_review'
      WHEN contains(lower({title}), 'track review') THEN 'track_review'
      WHEN contains(lower({title}), 'mixtape review') THEN 'mixtape_review'
      WHEN contains(lower({title}), 'yunoreview') OR contains(lower({title}), 'y u no review') THEN 'yunoreview'
      WHEN contains(lower({title}), 'weekly track roundup')
        OR contains(lower({title}), 'best & worst tracks') THEN 'weekly_track_roundup'
      WHEN contains(lower({title}), 'tnd podcast #') THEN 'tnd_podcast'
      WHEN contains(lower({title}), 'vinyl update') THEN 'vinyl_update'
      ELSE 'misc' END"""


def sql_score(description: str) -> str:
    found = f"list_last(regexp_extract_all({description}, '[^0-9][0-9]{{1,2}}/10'))"
    return f"TRY_CAST(split_part({found}, '/', 1) AS INTEGER)"


CTES: dict[str, tuple[str, list[str]]] = {
    "tr": (
        f"""SELECT concat({_WATCH}, CAST(conv_id AS VARCHAR)) AS url, text, CAST(turn AS INT) AS segment_id,
  CAST(turn * 1000 AS INT) AS segment_seek, CAST(turn AS DOUBLE) * 7.5 AS segment_start,
  CAST(turn AS DOUBLE) * 7.5 + 7.5 AS segment_end FROM conversations""",
        [],
    ),
    "em": (
        f"""SELECT CAST(e.vec_id AS VARCHAR) AS id,
  concat({_WATCH}, CAST(e.vec_id % n.n AS VARCHAR)) AS url, 'segment_chunk' AS embedding_type,
  CAST(floor(e.vec_id / n.n) AS INT) % 3 * 3 AS start_segment,
  CAST(floor(e.vec_id / n.n) AS INT) % 3 * 3 + 3 AS end_segment, 3 AS segment_length,
  e.embedding::DOUBLE[] AS embedding
  FROM embeddings e CROSS JOIN (SELECT max(conv_id) + 1 AS n FROM conversations) n""",
        [],
    ),
    "wem": (
        """SELECT id, url AS video_url, concat('gs://vectors/', id, '.npy') AS gcs_uri, embedding_type,
  start_segment, end_segment, segment_length FROM em""",
        ["em"],
    ),
    "vm": (
        f"""SELECT CAST(c.conv_id AS VARCHAR) AS id, concat({_WATCH}, CAST(c.conv_id AS VARCHAR)) AS url,
  {sql_pick(TITLES, 'c.conv_id')} AS title, {sql_pick(DESCRIPTIONS, 'c.conv_id')} AS description,
  ev.ts AS publish_date, CAST(c.conv_id * 37 % 1800 AS INT) AS length, ev.event_type
  FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN events ev ON ev.event_id = c.conv_id""",
        [],
    ),
    "md": (
        f"""SELECT id, url, title, description, publish_date, length,
  {sql_video_type('title')} AS video_type, {sql_score('description')} AS review_score FROM vm""",
        ["vm"],
    ),
    "au": (
        """SELECT url AS video_url, concat('gs://audio/', id, '.mp3') AS audio_gcr_uri,
  publish_date AS scrape_date FROM vm WHERE event_type IN ('click', 'error', 'signup', 'view')""",
        ["vm"],
    ),
    "ag": (
        f"SELECT DISTINCT concat({_WATCH}, CAST(doc_id AS VARCHAR)) AS video_url FROM labels WHERE toxic = 1",
        [],
    ),
    "en": (
        f"""SELECT id, url, {sql_video_type('title')} AS video_type, {sql_score('description')} AS review_score
  FROM vm WHERE event_type IN ('click', 'view')""",
        ["vm"],
    ),
    "sv": ("SELECT id, url FROM vm WHERE event_type = 'signup'", ["vm"]),
    "svn": ("SELECT id, url FROM sv UNION ALL SELECT NULL, NULL", ["sv"]),
    "ct": (
        """SELECT em.id, em.url, em.start_segment, em.end_segment,
  coalesce(string_agg(tr.text, '' ORDER BY tr.segment_id), '') AS text,
  min(tr.segment_start) AS segment_start, max(tr.segment_end) AS segment_end
  FROM em LEFT JOIN tr ON tr.url = em.url AND tr.segment_id >= em.start_segment AND tr.segment_id < em.end_segment
  GROUP BY em.id, em.url, em.start_segment, em.end_segment""",
        ["em", "tr"],
    ),
    "q": ("SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0", []),
    "sc": (
        """SELECT em.id, em.url, em.start_segment, em.end_segment, em.segment_length, em.embedding_type,
  round(list_cosine_similarity(em.embedding, q.qe), 12) AS cos_sim FROM em CROSS JOIN q""",
        ["em", "q"],
    ),
}


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """``body`` preceded by the named tables and their own inputs, then ``extra``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][1]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({CTES[name][0]})" for name in ordered]
    parts += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body
