"""Keyed picks, unions, filters, statistics, and schema rules."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..operators import fusion, joins, quality, rows
from ..operators.filters import Filters
from ..plans import corpus, lookups
from ..plans.corpus import table, with_ctes
from ..schemas import check_rows
from ..sources.sinks import as_json


def latest_per_key(spark, sf_dir):
    found = rows.latest_per_key(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return found.select("user_id", "event_id", "event_type", "value")


def latest_by_max(spark, sf_dir):
    newest = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(newest).select("user_id", "e.*")


LATEST = """SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""


def most_recent_item(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.orderBy(F.col("ts").desc_nulls_last(), F.col("value").desc(), F.col("event_id")).limit(1).select("event_id")


def latest_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max("ts").cast("string").alias("latest"))


def dedupe_keep_first(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return rows.keep_first(events, ["user_id", "event_type"], [F.col("event_id")])


def dedupe_keep_last(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return rows.keep_first(events, ["user_id", "event_type"], [F.col("event_id").desc()])


def union_priority(spark, sf_dir):
    """Users of purchases first, then of all events; the first source wins."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return rows.union_first_wins(
        [events.where("event_type = 'purchase'"), events], ["user_id"], [F.col("event_id")]
    )


def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


def filter_ranges(spark, sf_dir):
    """Which combinations of open and closed filters let each video through."""
    videos = corpus.served_metadata(spark, sf_dir)
    low, high = "2024-01-01T01:00:00.000Z", "2024-01-01T06:00:00.000Z"
    cases = {
        "from": Filters(release_date=[low, None]),
        "until": Filters(release_date=[None, high]),
        "between": Filters(release_date=[low, high]),
        "open": Filters(release_date=[None, None], review_score=[None, None], video_type=[]),
        "types": Filters(video_type=["misc", "ep_review"]),
        "at_least": Filters(review_score=[8, None]),
        "at_most": Filters(review_score=[None, 8]),
        "scored": Filters(review_score=[0, 10]),
        "all": Filters(release_date=[low, high], video_type=["misc", "ep_review"], review_score=[0, 10]),
    }
    passed = [f.apply(videos).select(F.lit(name).alias("case"), "id") for name, f in cases.items()]
    whole = passed[0]
    for part in passed[1:]:
        whole = whole.unionByName(part)
    return whole


FILTER_RANGES = """SELECT 'from' AS "case", id FROM md WHERE publish_date >= lo UNION ALL
SELECT 'until', id FROM md WHERE publish_date <= hi UNION ALL
SELECT 'between', id FROM md WHERE publish_date BETWEEN lo AND hi UNION ALL
SELECT 'open', id FROM md UNION ALL
SELECT 'types', id FROM md WHERE video_type IN ('misc', 'ep_review') UNION ALL
SELECT 'at_least', id FROM md WHERE review_score >= 8 UNION ALL
SELECT 'at_most', id FROM md WHERE review_score <= 8 UNION ALL
SELECT 'scored', id FROM md WHERE review_score BETWEEN 0 AND 10 UNION ALL
SELECT 'all', id FROM md WHERE publish_date BETWEEN lo AND hi AND video_type IN ('misc', 'ep_review')
  AND review_score BETWEEN 0 AND 10""".replace("lo", "TIMESTAMP '2024-01-01 01:00:00'").replace(
    "hi", "TIMESTAMP '2024-01-01 06:00:00'"
)


def z_scores(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean_value"))
    return fusion.add_z_scores(counts, {"mean_value": "z"}).select("user_id", F.round("z", 6).alias("z"))


def group_statistics(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    grouped = events.groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("av"), F.count("value").alias("n"), F.max("value").alias("mx")
    )
    medians = quality.quantiles(events, "value", ["event_type"], {"med": 0.5})
    return grouped.join(medians.withColumn("med", F.round("med", 6)), "event_type")


def five_numbers(spark, sf_dir):
    found = quality.five_numbers(table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


def dense_ranks(spark, sf_dir):
    """Dense rank of every document's size within its source."""
    ranked = rows.dense_ranks(table(spark, sf_dir, "documents"), ["source"], "n_chars", "place")
    return ranked.select("doc_id", "source", "place")


def not_null_rejects(spark, sf_dir):
    """Events against a schema whose required number only some have."""
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType(), False),
            T.StructField("bonus", T.IntegerType(), False),
            T.StructField("note", T.StringType(), True),
        ]
    )
    events = table(spark, sf_dir, "events").withColumn(
        "bonus", F.when(F.col("event_type") == "error", "none").otherwise(F.col("user_id").cast("string"))
    )
    checked = check_rows(events, schema)
    return checked.withColumn("reject_reason", F.array_join("reject_reason", ","))


def transcripts_many(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return lookups.transcripts_of(corpus.transcripts(spark, sf_dir), wanted)


def metadata_many(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return lookups.metadata_of_many(corpus.served_metadata(spark, sf_dir), wanted)


def transcript_one(spark, sf_dir):
    return lookups.transcript_of(corpus.transcripts(spark, sf_dir), "7")


def metadata_one(spark, sf_dir):
    return lookups.metadata_of(corpus.served_metadata(spark, sf_dir), "7").drop("publish_date")


def table_inventory(spark, sf_dir):
    tables = {
        "embeddings": corpus.embeddings(spark, sf_dir),
        "transcriptions": corpus.transcripts(spark, sf_dir),
        "embeddings_to_text": corpus.chunk_text(spark, sf_dir),
        "video_metadata": corpus.served_metadata(spark, sf_dir),
    }
    return lookups.video_counts(tables)


def table_sizes(spark, sf_dir):
    """Inventory with the sizes of the stored files."""
    names = ["embeddings", "conversations", "documents", "events"]
    keys = {"embeddings": "vec_id", "conversations": "conv_id", "documents": "doc_id", "events": "user_id"}
    tables = {n: table(spark, sf_dir, n).select(F.col(keys[n]).alias("url")) for n in names}
    return lookups.table_inventory(tables, {n: f"{sf_dir}/{n}.parquet" for n in names})


def json_records(spark, sf_dir):
    return as_json(table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") > 10, F.col("user_id")).alias("big")))


def composite_key_join(spark, sf_dir):
    """Chunks joined to their text on url and id; labelled videos only."""
    chunks = corpus.embeddings(spark, sf_dir).select("url", "id", "segment_length")
    texts = corpus.chunk_text(spark, sf_dir).select("url", "id", F.length("text").alias("n"))
    return joins.present(chunks.join(texts, ["url", "id"]), corpus.age_restricted(spark, sf_dir), "url", "video_url")


def union_all_counts(spark, sf_dir):
    parts = [
        table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        for n in ("benchmark", "labels", "pages", "documents")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


CHECKS = {
    "latest_per_key": (latest_per_key, LATEST),
    "latest_per_key_by_max": (latest_by_max, LATEST),
    "most_recent_item": (
        most_recent_item,
        "SELECT event_id FROM events ORDER BY ts DESC NULLS LAST, value DESC, event_id LIMIT 1",
    ),
    "latest_timestamp": (latest_timestamp, "SELECT CAST(max(ts) AS VARCHAR) AS latest FROM events"),
    "dedupe_keep_first": (
        dedupe_keep_first,
        "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type",
    ),
    "dedupe_keep_last": (
        dedupe_keep_last,
        "SELECT max(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type",
    ),
    "union_priority": (
        union_priority,
        """SELECT event_id, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS rn FROM (
    SELECT event_id, user_id, event_type, 0 AS s FROM events WHERE event_type = 'purchase' UNION ALL
    SELECT event_id, user_id, event_type, 1 FROM events)) WHERE rn = 1""",
    ),
    "distinct_rows": (distinct_rows, "SELECT DISTINCT lang, source FROM documents"),
    "filter_ranges": (filter_ranges, with_ctes(FILTER_RANGES, "md")),
    "z_scores": (
        z_scores,
        """WITH m AS (SELECT user_id, avg(value) AS v FROM events GROUP BY user_id),
s AS (SELECT avg(v) AS a, stddev_samp(v) AS d FROM m)
SELECT user_id, round((v - a) / nullif(d, 0), 6) AS z FROM m CROSS JOIN s""",
    ),
    "group_statistics": (
        group_statistics,
        """SELECT event_type, round(median(value), 6) AS med, round(avg(value), 6) AS av, count(value) AS n,
  max(value) AS mx FROM events GROUP BY event_type""",
    ),
    "five_numbers": (
        five_numbers,
        """SELECT event_type, round(min(value), 6) AS lowest, round(quantile_cont(value, 0.25), 6) AS quartile_1,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS quartile_3,
  round(max(value), 6) AS highest FROM events GROUP BY event_type""",
    ),
    "dense_ranks": (
        dense_ranks,
        """SELECT doc_id, source,
  CAST(dense_rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS INT) AS place FROM documents""",
    ),
    "not_null_rejects": (
        not_null_rejects,
        """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(user_id AS INT) END AS bonus,
  CAST(NULL AS VARCHAR) AS note, CASE WHEN event_type = 'error' THEN 'bonus' ELSE '' END AS reject_reason FROM events""",
    ),
    "transcripts_many": (
        transcripts_many,
        with_ctes(
            """SELECT tr.*, list_last(string_split(url, '=')) AS video_id FROM tr
WHERE list_last(string_split(url, '=')) IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)""",
            "tr",
        ),
    ),
    "metadata_many": (
        metadata_many,
        with_ctes("SELECT * FROM md WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)", "md"),
    ),
    "transcript_one": (
        transcript_one,
        with_ctes("SELECT * FROM tr WHERE url = 'https://www.youtube.com/watch?v=7' ORDER BY segment_id", "tr"),
    ),
    "metadata_one": (
        metadata_one,
        with_ctes(
            """SELECT id, url, title, description, length, video_type, review_score
FROM md WHERE url = 'https://www.youtube.com/watch?v=7'""",
            "md",
        ),
    ),
    "table_inventory": (
        table_inventory,
        with_ctes(
            """SELECT 'embeddings' AS "table", count(DISTINCT url) AS video_count FROM em UNION ALL
SELECT 'transcriptions', count(DISTINCT url) FROM tr UNION ALL
SELECT 'embeddings_to_text', count(DISTINCT url) FROM ct UNION ALL
SELECT 'video_metadata', count(DISTINCT url) FROM md""",
            "em", "tr", "ct", "md",
        ),
    ),
    "table_sizes": (table_sizes, None),
    "json_records": (
        json_records,
        """SELECT CAST(to_json({'event_id': event_id, 'event_type': event_type,
  'big': CASE WHEN value > 10 THEN user_id END}) AS VARCHAR) AS record FROM events""",
    ),
    "composite_key_join": (
        composite_key_join,
        with_ctes(
            """SELECT em.url, em.id, em.segment_length, CAST(length(ct.text) AS INT) AS n
FROM em JOIN ct ON ct.url = em.url AND ct.id = em.id WHERE em.url IN (SELECT video_url FROM ag)""",
            "em", "ct", "ag",
        ),
    ),
    "union_all_counts": (
        union_all_counts,
        """SELECT 'benchmark' AS name, count(*) AS n FROM benchmark UNION ALL SELECT 'labels', count(*) FROM labels
UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'documents', count(*) FROM documents""",
    ),
}
