"""Fixed table schemas, and splitting of rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()

# Column names, order and null rules of the persisted tables.
VIDEO_METADATA = _schema(
    ("id", _S, False), ("title", _S, False), ("length", _L, False), ("channel_id", _S, False),
    ("channel_name", _S, False), ("short_description", _S, True), ("description", _S, True),
    ("view_ct", _L, True), ("url", _S, False), ("small_thumbnail_url", _S, True),
    ("large_thumbnail_url", _S, True), ("publish_date", _TS, True), ("scrape_date", _TS, False),
)
SERVED_VIDEO_METADATA = T.StructType(
    VIDEO_METADATA.fields + _schema(("video_type", _S, True), ("review_score", _I, True)).fields
)
AUDIO = _schema(("video_url", _S, False), ("audio_gcr_uri", _S, False), ("scrape_date", _TS, False))
TRANSCRIPTIONS = _schema(
    ("url", _S, False), ("text", _S, False), ("language", _S, False), ("created_at", _TS, False),
    ("segment_type", _S, False), ("segment_id", _I, False), ("segment_seek", _I, False),
    ("segment_start", _D, False), ("segment_end", _D, False),
)
SERVED_TRANSCRIPTIONS = _schema(
    ("url", _S, False), ("text", _S, False), ("segment_id", _I, False), ("segment_seek", _I, False),
    ("segment_start", _D, False), ("segment_end", _D, False),
)
ENRICHED_VIDEO_METADATA = _schema(
    ("id", _S, False), ("url", _S, False), ("video_type", _S, True), ("review_score", _I, True)
)
EMBEDDINGS = _schema(
    ("id", _S, False), ("video_url", _S, True), ("gcs_uri", _S, True), ("embedding_type", _S, True),
    ("start_segment", _I, False), ("end_segment", _I, False), ("segment_length", _I, False),
)
SERVED_EMBEDDINGS = _schema(
    ("id", _S, False), ("url", _S, True), ("embedding_type", _S, True), ("start_segment", _I, False),
    ("end_segment", _I, False), ("segment_length", _I, False), ("embedding", T.ArrayType(T.FloatType()), True),
)
AGE_RESTRICTED = _schema(("video_url", _S, False))
EMBEDDINGS_TO_TEXT = _schema(
    ("id", _S, False), ("url", _S, True), ("start_segment", _I, False), ("end_segment", _I, False),
    ("text", _S, True), ("segment_start", _D, True), ("segment_end", _D, True),
)
SEGMENT = _schema(
    ("id", _I, True), ("seek", _I, True), ("start", _D, True), ("end", _D, True), ("text", _S, True)
)
TRANSCRIPTION_RESULT = _schema(
    ("url", _S, True), ("text", _S, True), ("language", _S, True), ("segments", T.ArrayType(SEGMENT), True)
)
VIDEO_DETAILS = _schema(
    ("videoId", _S, True), ("title", _S, True), ("lengthSeconds", _S, True), ("channelId", _S, True),
    ("author", _S, True), ("shortDescription", _S, True), ("viewCount", _S, True),
    ("thumbnail", _schema(("thumbnails", T.ArrayType(_schema(("url", _S, True))), True)), True),
)

# Tables that the daily jobs fill, by name.
WAREHOUSE_TABLES: dict[str, T.StructType] = {
    "video_metadata": VIDEO_METADATA,
    "audio": AUDIO,
    "transcriptions": TRANSCRIPTIONS,
    "enriched_video_metadata": ENRICHED_VIDEO_METADATA,
    "embeddings": EMBEDDINGS,
    "age_restricted": AGE_RESTRICTED,
}
# Tables that the search side reads.
SERVING_TABLES: dict[str, T.StructType] = {
    "video_metadata": SERVED_VIDEO_METADATA,
    "transcriptions": SERVED_TRANSCRIPTIONS,
    "embeddings": SERVED_EMBEDDINGS,
    "embeddings_to_text": EMBEDDINGS_TO_TEXT,
}


def table_schema(name: str, serving: bool = False) -> T.StructType:
    """The schema registered under ``name``; an unknown name is a KeyError."""
    return (SERVING_TABLES if serving else WAREHOUSE_TABLES)[name]


def check_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order, plus ``reject_reason``.

    Values are cast without raising.  ``reject_reason`` lists the required
    columns that are null or did not cast; it is empty for a good row.
    """
    missing = [f.name for f in schema if f.name not in df.columns]
    required = [f.name for f in schema if not f.nullable]
    absent = [name for name in missing if name in required]
    if absent:
        raise ValueError(f"required columns are missing: {absent}")
    cast = df.select(
        *[
            (F.lit(None) if f.name in missing else F.col(f.name)).try_cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
    reasons = F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in required])
    return cast.withColumn("reject_reason", F.array_compact(reasons))


def conform(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into rows that fit ``schema`` and rows that break a NOT NULL rule."""
    checked = check_rows(df, schema)
    good = checked.where(F.size("reject_reason") == 0).drop("reject_reason")
    return good, checked.where(F.size("reject_reason") > 0)
