"""Jobs that process newly landed files once per trigger.

The checkpoint remembers what was processed, so no anti join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import enrich


def landed(spark: SparkSession, folder: str, like: DataFrame, pattern: str | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, with the columns of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def enrich_stream(metadata: DataFrame) -> DataFrame:
    """Type and score of arriving metadata."""
    return enrich(metadata)


def first_arrivals(stream: DataFrame, keys: Sequence[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first arrival of each key.

    With ``time`` and ``delay`` a key is forgotten after the delay, which
    bounds the state; without them every key is kept.
    """
    if time is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that has landed, append it to ``path``, and stop."""
    query: StreamingQuery = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
