"""The daily jobs as one stream: each batch writes all of its targets or none of them.

A batch of arriving documents goes to several targets.  Each target's rows of batch
``n`` lie in a folder of their own, ``<target>/batch=n``, which is written over as a whole,
and the batch counts once its mark is written, after all targets.  Readers see marked
batches only.  A batch that stopped halfway is run again by the stream under the same
number: what it had written is replaced, and nothing is counted twice.

What a batch may skip because it is known already is looked up in the batches before it,
by number, so a replay sees what the first try saw.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.embed import Embedder, HashedWords, embed
from ..operators.chunks import chunk_segments
from ..operators.joins import absent
from ..plans import jobs
from ..schemas import TRANSCRIPTIONS, VIDEO_METADATA
from ..session import to_scratch
from ..sources.documents import segments_from_results

# Rows of a target from the batch and from what earlier batches left in the targets.
Maker = Callable[[DataFrame, Callable[[str], DataFrame]], DataFrame]


@dataclass(frozen=True)
class Targets:
    """Where targets lie, their schemas, and how their rows come about, in order."""

    root: str
    schemas: Mapping[str, T.StructType]
    makers: Mapping[str, Maker]

    def committed(self, spark: SparkSession, before: int | None = None) -> list[int]:
        """Numbers of the batches that count."""
        try:
            marks = spark.read.schema("batch bigint").parquet(f"{self.root}/_marks/*")
        except AnalysisException:
            return []
        numbers = sorted(r[0] for r in marks.distinct().collect())
        return [n for n in numbers if before is None or n < before]

    def read(self, spark: SparkSession, name: str, before: int | None = None) -> DataFrame:
        """Rows of a target from all batches that count, or from those before a number."""
        batches = self.committed(spark, before)
        if not batches:
            return spark.createDataFrame([], self.schemas[name])
        return spark.read.schema(self.schemas[name]).parquet(*[f"{self.root}/{name}/batch={n}" for n in batches])

    def write_batch(self, batch: DataFrame, number: int) -> None:
        """All targets of one batch, then its mark.  For ``foreachBatch``."""
        spark = batch.sparkSession
        if number in self.committed(spark):
            return
        rows = to_scratch(batch, "batch")

        def earlier(name: str) -> DataFrame:
            return self.read(spark, name, number)

        for name, make in self.makers.items():
            names = self.schemas[name].fieldNames()
            make(rows, earlier).select(*names).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")
        mark = spark.createDataFrame([(number,)], "batch bigint").coalesce(1)
        mark.write.mode("overwrite").parquet(f"{self.root}/_marks/{number}")


def run_available(stream: DataFrame, targets: Targets, checkpoint: str) -> None:
    """Process everything that has landed, batch by batch, and stop."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: targets.write_batch(batch, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _once(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key of a batch."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def _nullable(schema: T.StructType, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in [*schema, *more]])


def metadata_targets(root: str, clock: datetime | None = None) -> Targets:
    """Raw details documents to ``metadata``, ``rejects`` and ``enriched``.

    A url counts once: its first document of the first batch that holds a good one.
    """

    def rows(raw: DataFrame, earlier) -> DataFrame:
        good, _ = jobs.metadata_rows(raw, clock)
        return absent(_once(good, "url", ["id", "title"]), earlier("metadata"), "url")

    def rejects(raw: DataFrame, earlier) -> DataFrame:
        return jobs.metadata_rows(raw, clock)[1]

    def enriched(raw: DataFrame, earlier) -> DataFrame:
        return jobs.enrich(rows(raw, earlier))

    reason = T.StructField("reject_reason", T.ArrayType(T.StringType()))
    kinds = T.StructType.fromDDL("id string, url string, video_type string, review_score int")
    schemas = {"metadata": _nullable(VIDEO_METADATA), "rejects": _nullable(VIDEO_METADATA, reason), "enriched": kinds}
    return Targets(root, schemas, {"metadata": rows, "rejects": rejects, "enriched": enriched})


CHUNKS = "id string, video_url string, embedding_type string, start_segment int, end_segment int, segment_length int, embedding array<float>"


def transcript_targets(
    root: str, embedder: Embedder = HashedWords(), sizes: Sequence[int] = (3,), clock: datetime | None = None
) -> Targets:
    """Transcription results to ``segments`` and, chunked and embedded, to ``chunks``.

    A url counts once: its first result of the first batch that holds one.
    """

    def segments(results: DataFrame, earlier) -> DataFrame:
        fresh = absent(_once(results, "url", ["language", "text"]), earlier("segments"), "url")
        return segments_from_results(fresh, clock).select(*TRANSCRIPTIONS.fieldNames())

    def chunks(results: DataFrame, earlier) -> DataFrame:
        made = chunk_segments(segments(results, earlier), sizes)
        return made.withColumn("embedding", embed(F.col("text"), embedder))

    schemas = {"segments": _nullable(TRANSCRIPTIONS), "chunks": T.StructType.fromDDL(CHUNKS)}
    return Targets(root, schemas, {"segments": segments, "chunks": chunks})
