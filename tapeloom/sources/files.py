"""Blob listings, vector files, and archives of JSON documents."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.strings import file_name, file_stem, url_of
from ..schemas import SEGMENT, VIDEO_DETAILS


def list_objects(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Name, stem, path, size and time of every file; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(folder)
    path = F.col("path")
    return files.select(
        file_name(path).alias("name"), file_stem(path).alias("stem"), "path", "length", "modificationTime"
    )


def _numbers(content: bytes) -> np.ndarray | None:
    """The vector in the bytes of a ``.npy`` file; None when empty or unreadable."""
    try:
        data = np.load(io.BytesIO(content), allow_pickle=False)
    except Exception:  # a broken file must not end the job
        return None
    return None if data.shape == () else data.astype(np.float32).ravel()


def encode_npy(vector: Column) -> Column:
    """A vector as the bytes of a ``.npy`` file."""

    @F.arrow_udf(T.BinaryType())
    def run(vectors: pa.Array) -> pa.Array:
        out = []
        for item in vectors:
            buffer = io.BytesIO()
            np.save(buffer, np.asarray(item.as_py(), dtype=float))
            out.append(buffer.getvalue())
        return pa.array(out, type=pa.binary())

    return run(vector)


def decode_vector_files(files: DataFrame) -> DataFrame:
    """``id, embedding`` of rows with ``path`` and ``content``; bad files are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [_numbers(c) for c in batch.column(1).to_pylist()]
            good = [i for i, v in enumerate(vectors) if v is not None]
            found = pa.array([vectors[i] for i in good], type=pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), found], ["id", "embedding"])

    named = files.select(file_stem(F.col("path")).alias("id"), "content")
    return named.mapInArrow(run, "id string, embedding array<float>")


def read_vector_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    return decode_vector_files(files)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of an archive with one folder per video.

    ``video_id, document, value, created_at``, where ``document`` is the file's
    name.  Every file is one row.
    """
    files = spark.read.text(f"{folder}/*/*.json", wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(
        F.element_at(F.split(path, "/"), -2).alias("video_id"),
        file_name(path).alias("document"),
        "value",
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("created_at"),
    )


def archive_records(documents: DataFrame) -> DataFrame:
    """Videos that have both a transcription with segments and a details document.

    ``video_id, video_url, created_at, segments, details``.
    """
    body = T.StructType([T.StructField("segments", T.ArrayType(SEGMENT))])
    spoken = documents.where(F.col("document") == "transcription.json").select(
        "video_id", "created_at", F.from_json("value", body)["segments"].alias("segments")
    )
    described = documents.where(F.col("document") == "details.json").select(
        "video_id", F.from_json("value", VIDEO_DETAILS).alias("details")
    )
    return (
        spoken.where(F.size("segments") > 0)
        .join(described, "video_id")
        .select("video_id", url_of(F.col("video_id")).alias("video_url"), "created_at", "segments", "details")
    )
