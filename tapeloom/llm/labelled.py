"""A bounded, repeatable sample of labelled texts for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TEXT_BYTES = 20_000  # longer texts are scored but not trained on
FOLDS = 5


def held_out(key: Column) -> Column:
    """Whether a row is set aside for testing: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text",
    text_bytes: int = TEXT_BYTES,
) -> tuple[list[str], list[int]]:
    """At most ``rows`` texts of each label value 0 and 1, none held out, none above ``text_bytes``.

    The ids with the smallest hashes are taken of those whose text is short enough, so
    reruns and layouts agree.  They are at most ``2 * rows`` longs, which is what is
    broadcast; the driver holds at most ``2 * rows * text_bytes`` bytes of text.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    usable = named.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= text_bytes)
    short = usable.join(texts.select("id"), "id", "left_semi")
    wanted = [short.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(rows) for v in (0, 1)]
    ids = wanted[0].unionByName(wanted[1])
    found = texts.join(F.broadcast(ids), "id").select("id", "text", "label").orderBy(F.xxhash64("id"), "id").limit(2 * rows)
    got = found.toArrow()
    return [t or "" for t in got["text"].to_pylist()], got["label"].to_pylist()
