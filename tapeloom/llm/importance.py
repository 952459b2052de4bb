"""Resampling towards a target distribution, by hashed word features and importance weights.

1. A feature is a run of one or two words; its bucket is the CRC-32 of its bytes.
   All features of a batch are hashed together.  CRC-32 is linear: a byte at a given
   distance from the end of its feature contributes a constant that a table holds, so
   a feature's checksum is the XOR of its bytes' table entries, taken by
   ``bitwise_xor.reduceat`` over the feature's span, and of a constant for its length.
   Features longer than the table are cut into blocks of its size, whose checksums
   are folded from left to right by shifting over a block of zero bytes.
2. Each task adds up its features by bucket; the sums over all documents and over
   the target texts give one gain per bucket.  These ``buckets`` numbers are all that
   comes to the driver and goes to the tasks of the second scan.
3. A document's weight is the mean gain of its features, its score the weight plus
   Gumbel noise that its id decides.  The highest scores are drawn: rows are dealt out
   by ranges of the order and numbered range by range.

Defined results: a null text has no words and no features; a document without
features has weight 0.  A null id is hashed as an empty one and comes last among
ties; rows that agree in score and id are drawn in any order.  Repeated rows are rows
of their own.  Empty tables of documents or of targets count as no features.  Rows
travel inside one struct, so names of other columns do not matter.  A text is read in
parts of ``PART`` bytes, so memory follows the longest word and not the longest text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import to_scratch
from .common import arrow, empty_as_bytes, slices

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
RUN = 2  # words in a feature, at most
REACH = 64  # distances from the end that the table holds
GROUP = 1 << 20  # bytes of text that are hashed together
PART = 1 << 22  # bytes of a text that are read at once


def _byte_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(0xEDB88320), values >> 1).astype(np.uint32)
    return values


BYTE = _byte_table()


def _past_zero(values: np.ndarray) -> np.ndarray:
    """The checksum register after one more zero byte."""
    return (values >> np.uint32(8)) ^ BYTE[values & np.uint32(255)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte contributes at each distance from the end, and what each register byte becomes past a block."""
    places = [BYTE]
    for _ in range(REACH - 1):
        places.append(_past_zero(places[-1]))
    shifted = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(REACH):
        shifted = _past_zero(shifted)
    return np.concatenate(places), shifted


PLACE, SHIFT = _tables()
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])  # after lower-casing
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")


def _past_block(values: np.ndarray) -> np.ndarray:
    return SHIFT[0][values & 255] ^ SHIFT[1][values >> 8 & 255] ^ SHIFT[2][values >> 16 & 255] ^ SHIFT[3][values >> 24]


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``data``; spans are in order, disjoint and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    lengths = ends - starts
    base = int(starts[0])
    back = np.repeat(ends - 1, np.diff(starts, append=len(data)))
    back -= np.arange(base, len(data), dtype=back.dtype)
    parts = PLACE[((back & (REACH - 1)) << 8) | data[base:]]
    parts[back < 0] = 0  # bytes between spans
    blocks = -(-lengths // REACH)
    longest = int(blocks.max())
    if longest == 1:
        sums = np.bitwise_xor.reduceat(parts, starts - base)
    else:
        first = np.cumsum(blocks) - blocks
        number = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        cuts = np.repeat(ends, blocks) - (np.repeat(blocks, blocks) - number) * REACH
        linear = np.bitwise_xor.reduceat(parts, np.maximum(cuts, np.repeat(starts, blocks)) - base)
        sums = linear[first]
        for k in range(1, longest):
            more = np.flatnonzero(blocks > k)
            sums[more] = _past_block(sums[more]) ^ linear[first[more] + k]
    kinds, at = np.unique(lengths, return_inverse=True)
    return sums ^ np.array([zlib.crc32(bytes(int(n))) for n in kinds], np.uint32)[at]


def _parts(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """Lower-cased parts of a text that end between words, and whether a part begins with the last word before it."""
    text, low, read, carried = text.translate(LOWER), 0, 0, False
    while True:
        after = BETWEEN.search(text, read + PART)
        high = after.start() if after else len(text)
        yield text[low:high], carried
        if high == len(text):
            return
        begin, _ = word_spans(np.frombuffer(text, np.uint8, high - low, low))
        carried = len(begin) > 0
        low, read = low + int(begin[-1]) if carried else high, high


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    edges = np.flatnonzero(np.diff(IN_WORD[data], prepend=False, append=False))
    return edges[0::2], edges[1::2]


def features(texts: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(words in the feature, text numbers, buckets)`` of all features of the texts."""
    group, size = [], 0
    for number, text in enumerate(texts):
        for part, carried in _parts(text):
            group.append((number, part, carried))
            size += len(part)
            if size >= GROUP:
                yield from _group_features(group, buckets)
                group, size = [], 0
    yield from _group_features(group, buckets)


def _group_features(group: list[tuple[int, bytes, bool]], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    raw = np.frombuffer(b" ".join(part for _, part, _ in group), np.uint8)
    begin, end = word_spans(raw)
    if not len(begin):
        return
    limits = np.cumsum([len(part) + 1 for _, part, _ in group])
    owner = np.searchsorted(limits, begin, "right")
    # Words one blank apart, whatever stood between them.
    kept = IN_WORD[raw]
    kept[end[end < len(raw)]] = True
    data = np.where(IN_WORD[raw], raw, 32)[kept].astype(np.uint8)
    lengths = end - begin
    starts = (np.cumsum(lengths + 1) - lengths - 1).astype(np.int64)
    ends = starts + lengths
    numbers = np.array([number for number, _, _ in group])[owner]
    repeated = np.array([carried for _, _, carried in group])[owner] & (np.diff(owner, prepend=-1) > 0)
    for words in range(1, RUN + 1):
        # Runs that begin a multiple of their length apart do not overlap.
        for offset in range(words):
            first = np.arange(offset, len(starts) - words + 1, words)
            last = first + words - 1
            fits = owner[first] == owner[last]
            if words == 1:
                fits &= ~repeated[first]
            first, last = first[fits], last[fits]
            crc = checksums(data, starts[first], ends[last])
            yield words, numbers[first], (crc % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def task(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for _, _, found in features(empty_as_bytes(batch.column(0)), buckets):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield {"bucket": used, "n": total[used]}

    sums = arrow(docs.select(text_col), task, StructType.fromDDL("bucket bigint, n bigint")).groupBy("bucket")
    total = np.zeros(buckets, np.int64)
    for bucket, n in sums.agg(F.sum("n")).collect():  # at most ``buckets`` rows
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((float(b + 1) * (s + n)) / (float(a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(row, id, n_words, n_features, weight)`` from ``(row, id, text)``."""
    longs = [StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]
    schema = StructType([rows.schema["row"], rows.schema["id"], *longs])

    def task(batches):
        for batch in slices(batches):
            size = batch.num_rows
            n_words, count, total = (np.zeros(size, np.int64) for _ in range(3))
            for words, at, found in features(empty_as_bytes(batch.column(2)), len(gain)):
                n = np.bincount(at, minlength=size)
                count += n
                n_words += n if words == 1 else 0
                # Sums of whole numbers far below 2 ** 53 are exact.
                total += np.bincount(at, weights=gain[found], minlength=size).astype(np.int64)
            mean = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield {"row": batch.column(0), "id": batch.column(1), "n_words": n_words, "n_features": count, "weight": mean}

    return arrow(rows.select("row", "id", "text"), task, schema)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the key's hash."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _drawn(
    docs: DataFrame, target: DataFrame, row: Column, id_col: str, text_col: str,
    buckets: int, min_words: int, percent: int, seed: int,
) -> DataFrame:
    """``(row, id, n_features, weight, score, rank)`` of every row; ``rank`` is null unless drawn."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets))
    rows = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = weighted(rows, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = to_scratch(scored.withColumn("no", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= min_words
    draws = percent * scored.where(able).count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("no")]
    keys = scored.where(able).select("score", "id", "no")
    dealt = to_scratch(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "score-ranges")
    # One short row per task of the range partitioning.
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before")).where(F.col("before") < draws)
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranks = dealt.withColumn("inside", inside).join(starts, "part")
    ranks = ranks.select("no", (F.col("before") + F.col("inside")).cast("long").alias("rank")).where(F.col("rank") <= draws)
    return scored.join(ranks, "no", "left").select("row", "id", "n_features", "weight", "score", "rank")


def importance(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
    min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, ``n_features``, ``weight``, ``score``, ``rank`` among the drawn ones."""
    found = _drawn(docs, target, F.lit(0), id_col, text_col, buckets, min_words, percent, seed)
    return found.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
    min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """The drawn rows, with all their columns."""
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    found = _drawn(docs, target, whole, id_col, text_col, buckets, min_words, percent, seed)
    return found.where("rank IS NOT NULL").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
