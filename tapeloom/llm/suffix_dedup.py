"""Removal of long passages that occur twice or more, by suffix orders of shards.

A window is a text of ``depth`` bytes inside a document.  Every byte of a window that
occurs elsewhere is removed.

1. Each window has an anchor: of the shorter texts of ``GRAM`` bytes inside it, the one
   with the smallest hash, the leftmost of equals.  Equal windows have equal anchors, so
   a window can only recur where its anchor does.  Anchors are counted by partial
   aggregates; documents learn which of their anchors recur, and nothing else of them
   goes on.
2. Stretches of neighbouring windows with the same recurring anchor are cut out.  Equal
   stretches of a task become one row with a count.
3. Stretches are dealt to shards by their anchor.  A shard sorts all suffixes of its
   stretches by induced sorting (``induced_sort``), which also yields the common
   prefixes; neighbours with a common prefix of ``depth`` bytes are equal windows.
4. Runs of recurring windows go back to the documents, which drop the bytes.

An anchor with more than ``HOT`` rows of stretches would crowd a shard.  Its stretches
are taken apart into single windows, dealt by their own hashes; those whose hash occurs
once cannot recur and end there, the others meet in the shards like stretches do.

Documents are told apart by a 128-bit hash of their text, so rows need no numbers and a
lost task computes the same again.  A task passes on two copies of a text at most, which
is all that a count of two needs.

Defined results: a null text is empty.  Ids are only carried, so null and repeated ones
are rows like others; fully repeated rows are copies of each other.  Texts below
``depth`` bytes keep everything.  An empty table gives an empty result.  What remains of
a text need not be valid UTF-8, so it is given as bytes.  Rows travel inside one struct,
so names of other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..session import to_scratch
from .common import arrow, empty_as_bytes, slices, small_batches
from .induced_sort import repeated

DEPTH = 200
GRAM = 40
HOT = 2_000  # rows of an anchor's stretches that one shard takes
SHARD_BYTES = 2 << 20  # aim for the stretches of a shard
QUEUE_TUPLES = 1 << 20  # that a shard's queue holds in memory
GROUP = 1 << 18  # bytes that are hashed together
COMBINED_BYTES = 4 << 20  # of different stretches that a task counts before it passes them on
BATCH_ROWS = 500  # that go to a Python worker at once
SEEN_TEXTS = 1_000_000  # hashes of texts that a task remembers

PLACES = np.uint64((1 << 22) - 1)  # low bits that hold a place instead of a hash
_RNG = np.random.default_rng(42)
OF_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


UP = _powers(BASE, GROUP + (1 << 16))
DOWN = _powers(pow(BASE, -1, 2**64), GROUP + (1 << 16))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` bytes."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(OF_BYTE[data] * UP[: len(data)], dtype=np.uint64)])
    h = (sums[gram:] - sums[:-gram]) * DOWN[: len(sums) - gram]
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, stops: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, last, anchor)`` for each run of windows with the same anchor.

    ``data`` holds texts end to end that stop at ``stops``; runs lie within one text.
    """
    windows = len(data) - depth + 1
    if windows < 1:
        return (np.zeros(0, np.int64),) * 3
    h = gram_hashes(data, gram)
    least, width, reach = (h & ~PLACES) | np.arange(len(h), dtype=np.uint64), 1, depth - gram + 1
    while 2 * width <= reach:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:windows], least[reach - width : reach - width + windows])
    place = (least & PLACES).astype(np.int64)
    inside = np.repeat(stops, np.diff(stops, prepend=0))[:windows] - np.arange(windows) >= depth
    starts = inside & ((np.diff(place, prepend=-1) != 0) | ~np.concatenate([[False], inside[:-1]]))
    first = np.flatnonzero(starts)
    # A run ends before the next one or where windows leave their text.
    limit = np.searchsorted(stops, first, "right")
    last = np.minimum(np.append(first[1:], windows)[: len(first)] - 1, stops[limit] - depth)
    return first, last, h[place[first]].view(np.int64)


def text_anchors(texts: list[bytes], depth: int, gram: int) -> Iterator[tuple[list[int], int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(texts' numbers, offset, runs...)`` by groups; a long text comes in blocks that overlap by a window."""

    def one(numbers: list[int], offset: int, parts: list[bytes]):
        stops = np.cumsum([len(p) for p in parts])
        first, last, key = anchors(np.frombuffer(b"".join(parts), np.uint8), stops, depth, gram)
        at = np.searchsorted(stops, first, "right")
        begin = np.concatenate([[0], stops])[at]
        return np.array(numbers, np.int64)[at], first - begin + offset, last - begin + offset, key

    numbers, parts, size = [], [], 0
    for number, text in enumerate(texts):
        if len(text) > GROUP:
            for low in range(0, len(text) - depth + 1, GROUP - depth + 1):
                yield one([number], low, [text[low : low + GROUP]])
            continue
        if size + len(text) > GROUP:
            yield one(numbers, 0, parts)
            numbers, parts, size = [], [], 0
        numbers.append(number)
        parts.append(text)
        size += len(text)
    if parts:
        yield one(numbers, 0, parts)


def _hash(value: bytes) -> tuple[int, int]:
    low = xxhash.xxh3_128_intdigest(value)
    return (low >> 64) - (1 << 63), (low & ((1 << 64) - 1)) - (1 << 63)


def text_hash(text: Column) -> tuple[Column, Column]:
    """Two independent hashes of a text."""
    return F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2")


def _two_of_each(batch, seen: Counter) -> np.ndarray:
    """Which rows are the first or second copy of their text (``h1, h2``) in this task."""
    wanted = np.zeros(batch.num_rows, bool)
    for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        if seen[key] < 2:
            seen[key] += 1
            wanted[i] = True
    if len(seen) > SEEN_TEXTS:
        seen.clear()
    return np.flatnonzero(wanted)


def _hashed_texts(docs: DataFrame, text_col: str, depth: int) -> DataFrame:
    text = F.col(text_col)
    return docs.where(F.octet_length(text) >= depth).select(*text_hash(text), text.cast("binary").alias("text"))


def _texts(docs: DataFrame, text_col: str, depth: int) -> DataFrame:
    """``(h1, h2, text)`` of texts that hold a window; at most two copies of each from a task."""
    narrow = _hashed_texts(docs, text_col, depth)

    def task(batches):
        seen: Counter = Counter()
        for batch in slices(batches):
            keep = _two_of_each(batch, seen)
            yield {name: batch.column(i).take(keep) for i, name in enumerate(("h1", "h2", "text"))}

    return arrow(narrow, task, narrow.schema)


def _anchor_rows(docs: DataFrame, text_col: str, depth: int, gram: int) -> DataFrame:
    """``(anchor, h1)`` for each run of windows, of the same copies."""

    def task(batches):
        seen: Counter = Counter()
        for batch in slices(batches):
            own = batch.take(_two_of_each(batch, seen))
            h1 = own.column(0).to_numpy()
            for number, _, _, key in text_anchors(empty_as_bytes(own.column(2)), depth, gram):
                yield {"anchor": key, "h1": h1[number]}

    return arrow(_hashed_texts(docs, text_col, depth), task, StructType.fromDDL("anchor bigint, h1 bigint"))


PARTS = "kind tinyint, h1 bigint, h2 bigint, low bigint, anchor bigint, c1 bigint, c2 bigint, n bigint, body binary"
STRETCH, SPOT, TEXT = 0, 1, 2


def _stretches(texts: DataFrame, shared: DataFrame, depth: int, gram: int) -> DataFrame:
    """Stretches with counts, the spots where they stand, and the texts that hold one."""
    found = texts.join(shared, "h1").select("h1", "h2", "text", "anchors")
    names = StructType.fromDDL(PARTS).names

    def task(batches):
        counts, held = Counter(), 0

        def rows():
            return {name: [] for name in names}

        def add(out, **row):
            for name in names:
                out[name].append(row.get(name))

        def counted():
            out = rows()
            for (k, body), n in counts.items():
                add(out, kind=STRETCH, anchor=k, n=n, body=body)
            return out

        for batch in slices(batches, 100):
            h1, h2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts, known, out, used = empty_as_bytes(batch.column(2)), batch.column(3).to_pylist(), rows(), {}
            sets = [set(x) for x in known]
            for number, first, last, key in text_anchors(texts, depth, gram):
                for i, low, high, k in zip(number.tolist(), first.tolist(), last.tolist(), key.tolist()):
                    if k in sets[i]:
                        body = texts[i][low : high + depth]
                        held += 0 if (k, body) in counts else len(body)
                        counts[k, body] += 1
                        # The spots of one copy of a text say all.
                        if used.setdefault((h1[i], h2[i]), i) == i:
                            c1, c2 = _hash(body)
                            add(out, kind=SPOT, h1=h1[i], h2=h2[i], low=low, c1=c1, c2=c2)
            for (a, b), i in used.items():
                add(out, kind=TEXT, h1=a, h2=b, body=texts[i])
            yield out
            if held > COMBINED_BYTES:
                yield counted()
                counts.clear()
                held = 0
        yield counted()

    return to_scratch(arrow(found, task, StructType.fromDDL(PARTS)), "stretches")


def _windows(items: DataFrame, depth: int) -> DataFrame:
    """Each different window of a task's stretches once, with its count and the stretches it stands in."""

    def task(batches):
        found: dict[bytes, list] = {}
        held = 0

        def rows():
            out = {name: [] for name in ("w1", "w2", "n", "body", "owners")}
            for window, (n, owners) in found.items():
                for name, value in zip(out, (*_hash(window), n, window, owners)):
                    out[name].append(value)
            return out

        for batch in slices(batches, 100):
            for body, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c1, c2 = _hash(body)
                for at in range(len(body) - depth + 1):
                    own = found.setdefault(body[at : at + depth], [0, []])
                    held += 32 if own[1] else depth
                    own[0] += n
                    own[1].append({"c1": c1, "c2": c2, "at": at})
            if held > COMBINED_BYTES:
                yield rows()
                found.clear()
                held = 0
        yield rows()

    schema = "w1 bigint, w2 bigint, n bigint, body binary, owners array<struct<c1:bigint,c2:bigint,at:bigint>>"
    return arrow(items.select("body", "n"), task, StructType.fromDDL(schema))


def _sorted_shards(items: DataFrame, depth: int, shards: int, tuples: int) -> DataFrame:
    """``(c1, c2, first, last)``: runs of recurring windows in the stretches ``(anchor, body, n)``."""

    def task(batches):
        total: Counter = Counter()
        for batch in slices(batches):
            for body, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[body] += n
        if not total:
            return
        bodies = list(total)
        owner, first, last = repeated(bodies, np.minimum(np.array(list(total.values()), np.int64), 2), depth, tuples)
        hashes = {i: _hash(bodies[i]) for i in np.unique(owner).tolist()}
        own = [hashes[i] for i in owner.tolist()]
        yield {"c1": [a for a, _ in own], "c2": [b for _, b in own], "first": first, "last": last}

    dealt = items.repartition(shards, "anchor").select("body", "n")
    return arrow(dealt, task, StructType.fromDDL("c1 bigint, c2 bigint, first bigint, last bigint"))


def recurring(parts: DataFrame, depth: int, hot: int, shard_bytes: int, tuples: int) -> DataFrame:
    """``(c1, c2, runs)``: for each stretch with windows that occur twice or more, where runs of them begin and end."""
    spark = parts.sparkSession
    stretches = parts.where(F.col("kind") == STRETCH).select("anchor", "body", "n")
    crowded = stretches.groupBy("anchor").count().where(F.col("count") > hot).select("anchor")
    crowded = to_scratch(crowded, "hot-anchors")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def shards(rows: DataFrame) -> int:
        return (rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // shard_bytes + 1

    def by_stretch(rows: DataFrame) -> DataFrame:
        # At most one run for each window of a stretch.
        return rows.groupBy("c1", "c2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))

    if crowded.isEmpty():
        return by_stretch(_sorted_shards(stretches, depth, max(least, shards(stretches)), tuples))
    packed_hot = to_scratch(stretches.join(crowded, "anchor", "left_semi"), "hot-stretches")
    dealt = packed_hot.repartition(shards(packed_hot), F.xxhash64("body"))
    single = to_scratch(_windows(dealt, depth), "windows")
    again = single.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("w1", "w2")
    # Windows that a task met twice recur for certain, by their bytes, and need no join.
    known = single.where(F.col("n") > 1)
    alone = to_scratch(single.where(F.col("n") == 1).join(again, ["w1", "w2"], "left_semi"), "hot-windows")
    rows = known.unionByName(alone).groupBy(F.col("w1").alias("anchor"), "body").agg(F.sum("n").alias("n"))
    whole = stretches.join(crowded, "anchor", "left_anti").unionByName(rows)
    found = to_scratch(_sorted_shards(whole, depth, max(least, shards(stretches)), tuples), "recurring")
    of_windows = found.select(F.col("c1").alias("w1"), F.col("c2").alias("w2"))
    owners = alone.join(of_windows, ["w1", "w2"], "left_semi").unionByName(known).select(F.explode("owners").alias("o"))
    runs = owners.select("o.c1", "o.c2", F.col("o.at").alias("first"), F.col("o.at").alias("last"))
    return by_stretch(found.unionByName(runs))


def kept_bytes(text: bytes, runs: list[tuple[int, int]], depth: int) -> tuple[bytes, int]:
    """What remains without the windows that begin in ``runs``, and how many pieces were cut out."""
    parts, at, pieces = [], 0, 0
    for first, last in sorted(runs):
        if first > at or not pieces:
            pieces += 1
            parts.append(text[at:first])
        at = max(at, last + depth)
    return b"".join([*parts, text[at:]]), pieces


def _cut(docs: DataFrame, text_col: str, depth: int, gram: int, hot: int, shard_bytes: int, tuples: int, carry: bool) -> DataFrame:
    """``(h1, h2, n_removed, n_spans, sha)`` of each text that loses bytes, and what is ``kept`` if asked for."""
    with small_batches(docs.sparkSession, BATCH_ROWS):
        # Copies of a text that came from different tasks give equal rows.
        found = _cut_rows(docs, text_col, depth, gram, hot, shard_bytes, tuples, carry)
        return to_scratch(found.dropDuplicates(["h1", "h2"]), "cut-texts")


def _cut_rows(docs: DataFrame, text_col: str, depth: int, gram: int, hot: int, shard_bytes: int, tuples: int, carry: bool) -> DataFrame:
    texts = _texts(docs, text_col, depth)
    rows = _anchor_rows(docs, text_col, depth, gram)
    often = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("anchor")
    shared = rows.join(often, "anchor", "left_semi").groupBy("h1").agg(F.collect_set("anchor").alias("anchors"))
    parts = _stretches(texts, shared, depth, gram)
    runs = recurring(parts, depth, hot, shard_bytes, tuples)
    spots = parts.where(F.col("kind") == SPOT).select("h1", "h2", "low", "c1", "c2")
    cuts = spots.join(runs, ["c1", "c2"]).groupBy("h1", "h2").agg(F.collect_set(F.struct("low", "runs")).alias("runs"))
    bodies = parts.where(F.col("kind") == TEXT).select("h1", "h2", "body")
    schema = StructType.fromDDL("h1 bigint, h2 bigint, n_removed bigint, n_spans bigint, sha string" + (", kept binary" if carry else ""))

    def task(batches):
        for batch in slices(batches):
            out = {f: [] for f in schema.names}
            for h1, h2, body, own in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                spots = [(s["low"] + r["first"], s["low"] + r["last"]) for s in own for r in s["runs"]]
                kept, pieces = kept_bytes(body, spots, depth)
                values = (h1, h2, len(body) - len(kept), pieces, hashlib.sha256(kept).hexdigest(), kept)
                for name, value in zip(out, values):
                    out[name].append(value)
            yield out

    return arrow(bodies.join(cuts, ["h1", "h2"]).select("h1", "h2", "body", "runs"), task, schema)


def repeats_digest(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM,
    hot: int = HOT, shard_bytes: int = SHARD_BYTES, tuples: int = QUEUE_TUPLES,
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans`` and a hash of what remains."""
    cut = _cut(docs, text_col, depth, gram, hot, shard_bytes, tuples, False)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), *text_hash(F.col(text_col)), F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("whole"),
    )
    return rows.join(cut, ["h1", "h2"], "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def drop_repeats(
    docs: DataFrame, text_col: str = "text", depth: int = DEPTH, gram: int = GRAM, hot: int = HOT,
    shard_bytes: int = SHARD_BYTES, tuples: int = QUEUE_TUPLES,
) -> DataFrame:
    """Each input row as struct ``row`` with what remains of its text as bytes in ``kept``."""
    cut = _cut(docs, text_col, depth, gram, hot, shard_bytes, tuples, True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *text_hash(F.col(text_col)))
    whole = F.coalesce(F.col("row").getField(text_col), F.lit("")).cast("binary")
    return rows.join(cut, ["h1", "h2"], "left").select("row", F.coalesce("kept", whole).alias("kept"))
