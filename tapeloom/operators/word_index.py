"""A stored index of words that grows by parts, and best hits without reading all of it.

A part holds the words of one batch of segments.  Its postings are bucketed and sorted
by word and block; a block is a share of the urls, chosen by hash.  Beside them lies, for
each word and block, how often the word stands in one segment at most.  From these
maxima follows the best rank that any segment of a block can have.

``top_hits`` reads blocks in falling order of that bound, in growing groups, and stops as
soon as no block that is left can reach the rank of its last hit.  The result is exact.

A stemmed index stores stems in place of words, so a query's few stems are looked up and
never the spellings that share them.  Segments must have unique keys without nulls,
and all of a url come in one part; a null text has no words.  Maxima are written last, and
only parts with maxima are read, so a part whose writing stopped halfway does not count.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.let import let
from ..functions.stem import english_stem
from ..functions.text import INDEX_STOP_WORDS, phrase_words, query_words, words
from ..session import PIN_ROWS, local, pin, to_scratch
from . import keyword
from .joins import absent, present
from .rows import top_k

FIRST_GROUP = 16  # blocks that are read before the first look at the bounds
GROWTH = 4


@dataclass(frozen=True)
class WordIndex:
    """Where an index lies and how it is laid out; ``parts`` are the ones to read."""

    path: str
    buckets: int = 64
    blocks: int = 256
    stemmed: bool = False
    keys: tuple[str, ...] = ("url", "segment_id")
    parts: tuple[str, ...] = ()

    def opened(self, spark: SparkSession) -> WordIndex:
        """The same index with all parts that are complete."""
        try:
            found = spark.read.parquet(f"{self.path}/maxima").select("part").distinct().collect()
        except AnalysisException:
            return replace(self, parts=())
        return replace(self, parts=tuple(sorted(str(r[0]) for r in found)))

    def variants(self, query: str) -> keyword.Variants | None:
        if not self.stemmed:
            return None
        asked = {w for p in query_words(query) for w in p} | {w for _, w in phrase_words(query)}
        return keyword.Stems({w: english_stem(w) for w in asked})

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        folders = [f"{self.path}/{name}/part={p}" for p in self.parts]
        return spark.read.option("basePath", f"{self.path}/{name}").parquet(*folders)

    def block(self) -> Column:
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.blocks)).cast("int")


def _counted(listed: str) -> Column:
    """``(term, top)`` for each word of a sorted list: the word, and how often it stands there.

    Runs of equal words end where the next word differs, so a list is walked once.
    """
    own = F.col(listed)
    last = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: F.coalesce(F.get(own, i) != F.get(own, i - 1), F.lit(True)))
    ends = F.when(F.size(own) > 0, last)
    return let(ends, lambda at: F.transform(
        at, lambda end, n: F.struct(F.get(own, end - 1).alias("term"), (end - F.coalesce(F.get(at, n - 1), F.lit(0))).alias("top"))
    ))


def add(index: WordIndex, segments: DataFrame, text: str = "text") -> WordIndex:
    """Index the words of new segments as a part of their own.

    Urls that a complete part holds are passed over, so a batch that is added twice counts once.
    """
    group = index.keys[0]
    if index.parts:
        segments = absent(segments, index._read(segments.sparkSession, "urls"), group)
    segments = to_scratch(segments.select(*index.keys, text), "new-segments")
    keys, part = list(index.keys), f"p{uuid.uuid4().hex}"
    found = keyword.postings(segments, keys, text)
    kept = F.array_sort(F.filter(words(F.col(text)), lambda w: ~w.isin(*INDEX_STOP_WORDS)))
    each = segments.select(index.block().alias("block"), kept.alias("_words")).select("block", F.explode(_counted("_words")).alias("w"))
    maxima = each.select("block", "w.*").groupBy("term", "block").agg(F.max("top").alias("top"))
    if index.stemmed:
        # One row per distinct word; common words are hot keys of the join, which adaptive execution splits.
        known = to_scratch(keyword.vocabulary(found), "vocabulary")
        found = found.join(known, "term").drop("term").withColumnRenamed("stem", "term")
        maxima = maxima.join(known, "term").groupBy(F.col("stem").alias("term"), "block").agg(F.sum("top").alias("top"))
    maxima = to_scratch(maxima.withColumn("top", F.col("top").cast("bigint")), "maxima")
    if maxima.isEmpty():
        return index
    placed = found.withColumn("block", index.block())
    keyword.write_postings(placed, f"{index.path}/postings/part={part}", index.buckets, ("term", "block"))
    segments.select(group).distinct().write.parquet(f"{index.path}/urls/part={part}")
    by_term = maxima.repartitionByRange(F.col("term")).sortWithinPartitions("term", "block")
    by_term.write.parquet(f"{index.path}/maxima/part={part}")
    return replace(index, parts=(*index.parts, part))


def build(segments: DataFrame, path: str, buckets: int = 64, blocks: int = 256, stemmed: bool = False, text: str = "text") -> WordIndex:
    """An index of one part."""
    return add(WordIndex(path, buckets, blocks, stemmed), segments, text)


def hits(spark: SparkSession, index: WordIndex, query: str, phrase: bool = False, blocks: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """Keys and ``rank`` of every segment that matches, or of those in some blocks."""
    if not index.parts:
        return spark.createDataFrame([], ", ".join([f"{k} {'int' if k == 'segment_id' else 'string'}" for k in index.keys] + ["rank double"]))
    found = index._read(spark, "postings")
    if blocks is not None:
        by_part: dict[str, list[int]] = {}
        for part, block in blocks:
            by_part.setdefault(part, []).append(block)
        tests = [(F.col("part") == p) & F.col("block").isin(*b) for p, b in sorted(by_part.items())]
        found = found.where(reduce(lambda a, b: a | b, tests, F.lit(False)))
    run = keyword.phrase_hits if phrase else keyword.word_hits
    return run(found, query, index.keys, index.buckets, index.variants(query))


def bounds(spark: SparkSession, index: WordIndex, query: str, phrase: bool = False) -> list[tuple[str, int, int]]:
    """``(part, block, most covers)`` of the blocks that may hold a hit, largest first.

    At most one row for each part and block, whatever the number of segments.
    """
    groups = [[w for _, w in phrase_words(query)]] if phrase else query_words(query)
    groups = [g for g in groups if g]
    if not groups or not index.parts:
        return []
    variants = index.variants(query)
    stored = {w: keyword.forms(w, variants)[0] for g in groups for w in g}
    found = index._read(spark, "maxima").where(F.col("term").isin(*sorted(set(stored.values()))))
    number = {t: f"_t{i}" for i, t in enumerate(sorted(set(stored.values())))}
    sums = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("top"))), F.lit(0)).alias(n) for t, n in number.items()]
    # A run of words ends at most as often as its rarest word stands; alternatives add up.
    most = [F.least(*[F.col(number[t]) for t in own]) if len(own) > 1 else F.col(number[own[0]])
            for own in (sorted({stored[w] for w in g}) for g in groups)]
    most = reduce(lambda a, b: a + b, most).alias("most")
    rows = found.groupBy("part", "block").agg(*sums).select("part", "block", most).where(F.col("most") > 0)
    return sorted(((str(r[0]), r[1], r[2]) for r in rows.collect()), key=lambda r: (-r[2], r[0], r[1]))


def top_hits(
    spark: SparkSession, index: WordIndex, query: str, n: int, phrase: bool = False, allowed: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` best segments by rank, then keys; ``allowed`` holds the urls that count."""
    order = [F.col("rank").desc(), *[F.col(k) for k in index.keys]]

    def counted(found: DataFrame) -> DataFrame:
        return found if allowed is None else present(found, allowed, index.keys[0])

    if n > PIN_ROWS:
        return top_k(counted(hits(spark, index, query, phrase)), order, n)
    waiting, best, size = bounds(spark, index, query, phrase), None, FIRST_GROUP
    while waiting:
        group, waiting = waiting[:size], waiting[size:]
        found = counted(hits(spark, index, query, phrase, [(p, b) for p, b, _ in group]))
        best = pin(top_k(found if best is None else local(spark, best).unionByName(found), order, n))
        size *= GROWTH
        if best.num_rows == n:
            # A block that only ties may hold a hit with smaller keys; the slack is for sums of covers.
            last = best.column("rank")[n - 1].as_py()
            waiting = [b for b in waiting if b[2] * keyword.COVER_WEIGHT + 1e-9 >= last]
    return hits(spark, index, query, phrase, []) if best is None else local(spark, best)
