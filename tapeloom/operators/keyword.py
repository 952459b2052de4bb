"""Word and phrase matching with cover-density ranks.

Two ways to the same result: expressions over the text of a row, which need no
shuffle, and a stored postings table, which reads only the wanted words.

Ranks follow Clarke, Cormack and Tudhope: with the usual weight of 0.1, a query
of alternatives scores 0.1 per matching position, and a phrase scores
``0.1 / (1 + foreign words inside)`` per occurrence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.let import let
from ..functions.stem import english_stem, stem
from ..functions.text import INDEX_STOP_WORDS, WORD_BREAK, phrase_words, query_words, split_lower, words

# Fixed value: the weight of one cover.
COVER_WEIGHT = 0.1


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _all(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


# Words of the texts that count as a word of the query, such as those with its stem.
Variants = Mapping[str, Sequence[str]]


class Stems(dict):
    """Variants for postings that hold stems: each word of the query with its one stem."""


def forms(word: str, variants: Variants | None) -> list[str]:
    """The spellings under which a word of the query may be found."""
    if isinstance(variants, Stems):
        return [variants[word]]
    return sorted({word, *(variants or {}).get(word, ())})


def _may_contain(low: Column, words_: Sequence[str], every: bool, variants: Variants | None) -> Column:
    """Cheap substring test that every real match passes; saves splitting the rest."""
    tests = [_any([low.contains(t) for t in forms(w, variants)]) for w in sorted(set(words_))]
    return _all(tests) if every else _any(tests)


def word_rank(text: Column, query: str, variants: Variants | None = None) -> Column:
    """Rank of a text for any of the query's words; 0 without a match."""
    parts = query_words(query)
    if not parts:
        return F.lit(0.0)
    single = sorted({t for p in parts if len(p) == 1 for t in forms(p[0], variants)})
    joined = [p for p in parts if len(p) > 1]

    def ends_here(found: Column):
        def test(word: Column, i: Column) -> Column:
            hit = word.isin(*single) if single else F.lit(False)
            for part in joined:
                back = len(part) - 1
                tail = [F.get(found, i - back + n).isin(*forms(p, variants)) for n, p in enumerate(part)]
                hit = hit | F.coalesce((i >= back) & _all(tail), F.lit(False))
            return hit

        return test

    def rank(low: Column) -> Column:
        if joined:
            hits = let(split_lower(low), lambda found: F.size(F.filter(found, ends_here(found))))
        else:
            hits = F.size(F.filter(F.split(low, WORD_BREAK), lambda w: w.isin(*single)))
        likely = _may_contain(low, [p[0] for p in parts], False, variants)
        return F.when(likely, hits * F.lit(COVER_WEIGHT)).otherwise(0.0)

    return let(F.lower(text), rank)


def phrase_rank(text: Column, query: str, variants: Variants | None = None) -> Column:
    """Rank of a text for the query as a phrase; 0 without a match."""
    phrase = phrase_words(query)
    if not phrase:
        return F.lit(0.0)
    last = phrase[-1][0]
    own = sorted({w for _, w in phrase})
    lexemes = sorted({t for w in own for t in forms(w, variants)})
    placed = dict(phrase)
    gaps = [o for o in range(last) if o not in placed]

    def score(found: Column) -> Column:
        def at(start: Column) -> Column:
            here = _all([F.get(found, start + o).isin(*forms(w, variants)) for o, w in phrase])
            foreign = sum(
                ((~F.get(found, start + g).isin(*lexemes)).cast("int") for g in gaps), F.lit(0)
            )
            return F.when(here, F.lit(COVER_WEIGHT) / (foreign + 1)).otherwise(0.0)

        starts = F.sequence(F.lit(0), F.size(found) - (last + 1))
        covers = F.transform(starts, at)
        total = F.aggregate(covers, F.lit(0.0), lambda a, b: a + b)
        return F.when(F.size(found) > last, total).otherwise(0.0)

    def rank(low: Column) -> Column:
        return F.when(_may_contain(low, own, True, variants), let(split_lower(low), score)).otherwise(0.0)

    return let(F.lower(text), rank)


# ---------------------------------------------------------------- postings


def postings(segments: DataFrame, keys: Sequence[str] = ("url", "segment_id"), text: str = "text") -> DataFrame:
    """One row per indexed word occurrence: ``term``, the keys, ``pos``.

    Positions count every word, so stop words leave gaps.
    """
    listed = segments.select(*keys, F.posexplode(words(F.col(text))).alias("pos", "term"))
    return listed.where(~F.col("term").isin(*INDEX_STOP_WORDS)).select("term", *keys, "pos")


# Parts of the texts for each part that the scan has.
GATHERED_SPLITS = 8


def gathered(segments: DataFrame, keys: Sequence[str] = ("url", "segment_id")) -> DataFrame:
    """The segments by hash of their keys, for aggregates over the postings of each.

    Texts are shuffled once in place of their words.  The number of parts grows with the input,
    so the distinct words of a part's segments fit in a task's memory.
    """
    least = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(max(least, GATHERED_SPLITS * segments.rdd.getNumPartitions()), *keys)


def vocabulary(found: DataFrame) -> DataFrame:
    """Distinct words of a postings table with their English stems.

    The stem reads the word's count too.  A filter on stems of the word alone would be pushed
    below the aggregate, and every word of the running text would be stemmed.
    """
    counted = found.groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
    return counted.select("term", stem(F.when(F.col("_n") > 0, F.col("term"))).alias("stem"))


def stem_variants(known: DataFrame, query: str) -> dict[str, list[str]]:
    """For each word of the query, the known words with the same stem.

    ``known`` is a vocabulary.  The texts keep their words as they are; the
    query is widened instead, so stems cost nothing while texts are read.  The
    list holds the spellings of the query's few stems, however many those are.
    """
    asked = sorted({w for p in query_words(query) for w in p} | {w for _, w in phrase_words(query)})
    stems = {w: english_stem(w) for w in asked}
    if not asked:
        return {}
    # A stem begins with its word's first letter, so most words need not be counted or stemmed.
    likely = known.where(F.substring("term", 1, 1).isin(*{s[0] for s in stems.values()}))
    rows = likely.where(F.col("stem").isin(*set(stems.values()))).select("term", "stem").distinct().collect()
    return {w: sorted(r["term"] for r in rows if r["stem"] == s) for w, s in stems.items()}


def write_postings(found: DataFrame, path: str, buckets: int = 64, order: Sequence[str] = ("term",)) -> None:
    """Store postings so that a lookup reads few files.

    Terms are hashed to folders and sorted inside files by the ``order`` columns.  ``rebalance`` lets
    adaptive execution split the folder of a very common word.  Choose as many
    buckets as keep a folder at a few GB.
    """
    bucketed = found.withColumn("term_bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    (
        bucketed.hint("rebalance", "term_bucket")
        .sortWithinPartitions("term_bucket", *order)
        .write.partitionBy("term_bucket")
        .parquet(path)
    )


def lookup(found: DataFrame, terms: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Postings of the given terms; with ``buckets`` only their folders are read."""
    unique = sorted(set(terms))
    if not unique:
        return found.where(F.lit(False))
    picked = found.where(F.col("term").isin(*unique))
    if buckets is None:
        return picked
    spark = found.sparkSession
    frame = spark.createDataFrame([(t,) for t in unique], "term string")
    numbers = frame.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()
    return picked.where(F.col("term_bucket").isin(*[n[0] for n in numbers]))


def word_hits(
    found: DataFrame,
    query: str,
    keys: Sequence[str] = ("url", "segment_id"),
    buckets: int | None = None,
    variants: Variants | None = None,
) -> DataFrame:
    """Keys and ``rank`` of everything that holds a word of the query."""
    parts = query_words(query)
    picked = lookup(found, [t for p in parts for w in p for t in forms(w, variants)], buckets)
    single = [p for p in parts if len(p) == 1]
    if len(single) == len(parts):
        return picked.groupBy(*keys).agg((F.count(F.lit(1)) * F.lit(COVER_WEIGHT)).alias("rank"))
    # Every occurrence votes for the position where its word would end; a
    # position counts once all parts of one word voted for it.
    votes = [
        F.when(
            F.col("term").isin(*forms(w, variants)),
            F.struct((F.col("pos") + (len(part) - 1 - n)).alias("end"), F.lit(i).alias("part"), F.lit(n).alias("nth")),
        )
        for i, part in enumerate(parts)
        for n, w in enumerate(part)
    ]
    needed = F.element_at(F.array(*[F.lit(len(p)) for p in parts]), F.col("part") + 1)
    return (
        picked.select(*keys, F.explode(F.array_compact(F.array(*votes))).alias("vote"))
        .select(*keys, "vote.*")
        .groupBy(*keys, "end", "part")
        .agg(F.count_distinct("nth").alias("_have"))
        .where(F.col("_have") == needed)
        .select(*keys, "end")
        .distinct()
        .groupBy(*keys)
        .agg((F.count(F.lit(1)) * F.lit(COVER_WEIGHT)).alias("rank"))
    )


def phrase_hits(
    found: DataFrame,
    query: str,
    keys: Sequence[str] = ("url", "segment_id"),
    buckets: int | None = None,
    variants: Variants | None = None,
) -> DataFrame:
    """Keys and ``rank`` of everything that holds the query as a phrase."""
    phrase = phrase_words(query)
    picked = lookup(found, [t for _, w in phrase for t in forms(w, variants)], buckets)
    placed = dict(phrase)
    last = phrase[-1][0] if phrase else 0
    # Every occurrence votes for the starts it could belong to: as the word at
    # an offset of the phrase, or as a word of the phrase inside a gap.
    votes = []
    for offset in range(last + 1):
        start = (F.col("pos") - offset).alias("start")
        if offset in placed:
            vote = F.struct(start, F.lit(1).alias("hit"), F.lit(0).alias("own"))
            votes.append(F.when(F.col("term").isin(*forms(placed[offset], variants)), vote))
        else:
            votes.append(F.struct(start, F.lit(0).alias("hit"), F.lit(1).alias("own")))
    gaps = last + 1 - len(placed)
    cover = F.lit(COVER_WEIGHT) / (F.lit(1 + gaps) - F.col("_own"))
    return (
        picked.select(*keys, F.explode(F.array_compact(F.array(*votes))).alias("vote"))
        .select(*keys, "vote.*")
        .groupBy(*keys, "start")
        .agg(F.sum("hit").alias("_hits"), F.sum("own").alias("_own"))
        .where(F.col("_hits") == len(phrase))
        .groupBy(*keys)
        .agg(F.sum(cover).alias("rank"))
    )
