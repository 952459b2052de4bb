"""Word and phrase ranks against a direct reading of their definition."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import stem, text
from tapeloom.operators import keyword

VOCABULARY = ["king", "pop", "of", "the", "rock", "n", "roll", "café", "7"]
QUERIES = ["king of pop", "pop", "rock'n'roll king", "the of", "king king", "Café, 7", "roll the rock of pop", "n", "rock-roll"]


def word_rank(body, query):
    found = text.split_words(body)
    parts = text.query_words(query)
    ends = {
        i
        for i in range(len(found))
        for p in parts
        if i + 1 >= len(p) and found[i + 1 - len(p) : i + 1] == p
    }
    return 0.1 * len(ends)


def phrase_rank(body, query):
    found, phrase = text.split_words(body), text.phrase_words(query)
    if not phrase:
        return 0.0
    span, own, total = phrase[-1][0], {w for _, w in phrase}, 0.0
    for start in range(len(found) - span):
        if all(found[start + o] == w for o, w in phrase):
            offsets = {o for o, _ in phrase}
            foreign = sum(found[start + g] not in own for g in range(span) if g not in offsets)
            total += 0.1 / (1 + foreign)
    return total


@pytest.fixture(scope="module")
def bodies():
    pick = random.Random(5)
    joiners = [" ", ", ", "'", "-", "\n"]
    made = ["".join(pick.choice(VOCABULARY) + pick.choice(joiners) for _ in range(pick.randint(0, 30))) for _ in range(150)]
    return made + ["", "jim carrey is jim", "king of pop", "king pop pop"]


@pytest.fixture(scope="module")
def segments(spark, bodies):
    rows = [("v" + str(i % 7), i, b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "url string, segment_id int, text string").cache()


def ranks(df):
    return {r["segment_id"]: round(r["rank"], 9) for r in df.collect()}


def expected(bodies, fn, query):
    found = {i: round(fn(b, query), 9) for i, b in enumerate(bodies)}
    return {i: r for i, r in found.items() if r > 0}


@pytest.mark.parametrize("query", QUERIES)
def test_scan_and_postings_agree_with_definition(segments, bodies, query):
    index = keyword.postings(segments)
    for fn, column, hits in (
        (word_rank, keyword.word_rank, keyword.word_hits),
        (phrase_rank, keyword.phrase_rank, keyword.phrase_hits),
    ):
        wanted = expected(bodies, fn, query)
        scanned = segments.select("url", "segment_id", column(F.col("text"), query).alias("rank")).where("rank > 0")
        assert ranks(scanned) == wanted
        assert ranks(hits(index, query)) == wanted


def test_known_ranks(spark):
    df = spark.createDataFrame([("jim carrey is jim",), ("king of pop",)], "text string")
    got = df.select(
        keyword.word_rank(F.col("text"), "jim carrey"),
        keyword.phrase_rank(F.col("text"), "jim carrey"),
        keyword.phrase_rank(F.col("text"), "king of pop"),
    ).collect()
    assert got[0][0] == pytest.approx(0.3) and got[0][1] == pytest.approx(0.1) and got[1][2] == pytest.approx(0.05)


def test_null_text_never_matches(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.where(keyword.word_rank(F.col("text"), "pop") > 0).count() == 0
    assert df.where(keyword.phrase_rank(F.col("text"), "pop") > 0).count() == 0


def test_stored_postings_prune_folders(spark, segments, plan_of, tmp_path):
    path = str(tmp_path / "postings")
    keyword.write_postings(keyword.postings(segments), path, 4)
    hits = keyword.word_hits(spark.read.parquet(path), "pop", buckets=4)
    plan = plan_of(hits)
    assert "PartitionFilters: [isnotnull(term_bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,pop)]" in plan
    assert ranks(hits) == ranks(keyword.word_hits(keyword.postings(segments), "pop"))


def test_scan_needs_no_shuffle(segments, plan_of):
    found = segments.select("segment_id", keyword.word_rank(F.col("text"), "king pop").alias("rank")).where("rank > 0")
    assert "Exchange" not in plan_of(found)


def test_stems_widen_the_query(spark):
    rows = [("u", 0, "Songs of the nights"), ("u", 1, "a song"), ("u", 2, "singing nightly"), ("u", 3, "night songs, night song")]
    df = spark.createDataFrame(rows, "url string, segment_id int, text string")
    index = keyword.postings(df)
    known = keyword.vocabulary(index)
    variants = keyword.stem_variants(known, "song of night")
    assert variants == {"song": ["song", "songs"], "night": ["night", "nightly", "nights"]}

    def found(rank):
        return ranks(df.select("url", "segment_id", rank.alias("rank")).where("rank > 0"))

    words = found(keyword.word_rank(F.col("text"), "song of night", variants))
    assert words == {0: 0.2, 1: 0.1, 2: 0.1, 3: 0.4} == ranks(keyword.word_hits(index, "song of night", variants=variants))
    phrase = found(keyword.phrase_rank(F.col("text"), "song of night", variants))
    assert phrase == ranks(keyword.phrase_hits(index, "song of night", variants=variants))
    # "songs of the nights" has one word too many; "songs, night song" has a foreign gap of none.
    assert phrase == {}
    adjacent = keyword.stem_variants(known, "night song")
    assert found(keyword.phrase_rank(F.col("text"), "night song", adjacent)) == {3: 0.2}


def test_only_distinct_words_are_stemmed(spark, plan_of):
    """A filter on stems stays above the aggregate, one on first letters goes below it."""
    known = keyword.vocabulary(keyword.postings(spark.range(1).select("id", F.lit("song songs sang of night").alias("text")), ["id"]))
    plan = plan_of(known.where(F.substring("term", 1, 1) == "s").where(F.col("stem") == "song"))
    assert plan.count("ArrowEvalPython") >= 1
    assert plan.rindex("ArrowEvalPython") < plan.index("HashAggregate")
    assert plan.index("substring") > plan.rindex("HashAggregate")
    assert keyword.stem_variants(known, "songs") == {"songs": ["song", "songs"]}


def test_stems_keep_the_first_letter():
    words = ["skis", "skies", "dying", "ties", "ied", "eed", "ying", "yes", "ugly", "ational", "oed", "y", "eeing", "al", "ly"]
    assert all(stem.english_stem(w)[0] == w[0] for w in words)


def test_counts_over_gathered_postings_shuffle_texts_only(spark, plan_of):
    rows = [(i % 7, "king pop king" if i % 2 else None) for i in range(40)] + [(None, "rock the pop"), (None, "pop"), (8, "of the")]
    segments = spark.createDataFrame(rows, "id bigint, text string")

    def counts(found):
        return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("terms"), F.sum("pos").alias("places"))

    got = counts(keyword.postings(keyword.gathered(segments, ["id"]), ["id"]))
    assert plan_of(got).count("Exchange") == 1
    key = lambda r: (r["id"] is None, r["id"] or 0)
    assert sorted(got.collect(), key=key) == sorted(counts(keyword.postings(segments, ["id"])).collect(), key=key)
