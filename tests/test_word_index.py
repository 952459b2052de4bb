"""The stored word index against scans of the text."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import keyword, word_index
from tapeloom.plans import chunk_search, corpus
from tapeloom.session import scratch_dir

WORDS = ["king", "kings", "pop", "of", "the", "rock", "rocks", "rocking", "n", "roll", "café", "7", "the"]
QUERIES = ["king of pop", "rock'n'roll king", "rocks kings"]


@pytest.fixture(scope="module")
def segments(spark):
    rng = random.Random(4)
    rows = [
        (f"u{i % 40}", i // 40, None if i % 97 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))))
        for i in range(1200)
    ]
    return spark.createDataFrame(rows, "url string, segment_id int, text string").cache()


@pytest.fixture(scope="module", params=[False, True], ids=["words", "stems"])
def index(request, spark, segments):
    made = word_index.WordIndex(scratch_dir(spark, "words"), buckets=4, blocks=8, stemmed=request.param)
    for part in range(3):
        made = word_index.add(made, segments.where(F.pmod(F.xxhash64("url"), F.lit(3)) == part))
    return made


def _scan(segments, index, query, phrase):
    variants = None
    if index.stemmed:
        variants = keyword.stem_variants(keyword.vocabulary(keyword.postings(segments)), query)
    rank = (keyword.phrase_rank if phrase else keyword.word_rank)(F.col("text"), query, variants)
    return sorted(
        ((r.url, r.segment_id, round(r["rank"], 9)) for r in segments.select("url", "segment_id", rank.alias("rank")).where("rank > 0").collect()),
        key=lambda r: (-r[2], r[0], r[1]),
    )


def _rows(found):
    return sorted(((r.url, r.segment_id, round(r["rank"], 9)) for r in found.collect()), key=lambda r: (-r[2], r[0], r[1]))


@pytest.mark.parametrize("phrase", [False, True])
@pytest.mark.parametrize("query", QUERIES)
def test_hits_equal_a_scan(spark, segments, index, query, phrase):
    want = _scan(segments, index, query, phrase)
    assert _rows(word_index.hits(spark, index, query, phrase)) == want
    for n in (7,):
        assert _rows(word_index.top_hits(spark, index, query, n, phrase)) == want[:n]


def test_blocks_below_the_threshold_are_not_read(spark, monkeypatch):
    """A few blocks hold the best segments; the rest is never looked at."""
    rows = [(f"u{i}", 0, "pop " * (9 if i % 50 == 0 else 1)) for i in range(400)]
    frame = spark.createDataFrame(rows, "url string, segment_id int, text string")
    index = word_index.build(frame, scratch_dir(spark, "words"), buckets=2, blocks=200)
    read, plain = [], word_index.hits
    monkeypatch.setattr(word_index, "FIRST_GROUP", 8)
    monkeypatch.setattr(word_index, "hits", lambda s, i, q, p=False, b=None: read.extend(b) or plain(s, i, q, p, b))
    best = _rows(word_index.top_hits(spark, index, "pop", 5))
    assert [r[2] for r in best] == [0.9] * 5
    assert [r[0] for r in best] == sorted(f"u{i}" for i in range(0, 400, 50))[:5]
    assert len(read) < 0.2 * len(word_index.bounds(spark, index, "pop"))


def test_bounds_hold(spark, segments, index):
    for query, phrase in [("king of pop", True), ("rock'n'roll king", False), ("rocks kings", False)]:
        most = {(p, b): m for p, b, m in word_index.bounds(spark, index, query, phrase)}
        for key, bound in most.items():
            ranks = [r["rank"] for r in word_index.hits(spark, index, query, phrase, [key]).collect()]
            assert max(ranks, default=0) <= bound * 0.1 + 1e-9
        total = len(_scan(segments, index, query, phrase))
        assert sum(word_index.hits(spark, index, query, phrase, [k]).count() for k in most) == total


def test_words_of_a_long_segment_are_counted_in_one_walk(spark):
    """A test of each distinct word against the whole list would take minutes here."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(60_000)}" for _ in range(100_000)), "pop", "b a b", "", None]
    listed = spark.createDataFrame(list(enumerate(texts)), "no int, text string")
    listed = listed.select("no", F.array_sort(F.filter(F.split("text", " "), lambda w: w != "")).alias("own"))
    got = listed.select("no", F.explode(word_index._counted("own")).alias("w")).select("no", "w.*").collect()
    want = {(no, w): n for no, t in enumerate(texts) for w, n in Counter((t or "").split()).items()}
    assert len(got) == len(want) and {(r.no, r.term): r.top for r in got} == want


def test_unfinished_and_repeated_parts(spark, segments):
    path = scratch_dir(spark, "words")
    first = word_index.add(word_index.WordIndex(path, 4, 8), segments.where("url < 'u2'"))
    # A writer that stopped before the maxima leaves postings that nobody reads.
    placed = keyword.postings(segments).withColumn("block", first.block())
    keyword.write_postings(placed, f"{path}/postings/part=broken", 4, ("term", "block"))
    both = word_index.add(first.opened(spark), segments)
    again = word_index.add(both, segments)
    assert len(both.parts) == 2 and again.parts == both.parts
    assert sorted(both.opened(spark).parts) == sorted(both.parts)
    assert _rows(word_index.hits(spark, both, "king of pop")) == _scan(segments, both, "king of pop", False)


def test_empty_index(spark):
    index = word_index.WordIndex(scratch_dir(spark, "words")).opened(spark)
    none = spark.createDataFrame([], "url string, segment_id int, text string")
    assert word_index.add(index, none).parts == ()
    assert word_index.top_hits(spark, index, "pop", 3).collect() == []
    assert word_index.hits(spark, index, "pop").collect() == []


def test_searches_read_postings_and_the_text_of_winners(spark, plan_of):
    """The plan scans postings, and transcripts only where the winners' urls are literals."""
    tables = corpus.indexed_tables(spark, "/root/testdata/sf0.001")
    plan = plan_of(chunk_search.keyword_segments(tables, "la der", 5, include_text=True))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "text" in line]
    assert scans and all("url IN" in line or "In(url" in line or "EqualTo(url" in line for line in scans)
    hits = plan_of(word_index.hits(spark, tables.postings, "la der"))
    assert "term_bucket" in hits and "In(term" in hits and "text:string" not in hits
