"""Golden rows of the column functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import embed, scores, stem, strings, text, times, titles, vectors


def values(spark, kind, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def check(spark, kind, cases, fn):
    assert values(spark, kind, list(cases), fn) == list(cases.values())


def test_video_type(spark):
    check(
        spark, "string",
        {
            "Kanye West - Yeezus ALBUM REVIEW": "album_review",
            "Best Album Review Ever (no dash)": "misc",
            "Artist - Title EP REVIEW": "ep_review",
            "A Deep Review": "ep_review",
            "X - Y TRACK REVIEW": "track_review",
            "X - Y MIXTAPE REVIEW": "mixtape_review",
            "X YUNOREVIEW": "yunoreview",
            "Y U NO REVIEW: May": "yunoreview",
            "Weekly Track Roundup": "weekly_track_roundup",
            "BEST & WORST TRACKS: 1/1": "weekly_track_roundup",
            "TND Podcast #12": "tnd_podcast",
            "Vinyl Update": "vinyl_update",
            "Hello": "misc",
            None: None,
        },
        titles.video_type,
    )


def test_review_score(spark):
    check(
        spark, "string",
        {
            " 7/10": 7, "score: 7/10": 7, "7/10": None, "x (7/10)": None, "a -7/10": -7, "a +8/10": 8,
            "first 3/10 then 9/10": 9, " 117/10": None, " 10/100": 10, "none": None, None: None,
            "line\n6/10": 6, "tab\t5/10": 5, "hard 4/10": 4, "good 8/10 (9/10)": None, "": None,
        },
        titles.review_score,
    )


def test_album_info(spark):
    check(
        spark, "string",
        {
            "Kanye West - Yeezus ALBUM REVIEW": ("kanye west", "yeezus"),
            "Jay-Z - 4:44 ALBUM REVIEW": ("jay", "z - 4:44"),
            "artist - title": ("artist", "title"),
            "No Dash ALBUM REVIEW": (None, None),
            "ALBUM REVIEW - late dash": (None, None),
            " A \t- B\nALBUM REVIEW": ("a", "b"),
            None: (None, None),
        },
        lambda c: titles.album_info(c),
    )


def test_urls_and_files(spark):
    url = "https://www.youtube.com/watch?v=ab=c"
    check(spark, "string", {url: "ab=c", "plain": "plain"}, strings.id_after_watch)
    check(spark, "string", {url: "c", "plain": "plain"}, strings.id_after_equals)
    check(spark, "string", {"ab": "https://www.youtube.com/watch?v=ab"}, strings.url_of)
    check(spark, "string", {"gs://bk/a/b.npy": ("bk", "a/b.npy"), "bk/a": ("bk", "a"), "bk": ("bk", "")}, strings.blob_address)
    check(spark, "string", {"/x/a_0_3.npy": "a_0_3", "a.b.npy": "a.b", "/x/.hidden": ".hidden", "none": "none"}, strings.file_stem)


def test_size_pretty(spark):
    check(
        spark, "bigint",
        {
            0: "0 bytes", 10239: "10239 bytes", 10240: "10 kB", 10 * 2**20 - 1: "10240 kB",
            10 * 2**20: "10 MB", 3 * 2**30: "3072 MB", 10 * 2**30: "10 GB", 10 * 2**40: "10 TB",
        },
        strings.size_pretty,
    )


def test_tokens_and_truncation(spark):
    check(spark, "string", {"": 0, "abcd": 2, "abcdefg": 2}, text.token_estimate)
    cut = values(spark, "string", ["x" * 26_250, "x" * 26_251], text.truncate_for_embedding)
    assert [len(c) for c in cut] == [26_250, 26_253] and cut[1].endswith("x...")
    assert values(spark, "string", ["y" * 50, "y" * 51], text.preview) == ["y" * 50, "y" * 50 + "..."]


def test_words_agree_with_driver_form(spark):
    samples = ["Don't stop", "  Émile 7/10, rock'n'roll!", "", "___", "a-b  C", "naïve 12th ½"]
    assert values(spark, "string", samples, text.words) == [text.split_words(s) for s in samples]


def test_or_query(spark):
    check(
        spark, "string",
        {
            "the quick brown fox": "quick | brown | fox | quick <-> brown | brown <-> fox | quick <-> brown <-> fox",
            "I like turtles": "turtles",
            "like the": "",
            "": "",
            "Big  \t Sky": "Big | Sky | Big <-> Sky",
        },
        text.or_query,
    )


def test_stop_words():
    assert len(text.INDEX_STOP_WORDS) == len(set(text.INDEX_STOP_WORDS)) == 127
    assert len(text.QUERY_STOP_WORDS) == len(set(text.QUERY_STOP_WORDS)) == 180
    assert text.phrase_words("the king of pop") == [(0, "king"), (2, "pop")]
    assert text.query_words("don't like rock'n'roll the") == [["rock", "n", "roll"]]


def test_times(spark):
    parsed = values(spark, "string", ["2024-01-31T10:11:12.5Z", "2024-01-31T10:11:12.123456Z"], times.parse_iso)
    assert parsed == [datetime(2024, 1, 31, 10, 11, 12, 500000), datetime(2024, 1, 31, 10, 11, 12, 123456)]
    assert values(spark, "double", [86400.5], times.from_epoch) == [datetime(1970, 1, 2, 0, 0, 0, 500000)]
    clock = datetime(2024, 1, 10)
    rows = [datetime(2024, 1, 9, 0, 0, 1), datetime(2024, 1, 9), None]
    assert values(spark, "timestamp_ntz", rows, lambda c: times.is_fresh(c, 1, clock)) == [True, False, False]
    assert values(spark, "timestamp_ntz", rows, lambda c: times.is_fresh(c, None, clock)) == [False] * 3
    assert times.minutes_to_seconds(20) == 1200


def test_rank_scores(spark):
    assert values(spark, "int", [1, None], scores.rank_share) == [60 / 61, 0.0]
    assert values(spark, "int", [1, None], scores.reciprocal_rank) == [1 / 61, 0.0]
    cleaned = values(spark, "array<double>", [[1.0, None, float("nan")], None], scores.null_to_zero)
    assert cleaned == [[1.0, 0.0, 0.0], None]


def test_vector_scores(spark):
    rows = [[1.0, 0.0], [0.0, 2.0], [3.0, 4.0], None, [1.0], [0.0, 0.0], [float("nan"), 1.0], [-1.0, 0.0]]
    got = values(spark, "array<float>", rows, lambda c: vectors.cosine(c, [1.0, 0.0]))
    assert got == [1.0, 0.0, 0.6, None, None, None, None, -1.0]
    got = values(spark, "array<float>", rows, lambda c: vectors.inner_product(c, [1.0, 2.0]))
    assert got == [1.0, 4.0, 11.0, None, None, 0.0, None, -1.0]
    unit = values(spark, "array<float>", [[3.0, 4.0], [0.0, 0.0], None], vectors.unit_vector)
    assert unit[0] == pytest.approx([0.6, 0.8]) and unit[1:] == [None, None]


def test_embedder(spark):
    model = embed.HashedWords(32)
    got = values(spark, "string", ["big sky", None, "big sky"], lambda c: embed.embed(c, model))
    assert got[1] is None and got[0] == got[2]
    assert got[0] == pytest.approx(embed.embed_one("big sky", model), abs=1e-6)
    assert sum(x * x for x in got[0]) == pytest.approx(1.0, abs=1e-5)


# Words and stems of the published sample vocabulary.
STEMS = """
consign consign consigned consign consigning consign consignment consign consistency consist consistently consist
consolation consol consolatory consolatori consolidating consolid consolingly consol consonant conson conspicuous conspicu
conspiracy conspiraci conspirators conspir constables constabl constancy constanc knackeries knackeri knavish knavish
kneaded knead kneeled kneel knife knife knightly knight knitted knit knives knive knocker knocker knots knot
happy happi sky sky generate generat generously generous communism communism gas gas kiwis kiwi agreed agre feed feed
relational relat rational ration valency valenc digitizer digit radically radic differently differ decisiveness decis
sensibility sensibl triplicate triplic electricity electr goodness good allowance allow airliner airlin replacement replac
adoption adopt controlling control songs song reviews review ties tie cries cri rhythmic rhythmic
""".split()


def test_stems(spark):
    cases = dict(zip(STEMS[::2], STEMS[1::2]))
    check(spark, "string", {**cases, "café": "café", "of": "of", None: None}, stem.stem)
