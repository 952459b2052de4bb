"""Quality rules."""

import random

import brute
import pytest

from tapeloom.llm import quality_rules


@pytest.fixture(scope="module")
def rows(odd, sample_rows):
    texts = ["a b c d e " * 30, "x y\nx y\n\n \nx y", "# $ % | < > & *", "one two three four five six seven eight nine ten",
             "p q r s t u p q r s t v w x y z a b c d e f g h i j k l m n o"]
    return [*odd, *enumerate(texts, 100), *[(k + 5000, t) for k, t in sample_rows]]


def test_base_rules_against_brute_force(make, rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality_rules.judge(make(rows)).collect()
    mine = sorted((str(r.doc_id), *[r[n] for n in names]) for r in got)
    assert mine == sorted((str(k), *brute.base_quality(t).values()) for k, t in rows)
    assert all(not (r.base_failed and r.kept) for r in got)


def test_other_language_and_symbols_are_rejected(make):
    rng = random.Random(3)
    usual = ["the", "of", "and", "to", "in", "house", "garden", "river", "walks", "sees", "green", "old"]
    clean = [(k, " ".join(rng.choice(usual) for _ in range(300)), "en", "s") for k in range(30)]
    noise = (99, " ".join(f"%%{chr(97 + i % 26)}{i}$$##" for i in range(300)), "en", "s")
    got = {r.doc_id: r for r in quality_rules.judge(make([*clean, noise])).collect()}
    assert got[99].chars_distance > quality_rules.CHARS_LIMIT and not got[99].kept
    assert all(got[k].chars_distance < quality_rules.CHARS_LIMIT for k in range(30))
    assert all(got[k].common_distance < quality_rules.COMMON_LIMIT for k in range(30))


def test_distance_bounds(spark):
    from pyspark.sql import functions as F

    df = spark.sql("select array(1D, 0D) as p, array(0D, 1D) as q, array(0.5D, 0.5D) as h")
    row = df.select(
        quality_rules.distance(F.col("p"), F.col("q")).alias("far"),
        quality_rules.distance(F.col("h"), F.col("h")).alias("same"),
        quality_rules.distance(F.col("p"), F.col("h")).alias("half"),
    ).first()
    assert (row.far, row.same) == (1.0, 0.0)
    assert row.half == pytest.approx(0.5579230452841438)


def test_keep_good_agrees_with_judge(make, rows):
    df = make(rows)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    want = sorted(str(r.doc_id) for r in quality_rules.judge(df).where("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_short_and_null_language(make):
    got = quality_rules.judge(make([(1, "too short", None, None), (2, None, None, None)])).collect()
    assert all(r.base_failed and r.chars_distance is None for r in got)


def test_empty_table(make):
    assert quality_rules.judge(make([])).count() == 0
    assert quality_rules.keep_good(make([])).count() == 0


def test_no_python(make, plan_of):
    plan = plan_of(quality_rules.judge(make([(1, "a b c")])))
    assert "Python" not in plan and "Arrow" not in plan
