"""Toxicity and the quality model: held-out accuracy and odd rows."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import labelled, quality_model, toxicity
from tapeloom.llm.labelled import sample

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def _held_out(found, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    rows = found.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    return [(truth[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in truth], rows


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    held, rows = _held_out(toxicity.score_toxicity(docs, labels), labels, "toxic")
    toxic = [p for y, p, _ in held if y == 1]
    clean = [p for y, p, _ in held if y == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    held, rows = _held_out(quality_model.score_quality(docs, labels), labels, "quality")
    good = [p for y, p, _ in held if y == 1]
    poor = [p for y, p, _ in held if y == 0]
    assert np.mean(good) > 0.99 and np.mean(poor) < 0.1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_sample_leaves_held_out_rows_and_repeats(tables):
    docs, labels = tables
    texts, own = sample(docs, labels, "toxic", 100)
    assert own.count(1) <= 100 and own.count(0) <= 100 and len(texts) == len(own) > 150
    held = {r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    other = {r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert all(t in other or t not in held for t in texts)
    assert sample(docs.repartition(5), labels.repartition(3), "toxic", 100) == (texts, own)


def test_folding():
    assert toxicity.fold("ІDІ0T, $tup1d! ｍоrοn 5cum$$$").split() == ["idiot", "stupid", "moron", "scum"]
    assert toxicity.fold("").split() == []


def test_phrases_excuse_entries_inside_them():
    automaton = toxicity.build({"trash": 3.0, "idiot": 2.0}, ["trash can"])
    match = lambda text: sorted(toxicity.matched(automaton, toxicity.fold(text)))
    assert match("the trash can") == []
    assert match("trash can idiots trash") == [2.0, 3.0]
    assert match("trash cannot") == [3.0]
    assert match("xtrash") == []


def test_lexicon_is_learned_with_its_exceptions():
    toxic = [f"plain words zorb{x} here {i}" for i, x in enumerate(["a", "be", "cu"] * 20)]
    clean = [f"plain words zorbling here {i}" for i in range(60)]
    weights, excused = toxicity.learn_lexicon(toxic + clean, [1] * 60 + [0] * 60)
    assert any(w.startswith("zorb") for w in weights) and "zorbling" in excused
    model = toxicity.train(toxic + clean, [1] * 60 + [0] * 60)
    automaton = toxicity.build(model["weights"], model["phrases"])
    assert toxicity.matched(automaton, toxicity.fold(clean[0])) == []
    assert toxicity.matched(automaton, toxicity.fold(toxic[0]))


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality_model.score_quality])
@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, make, odd, score, labelled):
    rows = [(0, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None), (0, 1, 0)] if labelled else []
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    got = score(make(odd), labels).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert score(make([]), labels).count() == 0


def test_features_do_not_depend_on_where_a_long_text_is_cut(monkeypatch):
    text = " ".join(f"word{i % 50}" for i in range(4_000))
    whole = np.sort(np.concatenate(list(quality_model.features(text))))
    monkeypatch.setattr(quality_model, "PIECE_CHARS", 1_000)
    parts = list(quality_model.features(text))
    assert len(parts) > 10
    # Nothing is missing or added, not even a pair across a cut.
    assert (np.sort(np.concatenate(parts)) == whole).all()


def test_equal_pairs_share_a_vector():
    found = np.concatenate(list(quality_model.features("ab ab cd cd")))
    assert (found == quality_model.SAME_PAIR).sum() >= 2


def _plain_matches(model, folded):
    """Weights at word starts outside of exception phrases, without an automaton."""
    own = {i for i, c in enumerate(folded) if c == " "}
    entries, excused = {}, []
    for start in own:
        for stem, weight in model["weights"].items():
            if folded.startswith(stem, start + 1) and (start not in entries or weight > entries[start][1]):
                entries[start] = (start + len(stem), weight)
        excused += [(start, start + len(p) + 1) for p in model["phrases"] if folded.startswith(p + " ", start + 1)]
    return [w for start, (end, w) in entries.items() if not any(a <= start and end <= b for a, b in excused)]


def test_toxicity_scores_equal_a_plain_scorer(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(*labelled.sample(docs, labels, "toxic", 2_500))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    for row in docs.collect():
        folded = toxicity.fold(row.text or "")
        weights = _plain_matches(model, folded)
        x = sum(weights) / (1 + math.log2(1 + len(folded.split()) / 200) / 4) if weights else 0.0
        want = 1 / (1 + math.exp(-(model["slope"] * x + model["offset"])))
        found = got[row.doc_id]
        assert math.isclose(found.score, want, abs_tol=1e-9) and found.n_matches == len(weights)
        assert found.predicted == int(want >= 0.5)


def _plain_features(text):
    """Words, n-grams and pairs of a text, one by one."""
    mask = 2**64 - 1
    bucket = lambda v, salt: ((v + salt & mask) * 0x9E3779B97F4A7C15 & mask) >> (64 - quality_model.BITS)
    own, out, hashes = [w for w in re.split("[\\x20\\x09-\\x0D]+", text) if w], [], []
    for word in own:
        padded = [32, *map(ord, word), 32]
        for n in quality_model.NGRAMS:
            for i in range(len(padded) - n + 1):
                value = 0
                for c in padded[i : i + n]:
                    value = value * 0x100000001B3 + c & mask
                out.append(bucket(value, n))
        hashes.append(sum(ord(c) * pow(0x100000001B3, min(i, 63), 2**64) for i, c in enumerate(word)) & mask)
        out.append(bucket(hashes[-1], 101))
    for a, b in zip(hashes, hashes[1:]):
        out.append(quality_model.SAME_PAIR if a == b else bucket(a * 0x100000001B3 + b & mask, 202))
    return sorted(out)


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_quality_features_equal_plain_ones(monkeypatch, piece):
    """Also where a long text is read in parts: no pair is lost and no word is split."""
    monkeypatch.setattr(quality_model, "PIECE_CHARS", piece)
    texts = ["", " ", "a", "a b", "aa aa  b\n c", "é日本 😀 x " * 3, "one two three four " * 4, "x" * 100 + " y " + "z" * 70]
    for text in texts:
        parts = [x for part in quality_model.features(text) for x in part.tolist()]
        assert sorted(parts) == _plain_features(text), text


def test_quality_scores_equal_a_plain_scorer(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    usable = labels.where(~labelled.held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    share = usable.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    model = quality_model.train(*labelled.sample(docs, labels, "quality", 1_500), share)
    got = {r.doc_id: r.score for r in quality_model.score_quality(docs, labels).collect()}
    for row in docs.limit(40).collect():
        found = _plain_features(row.text or "")
        x = sum(float(model["table"][b]) for b in found) / len(found) + model["offset"] if found else model["empty"]
        assert math.isclose(got[row.doc_id], 1 / (1 + math.exp(-x)), abs_tol=1e-6)
