"""Resampling towards a target distribution."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import importance


def _features(text):
    lowered = (text or "").encode().translate(importance.LOWER)
    own = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return own, own + [a + b" " + b for a, b in zip(own, own[1:])]


def _brute(rows, target, min_words=20, percent=25):
    bucket = lambda f: zlib.crc32(f) % importance.BUCKETS
    s = Counter(bucket(f) for _, t in rows for f in _features(t)[1])
    t = Counter(bucket(f) for x in target for f in _features(x)[1])
    n_s, n_t, n = sum(s.values()), sum(t.values()), importance.BUCKETS
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + n) / ((s[b] + 1) * (n_t + n)))) for b in range(n)}
    out = []
    for key, text in rows:
        own, found = _features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(own)])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(able[: percent * len(able) // 100])]
    return drawn, [tuple(r[:4]) for r in out]


@pytest.mark.parametrize("reach", [(1 << 22, 1 << 20), (7, 50), (64, 1)])
def test_features(monkeypatch, reach):
    """Any text, also in parts, gives the checksums of its features."""
    monkeypatch.setattr(importance, "PART", reach[0])
    monkeypatch.setattr(importance, "GROUP", reach[1])
    rng = random.Random(5)
    texts = [b"", b"Hello World", b" ..x.. y", b"a" * 1000 + b" b " + b"c" * 129, "é日本 😀 x a-b_c\0d".encode()]
    texts += ["".join(rng.choice("aB .é9-\n") for _ in range(rng.randint(0, 300))).encode() for _ in range(60)]
    got = [[] for _ in texts]
    for _, at, found in importance.features(texts, 10_000):
        for i, b in zip(at.tolist(), found.tolist()):
            got[i].append(b)
    for text, own in zip(texts, got):
        assert sorted(own) == sorted(zlib.crc32(f) % 10_000 for f in _features(text.decode())[1])


def test_checksums_of_long_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts, ends = np.array([0, 3, 70, 200, 900]), np.array([1, 67, 199, 841, 5000])
    got = importance.checksums(data, starts, ends).tolist()
    assert got == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


def _check(rows, target, found):
    drawn, all_rows = _brute(rows, target)
    got = [tuple(r) for r in found.collect()]
    assert Counter(r[:4] for r in got) == Counter(all_rows)
    assert sorted((r for r in got if r[4] is not None), key=lambda r: r[4]) == drawn


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, make, sample_rows, parts):
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    _check(sample_rows, target, importance.importance(make(sample_rows).repartition(parts), frame))


def test_odd_rows(spark, make, odd):
    target = ["alpha beta", None, "", "w1x1 w2x2"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    _check(odd, target, importance.importance(make(odd), frame))


def test_ties_go_to_smaller_ids_and_repeats_count(spark, make):
    words = " ".join(f"t{i}" for i in range(30))
    rows = [(k % 7, words) for k in range(400)]
    target = spark.createDataFrame([(words,)], "text string")
    _check(rows, [words], importance.importance(make(rows).repartition(4), target))


def test_empty_tables(spark, make, sample_rows):
    none = spark.createDataFrame([], "text string")
    assert importance.importance(make([]), none).collect() == []
    _check(sample_rows[:40], [], importance.importance(make(sample_rows[:40]), none))


def test_drawn_rows_keep_their_columns(spark, make, sample_rows):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = make(sample_rows).withColumnsRenamed({"hash": "score", "row": "rank", "size": "weight"})
    drawn, _ = _brute(sample_rows, [r.text for r in target.collect()])
    got = importance.resample(docs, target)
    assert got.columns == docs.columns
    texts = dict(sample_rows)
    assert sorted((r.doc_id, r.text, r["rank"]) for r in got.collect()) == sorted((k, texts[k], 4) for k, *_ in drawn)
