"""Repeated passages by induced sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import induced_sort, suffix_dedup


def _brute(rows, depth):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    out = []
    for (key, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if count[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        pieces = sum(1 for i, m in enumerate(gone) if m and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, m in zip(t, gone) if not m)
        out.append((str(key), len(t), sum(gone), pieces, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def _got(frame):
    return sorted((str(r[0]), *r[1:]) for r in frame.collect())


def _common(a, b, depth):
    n = 0
    while n < min(len(a), len(b), depth) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(8))
def test_suffix_order(monkeypatch, seed):
    """Order, common prefixes and repeats of random strings, with queues that spill all the time."""
    rng = random.Random(seed)
    for _ in range(40):
        letters = rng.choice(["ab", "abc", "a", "abcdefgh é", "\0a"])
        own = ["".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([3, 10, 40])))).encode() for _ in range(rng.randint(1, 7))]
        own += [own[0], own[0] + own[-1] + own[0]]
        monkeypatch.setattr(induced_sort, "BATCH", rng.choice([1, 2, 5, 1 << 20]))
        depth, limit = rng.choice([2, 5, 12]), rng.choice([1, 3, 10, 1000])
        s, before, places = induced_sort.Strings(own, depth), None, []
        for batch in induced_sort.suffix_order(s, limit):
            for place, common in batch.tolist():
                suffix = own[s.owner[place]][place - s.starts[s.owner[place]] :]
                assert before is None or (before >= suffix and common == _common(before, suffix, depth))
                before = suffix
                places.append(place)
        assert sorted(places) == np.flatnonzero(s.data).tolist()
        counts = np.array([rng.choice([1, 1, 2]) for _ in own], np.int64)
        total = Counter()
        for text, n in zip(own, counts.tolist()):
            for i in range(len(text) - depth + 1):
                total[text[i : i + depth]] += n
        want = {(j, i) for j, t in enumerate(own) for i in range(len(t) - depth + 1) if total[t[i : i + depth]] > 1}
        found = zip(*[x.tolist() for x in induced_sort.repeated(own, counts, depth, limit)])
        assert {(j, i) for j, first, last in found for i in range(first, last + 1)} == want


@pytest.mark.parametrize("gram", [3, 8])
def test_anchors_of_equal_windows_are_equal(gram):
    rng = random.Random(gram)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))).encode() for _ in range(50)]
    seen, covered = {}, set()
    for number, first, last, key in suffix_dedup.text_anchors(texts, 12, gram):
        for j, a, b, k in zip(number.tolist(), first.tolist(), last.tolist(), key.tolist()):
            for i in range(a, b + 1):
                assert (j, i) not in covered
                covered.add((j, i))
                assert seen.setdefault(texts[j][i : i + 12], k) == k
    assert covered == {(j, i) for j, t in enumerate(texts) for i in range(len(t) - 11)}


@pytest.mark.parametrize("options", [{}, {"hot": 2, "tuples": 50}, {"shard_bytes": 2000, "gram": 64}])
def test_sample_against_brute_force(make, sample_rows, options):
    got = suffix_dedup.repeats_digest(make(sample_rows).repartition(5), **options)
    assert _got(got) == _brute(sample_rows, 200)


def test_odd_rows(make, odd):
    assert _got(suffix_dedup.repeats_digest(make(odd))) == _brute(odd, 200)
    assert suffix_dedup.repeats_digest(make([])).collect() == []


@pytest.mark.parametrize("hot", [2, 1000])
def test_small_depth_finds_overlaps_and_cuts_characters(make, hot):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("aé ") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(90, "x" * 50), (91, "yz" * 20), (92, None), (93, "ab" * 3)]
    got = suffix_dedup.repeats_digest(make(rows).repartition(3), depth=9, gram=4, hot=hot, tuples=20)
    assert _got(got) == _brute(rows, 9)


def test_blocks_of_a_long_text(monkeypatch, make):
    monkeypatch.setattr(suffix_dedup, "GROUP", 700)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = [(1, long), (2, "q" + long[1234:2500]), (3, long[:250]), (4, long[4700:] + long[4699:4950])]
    found = {}
    texts = [t.encode() for _, t in rows]
    for number, first, last, key in suffix_dedup.text_anchors(texts, 200, 40):
        for j, a, b, k in zip(number.tolist(), first.tolist(), last.tolist(), key.tolist()):
            for i in range(a, b + 1):
                assert found.setdefault(texts[j][i : i + 200], k) == k
    assert _got(suffix_dedup.repeats_digest(make(rows))) == _brute(rows, 200)


def test_one_passage_in_many_texts(make):
    """A passage between different texts makes hot anchors; every copy of it goes, and nothing else."""
    rng = random.Random(4)
    word = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = word(60)
    rows = [(i, f"{word(40)} {passage} {word(40)}") for i in range(120)]
    got = suffix_dedup.repeats_digest(make(rows).repartition(6), hot=20)
    assert _got(got) == _brute(rows, 200)


def test_rows_keep_their_columns(make):
    rows = [(1, "k" * 30), (2, "abc" * 10), (3, None)]
    docs = make(rows).withColumnsRenamed({"hash": "h1", "row": "kept"})
    found = suffix_dedup.drop_repeats(docs, depth=20, gram=5).collect()
    assert {r["row"]["doc_id"]: bytes(r["kept"]) for r in found} == {1: b"", 2: b"", 3: b""}
    assert {r["row"]["h1"] for r in found} == {3} and {r["row"]["kept"] for r in found} == {4}
