"""Token counts and packing."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer, models

from tapeloom.llm import packing, token_counts


@pytest.fixture(scope="module")
def rows(odd, sample_rows):
    return [*odd, *[(k + 5000, t) for k, t in sample_rows]]


@pytest.fixture(scope="module")
def unigram():
    vocabulary = token_counts.read_vocabulary(public_tokenizers.path(token_counts.VOCABULARY))
    as_bytes = [(f"<0x{b:02X}>", -1e12) for b in range(256)]
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.items(), *as_bytes], 0, True))
    # The library takes its unknown score from the worst entry, bytes included, so known text is compared with
    # a second one that has no bytes.
    plain = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.items()], 0, False))
    return token_counts.Unigram(vocabulary), library, plain


def test_counts_equal_the_tokenizer_on_words(unigram, sample_rows):
    mine, _, plain = unigram
    words = sorted({w for _, t in sample_rows for w in t.split()})
    known = [w for w in words if all(c in mine.single for c in w)]
    assert len(known) > 5_000
    assert [mine.count(w) for w in known] == [len(plain.encode("▁" + w).ids) for w in known]


@given(st.text(alphabet="abe ▁\nthéü.,", max_size=40))
@settings(max_examples=200, deadline=None)
def test_counts_equal_the_tokenizer_on_any_text(unigram, text):
    mine, _, plain = unigram
    marked, got = "▁" + text.replace(" ", "▁"), mine.count(text)
    assert got == (mine.best(marked) if text else 0)  # words apart and the whole text agree
    if text and all(c in mine.single for c in marked):
        assert got == len(plain.encode(marked).ids)


def test_unknown_characters_count_their_bytes(unigram):
    mine, library, _ = unigram
    for text in ("\U0001f9ff", "a\U0001f9ffb", "\U0001f9ff\U0001f9ff x"):
        assert mine.count(text) == len(library.encode("▁" + text.replace(" ", "▁")).ids)


def test_the_longest_last_piece_wins_a_tie():
    model = token_counts.Unigram({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -2.0, "▁ab": -3.0})
    assert model.best("▁ab") == 1
    assert token_counts.Unigram({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0}).best("▁ab") == 2


def test_count_query(make, rows):
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(make(rows)).collect())
    model = token_counts.Unigram.of(public_tokenizers.path(token_counts.VOCABULARY))
    want = sorted((str(k), model.best("▁" + t.replace(" ", "▁")) if t else 0) for k, t in rows)
    assert got == want
    assert token_counts.count_tokens(make([])).count() == 0


BLANKS = ["", " ", "  ", "a\n\n b", "a   b", "a \nb", "a\n  b", "\n \n", " a", "   a", "a ", "a\n ", "it's 's", "x\x1c y", "　 x",
          "a b", "<|endoftext|> b", "a\t\t b", "\r\n x \r\n"]


def test_cached_units_equal_the_tokenizer(sample_rows):
    tokens = packing.Tokens(public_tokenizers.path(packing.TOKENIZER))
    texts = BLANKS + [t for _, t in sample_rows[:60]]
    want = [np.array(tokens.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokens.ids(texts) == want
    assert tokens.ids(texts) == want  # from the cache


@given(st.text(alphabet="ab 1\n\t.'s ", max_size=30))
@settings(max_examples=200, deadline=None)
def test_cached_units_equal_the_tokenizer_on_blanks(text):
    tokens = packing.Tokens.of(public_tokenizers.path(packing.TOKENIZER))
    want = np.array(tokens.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert tokens.ids([text]) == [want]


@pytest.mark.parametrize("n", [0, 1, 2, 500, 20_000])
def test_plan_uses_every_length_and_nears_the_bound(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(6.2, 1.0, n).astype(int) + 1, 1, 2048)
    counts = {int(k): int(v) for k, v in Counter(lengths.tolist()).items()}
    plan, used = packing.plan_sequences(counts), Counter()
    for pattern, times in plan:
        assert times > 0 and sum(length * each for length, each in pattern) <= 2048
        for length, each in pattern:
            used[length] += each * times
    assert used == Counter(counts)
    bound = -(-int(lengths.sum()) // 2048)
    assert sum(times for _, times in plan) <= bound * 1.01 + 2


def test_exact_complements_are_found():
    plan = packing.plan_sequences({1000: 3, 1048: 3, 2000: 2, 30: 2, 18: 2, 2048: 1, 1500: 1, 300: 1, 200: 1, 48: 1})
    assert sorted(sum(length * each for length, each in p) for p, n in plan for _ in range(n)) == [2048] * 7


def test_pairs_that_collide_are_passed_over():
    left = packing.Available({24: 1, 12: 1, 20: 1, 16: 1}, 60)
    assert sorted(left.filling(24)) == [16, 20]


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=14))
@settings(max_examples=200, deadline=None)
def test_no_exact_fill_is_left(counts):
    left = packing.Available(counts, 40)
    packing.fill_exactly(left)
    rest = Counter({n: c for n, c in enumerate(left.counts) if c})
    for parts in range(1, 5):
        for some in combinations_with_replacement(sorted(rest), parts):
            assert sum(some) != 40 or any(rest[n] < some.count(n) for n in some)


@given(st.lists(st.text(alphabet="aabcEéüßñÿÀ0123..,,!$#\n_-thingsaaaa|<>", min_size=1, max_size=25), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_merged_units_equal_the_tokenizer(units):
    tokens = packing.Tokens.of(public_tokenizers.path(packing.TOKENIZER))
    simple = [u for u in units if tokens._simple.fullmatch(u)]
    want = [np.array(tokens.library.encode(" " + u, add_special_tokens=False).ids, "<u4").tobytes() for u in simple]
    assert not simple or tokens.merges.ids(simple) == want


def test_cache_generations(monkeypatch, sample_rows):
    monkeypatch.setattr(packing, "CACHED_UNITS", 50)
    tokens = packing.Tokens(public_tokenizers.path(packing.TOKENIZER))
    for _, text in sample_rows[:40]:
        want = np.array(tokens.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert tokens.ids([text]) == [want] and tokens.ids([text]) == [want]


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), max_size=12))
@settings(max_examples=100, deadline=None)
def test_plan_with_a_small_capacity(counts):
    plan, used = packing.plan_sequences(counts, 60), Counter()
    for pattern, times in plan:
        assert sum(length * each for length, each in pattern) <= 60
        for length, each in pattern:
            used[length] += each * times
    assert used == Counter(counts)


def test_packed_rows(make, rows):
    got = packing.pack(make(rows), with_ids=True)
    seen = got.collect()
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    library.encode_special_tokens = True
    want = Counter()
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[key, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in seen) == want
    by_sequence = defaultdict(list)
    for r in seen:
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    whole = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    assert {k: len(v) for k, v in whole.items()} == {k: sum(r.length for r in v) for k, v in by_sequence.items()}
    total = sum(r.length for r in seen)
    assert len(by_sequence) <= -(-total // 2048) * 1.05 + 2


def test_repeated_lengths_get_places_of_their_own(make):
    rng = random.Random(1)
    rows = [(i, "a b c d" if i % 3 else " ".join("xyz" for _ in range(rng.randrange(50)))) for i in range(3_000)]
    got = packing.pack(make(rows).repartition(7)).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) == 3_000


def test_empty_table(make):
    assert packing.pack(make([])).count() == 0
