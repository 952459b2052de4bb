"""Mixing sources to target weights."""

from collections import defaultdict

import pytest

from tapeloom.llm import mixing


def _targets(sizes: dict, weights=(1, 2, 3), passes=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(passes * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: passes * sizes[s] if s in full else rest * weight[s] / share for s in order}
        above = {s for s in order if target[s] > passes * sizes[s]}
        if not above:
            return target
        full |= above


def _rows(sources):
    rows, key = [], 0
    for source, n, words in sources:
        for i in range(n):
            rows.append((key, " ".join(["w"] * (words + i % 5)), "en", source))
            key += 1
    return rows


SOURCES = [("b", 400, 20), ("a", 300, 3), ("é", 50, 10), (None, 40, 7), ("c", 2, 1), ("d", 1, 0), ("Z", 900, 12)]


@pytest.mark.parametrize("parts", [1, 6])
def test_targets_and_takes(make, parts):
    rows = _rows(SOURCES)
    got = mixing.mix(make(rows).repartition(parts)).collect()
    assert len(got) == len(rows)
    sizes, takes = defaultdict(int), defaultdict(int)
    by_id = {r.doc_id: r for r in got}
    for key, text, _, source in rows:
        r = by_id[key]
        assert r.size == len(text.split()) and 0 <= r.taken <= 3 * r.size
        sizes[source] += r.size
        takes[source] += r.taken
    want = _targets(sizes)
    for key, _, _, source in rows:
        assert by_id[key].source_size == sizes[source]
        assert by_id[key].target == pytest.approx(want[source], rel=1e-12)
    longest = {s: words + 4 for s, _, words in SOURCES}
    assert all(abs(takes[s] - want[s]) <= longest[s] for s in sizes)


def test_reruns_agree_on_any_layout(make):
    rows = _rows(SOURCES)
    one = sorted((r.doc_id, r.taken) for r in mixing.mix(make(rows).repartition(1)).collect())
    two = sorted((r.doc_id, r.taken) for r in mixing.mix(make(rows[::-1]).repartition(9)).collect())
    assert one == two


def test_larger_budgets_keep_what_smaller_ones_took(make):
    rows = _rows([("a", 500, 9), ("b", 500, 9)])
    low = {r.doc_id for r in mixing.mix(make(rows), weights=(1, 3)).collect() if r.taken and r.doc_id < 500}
    high = {r.doc_id for r in mixing.mix(make(rows), weights=(2, 3)).collect() if r.taken and r.doc_id < 500}
    assert low < high


def test_odd_rows(make, odd):
    got = mixing.mix(make(odd)).collect()
    assert len(got) == len(odd)
    same = [r.taken for r in got if r.doc_id == 5]
    assert len(set(same)) == 1
    assert mixing.mix(make([])).count() == 0
    only_empty = mixing.mix(make([(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in only_empty] == [(0, 0.0, 0)] * 2


def test_mixed_rows_repeat_whole_rows(make):
    rows = _rows(SOURCES)
    df = make(rows)
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {k: n for k, n in copies.items() if n}
    assert mixing.mixed_rows(make([])).count() == 0
