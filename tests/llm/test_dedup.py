"""Exact and near duplicates."""

import random

import brute
import numpy as np
import pytest

from tapeloom.llm import exact_dedup, graph, simhash


@pytest.fixture(scope="module")
def rows(odd, sample_rows):
    return [*odd, *[(k + 5000, t) for k, t in sample_rows]]


def _exact(frame, **limits):
    got = exact_dedup.exact_groups(frame, **limits).collect()
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got), got


@pytest.mark.parametrize("limits", [{}, {"table_bytes": 5_000, "bucket_bytes": 20_000}], ids=["one level", "spilling"])
def test_exact_against_brute_force(make, rows, limits):
    mine, got = _exact(make(rows), **limits)
    assert mine == sorted((str(k), str(keep), n, sha) for k, keep, n, sha in brute.exact(rows))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_a_frozen_table_knows_old_contents_and_takes_no_new_ones():
    table = exact_dedup.ContentTable(max_bytes=300)
    assert table.find(1, b"a" * 60) == (0, True)
    assert table.find(1 + 1024, b"b" * 60) == (1, True)  # same slot, other content
    assert table.find(1, b"c") == (-1, False)
    assert table.find(1, b"a" * 60) == (0, False)


def test_equal_hashes_do_not_make_equal_contents():
    table = exact_dedup.ContentTable(1 << 20)
    numbers = [table.find(7, str(i).encode())[0] for i in range(3_000)]
    assert numbers == list(range(3_000))


def test_drop_copies_keeps_whole_rows(make, rows):
    df = make(rows)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    want = {(k, sha) for k, sha in {(keep, sha) for _, keep, _, sha in brute.exact(rows)}}
    assert kept.count() == len(want)
    texts = {}
    for k, t in rows:
        texts.setdefault(str(k), set()).add(t)
    assert all(r.text in texts[str(r.doc_id)] and r.target == 5 for r in kept.collect())


def test_hot_group_sends_one_row_per_task_to_the_shuffle(spark, make):
    df = make([(i, "the same") for i in range(3_000)] + [(i, f"other {i}") for i in range(3_000, 4_000)]).repartition(8)
    local, _ = exact_dedup.groups(df.select("doc_id", "text"))
    assert local.where("hash is not null").count() <= 1_000 + 8


def _near(frame, **kw):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_groups(frame, **kw).collect())


def _cases(rows):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(600)) for _ in range(20)]
    edits = []
    for i, text in enumerate(base * 4):
        own = text.split()
        own[rng.randrange(len(own))] = "edited"
        edits.append((20_000 + i, " ".join(own)))
    return [*rows, *[(10_000 + i, t) for i, t in enumerate(base)], *edits, *[(30_000 + i, t) for i, t in enumerate(base)]]


def test_near_against_brute_force(make, rows):
    cases = _cases(rows)
    want = sorted((str(k), fp, str(c)) for k, fp, c in brute.near(cases))
    assert len({c for _, _, c in want}) < len({fp for _, fp, _ in want})  # some fingerprints do link
    assert _near(make(cases)) == want


@pytest.mark.parametrize("shards", [1, 2, 40])
def test_shards_do_not_change_the_links(spark, shards, monkeypatch):
    rng = np.random.default_rng(shards)
    centers = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [c ^ np.uint64(1 << int(rng.integers(63))) ^ np.uint64(1 << int(rng.integers(63))) for c in centers for _ in range(4)]
    fps = np.unique(np.concatenate([centers, np.array(flips, np.uint64), rng.integers(0, 2**63, 1500, dtype=np.uint64)]))
    monkeypatch.setattr(simhash, "SPREAD_ROWS", max(1, len(fps) // shards))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    links = simhash.fingerprint_links(df, 2, shard_rows=max(1, -(-len(fps) // shards)))
    roots = {r.node: r.root for r in graph.components(links, "a", "b").collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    labels = np.arange(len(fps))
    while True:
        new = np.where(near, labels[None, :], len(fps)).min(axis=1)
        if (new == labels).all():
            break
        labels = new
    groups = {}
    for i, label in enumerate(labels):
        groups.setdefault(label, set()).add(int(fps[i]))
    want = {min(g): g for g in groups.values() if len(g) > 1}
    got = {}
    for node, root in roots.items():
        got.setdefault(root, set()).add(node)
    assert got == want


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {r.root for r in graph.components(df, "a", "b").collect()} == {0}


def test_drop_near_copies(make, rows):
    cases = _cases(rows)
    df = make(cases)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    mine = sorted(str(r.doc_id) for r in kept.collect())
    want = brute.near(cases)
    assert len(mine) == len(_components(want))
    assert set(mine) == {str(c) for _, _, c in want}


def _components(found):
    """Components told apart by id and the smallest fingerprint they reach, as ids may repeat."""
    return {c for _, _, c in found} | {("again", c) for c in _shared(found)}


def _shared(found):
    fps = {}
    for _, fp, c in found:
        fps.setdefault(c, set()).add(int(fp, 16))
    out = []
    for c, own in fps.items():
        own, groups = list(own), []
        while own:
            group, todo = set(), [own.pop()]
            while todo:
                x = todo.pop()
                group.add(x)
                close = [y for y in own if (x ^ y).bit_count() <= 2]
                own = [y for y in own if y not in close]
                todo += close
            groups.append(group)
        out += [(c, i) for i in range(1, len(groups))]
    return out


def test_empty_tables(make):
    assert exact_dedup.exact_groups(make([])).count() == 0
    assert exact_dedup.drop_copies(make([])).count() == 0
    assert simhash.near_groups(make([])).count() == 0
    assert simhash.drop_near_copies(make([])).count() == 0
