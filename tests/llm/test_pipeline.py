"""The corpus pipeline, stage by stage."""

from collections import Counter

import brute
import corpus_pipeline
import pytest

from tapeloom.llm import mixing, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage."""
    home, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(home / name)
        stage(spark, docs, SF).write.parquet(path)
        found = spark.read.parquet(path)
        out[name] = (docs, found)
        docs = found
    return out


def test_all_but_the_last_keep_the_columns(stages):
    for name, (docs, found) in list(stages.items())[:-1]:
        assert found.columns == docs.columns, name


def test_quality(stages):
    docs, found = stages["quality_rules"]
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert sorted(r.doc_id for r in found.collect()) == sorted(kept)
    failed = {r.doc_id for r in docs.collect() if brute.base_quality(r.text)["base_failed"]}
    assert not failed & kept


def test_exact(stages):
    docs, found = stages["exact_dedup"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in found.collect()) == sorted({keep for _, keep, _, _ in brute.exact(rows)})


def test_near(stages):
    docs, found = stages["simhash_near_dedup"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in found.collect()) == sorted({c for _, _, c in brute.near(rows)})


def test_mix(stages):
    docs, found = stages["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in found.collect()) == Counter(copies)


def test_pack(stages):
    docs, found = stages["packing"]
    rows = found.collect()
    first = Counter(r.doc_id for r in rows if r.piece == 0)
    assert first == Counter(r.doc_id for r in docs.collect())
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_run_gives_the_rows_of_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    _, found = stages["packing"]
    assert Counter(map(key, corpus_pipeline.run(spark, SF).collect())) == Counter(map(key, found.collect()))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_empty_input(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_helper_names_do_not_clash(spark):
    """Columns named like helper columns come through every filtering stage unchanged."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["_q_words", "_q_result", "_m_size", "_m_hash", "_m_no", "_n_id", "_n_key", "n_id", "n_key", "row", "id", "key", "source_size"]
    wide = docs.selectExpr("*", *[f"doc_id * 10 + {i} AS `{n}`" for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, wide, SF)
        assert found.columns == wide.columns, name
        rows = found.collect()
        assert rows and all(r[n] == r.doc_id * 10 + i for r in rows for i, n in enumerate(names)), name
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stage(spark, docs, SF).collect()), name
