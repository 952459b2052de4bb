import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id bigint, text string, lang string, source string, id string, key bigint, size int, hash int, row int, target int"


@pytest.fixture(scope="session")
def make(spark):
    """Frames with columns that could clash with helper columns."""

    def frame(rows):
        full = [(k, t, "en", "s", "x", 1, 2, 3, 4, 5) if len(r) == 2 else (*r, "x", 1, 2, 3, 4, 5) for r in rows for k, t in [r[:2]]]
        return spark.createDataFrame(full, SCHEMA)

    return frame


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    return [
        (0, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), (1, None), (2, ""), (3, " \t\n\r"),
        (4, long), (5, "same text"), (5, "same text"), (6, "same  text "), (7, "same\ttext"), (None, "same text"),
        (None, None), (8, "é日本 😀 x"), (9, "a"), (10, long + " end"), (11, "word"), (11, "other word here"),
    ]


@pytest.fixture(scope="session")
def sample_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return [(r.doc_id, r.text) for r in docs.collect()]
