"""Quality by supervised subword embeddings.

A text is the mean of learned vectors: one for each of its words, each character
n-gram of its words and each pair of neighbouring words, all hashed to a fixed
number of buckets; a pair of equal words has a vector of its own.  A softmax layer
turns the mean into class shares.  Vectors and layer are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled texts
(``ROWS`` of each label) that excludes held-out rows, with the classes drawn in the
proportion of the labels.

With two classes the softmax of a mean is a logistic function of the mean of one
number per bucket.  Scoring therefore sends each task a table of ``BUCKETS`` floats
(1 MB, whatever the input) in place of the vectors.

Defined results: a null or empty text has no features and gets the share of its
class among the labels.  Without labels every score is 1.  Ids that repeat are
scored each; a null id is not held out; an empty table gives an empty result.  Only
id and text are read for scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import arrow
from .labelled import held_out, sample

ROWS = 1_500  # labelled texts of each label, at most
BITS = 18
BUCKETS = 1 << BITS
DIMS = 12
NGRAMS = (3, 4, 5)
EPOCHS = 6
RATE = 0.5
PREDICT_FROM = 0.3

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
SAME_PAIR = 0
PIECE_CHARS = 1 << 18


def _bucket(values: np.ndarray, salt: int) -> np.ndarray:
    return ((values + np.uint64(salt)) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _BASE, np.uint64)]), dtype=np.uint64)


_POWERS = _powers(64)


def features(text: str):
    """Buckets of a text's words, pairs and n-grams, in parts of a long text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    points[blank] = 32
    low, before = 0, None
    spots = np.flatnonzero(blank)
    while low < len(points):
        # A part ends at a blank, however long its last word is.
        at = np.searchsorted(spots, low + PIECE_CHARS)
        high = int(spots[at]) if at < len(spots) else len(points)
        found, words = _part(np.concatenate([[np.uint64(32)], points[low:high], [np.uint64(32)]]))
        yield found
        if len(words):
            if before is not None:
                yield _pairs(np.array([before, words[0]], np.uint64))
            before = words[-1]
        low = high


def _pairs(words: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbouring words, from the words' hashes."""
    pairs = _bucket(words[:-1] * _BASE + words[1:], 202)
    pairs[words[1:] == words[:-1]] = SAME_PAIR
    return pairs


def _part(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a part that starts and ends with a blank, and the hashes of its words.

    Blanks at both ends of a word belong to its n-grams, blanks inside do not.
    """
    inside, place = points != 32, np.arange(len(points))
    found, words = [], np.zeros(0, np.uint64)
    for n in NGRAMS:
        size = max(0, len(points) - n + 1)
        valid = np.ones(size, bool)
        for k in range(1, n - 1):
            valid &= inside[k : k + size]
        at = np.flatnonzero(valid)
        value = np.zeros(len(at), np.uint64)
        for k in range(n):
            value = value * _BASE + points[at + k]
        found.append(_bucket(value, n))
    first = inside & ~np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(first)
    if len(starts):
        spots = place - np.maximum.accumulate(np.where(first, place, 0))
        weighed = np.where(inside, points * _POWERS[np.minimum(spots, 63)], np.uint64(0))
        words = np.add.reduceat(weighed, starts)
        found.append(_bucket(words, 101))
        found.append(_pairs(words))
    return np.concatenate(found), words


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    parts = list(features(text))
    buckets = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    which, n = np.unique(buckets, return_counts=True)
    return which, (n / max(1, len(buckets))).astype(np.float32)


def train(texts: list[str], labels: list[int], share: float | None = None, seed: int = 5) -> dict:
    """Numbers per bucket and an offset.  ``share``: of label 1 among all labels."""
    share = share if share is not None else (sum(labels) / len(labels) if labels else 1.0)
    share = min(max(share, 1e-6), 1 - 1e-6) if labels else 1.0
    base = float(np.log(share / (1 - share))) if labels else 50.0
    if len(set(labels)) < 2:
        return {"table": np.zeros(BUCKETS, np.float32), "offset": base, "empty": base}
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIMS), np.float32) - 0.5) / DIMS).astype(np.float32)
    layer, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
    rows = [_counted(t) for t in texts]
    by_label = [[i for i, y in enumerate(labels) if y == v and len(rows[i][0])] for v in (0, 1)]
    steps = EPOCHS * len(texts)
    for step in range(steps):
        own = by_label[step % 2]
        if not own:
            continue
        i = own[int(rng.integers(len(own)))]
        which, weights = rows[i]
        hidden = weights @ vectors[which]
        logits = hidden @ layer + bias
        shares = np.exp(logits - logits.max())
        error = shares / shares.sum()
        error[labels[i]] -= 1
        rate = np.float32(RATE * (1 - step / steps))
        back = layer @ error
        layer -= rate * np.outer(hidden, error)
        bias -= rate * error
        vectors[which] -= (rate * len(which) ** 0.5) * np.outer(weights, back)
    side = layer[:, 1] - layer[:, 0]
    # Training drew the classes in turn; the offset returns to the labels' own shares.
    return {"table": vectors @ side, "offset": float(bias[1] - bias[0]) + base, "empty": base}


def logit(model: dict, text: str) -> float:
    total, n = 0.0, 0
    for buckets in features(text):
        total += float(model["table"][buckets].sum(dtype=np.float64))
        n += len(buckets)
    return total / n + model["offset"] if n else model["empty"]


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``score``, ``predicted``."""
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out")
    )
    schema = StructType([
        StructField(id_col, narrow.schema["id"].dataType), StructField("held_out", BooleanType()),
        StructField("score", DoubleType()), StructField("predicted", IntegerType()),
    ])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        own = sent.value
        for batch in batches:
            x = np.array([logit(own, t or "") for t in batch.column(1).to_pylist()])
            shares = 1 / (1 + np.exp(-x))
            yield {
                id_col: batch.column(0), "held_out": batch.column(2), "score": pa.array(shares),
                "predicted": pa.array((shares >= PREDICT_FROM).astype(np.int32)),
            }

    return arrow(narrow, task, schema)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, **names: str) -> DataFrame:
    """Train on at most ``rows`` labelled rows of each label that are not held out, score every row."""
    id_col = names.get("id_col", "doc_id")
    texts, own = sample(docs, labels, label, rows, **names)
    usable = labels.where(~held_out(F.col(id_col)) & F.col(label).isin(0, 1))
    share = usable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return score(docs, train(texts, own, share), **names)
