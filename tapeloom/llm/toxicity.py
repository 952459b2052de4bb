"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps look-alike letters of other scripts and full-width forms to Latin
ones, digits and signs inside words to the letters they stand for, and everything
that is no letter to a blank.  The automaton holds lexicon entries (word stems,
which match at the start of a word) and exception phrases.  A phrase is longer
than the entry it excuses; where one matches, entries inside it do not count.

The score is a logistic function of the sum of weights, normalised by length:
``weight / (1 + log2(1 + words / 200) / 4)``.  Weights of the built-in stems are
fixed; others, their exceptions and the place where the function is 0.5 are learned from a
bounded sample of labelled texts (``ROWS`` of each label).  A stem is learned if it
starts words in many toxic and few clean texts, and is made as long as its words
have in common; a word that is about as common in clean texts is an exception.

Defined results: a null or empty text matches nothing and gets the score of
weight 0.  Without labels the built-in stems stand alone.  Ids that repeat are
scored each; a null id is not held out; an empty table gives an empty result.  Only
id and text are read for scoring.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import arrow
from .labelled import held_out, sample

ROWS = 2_500  # labelled texts of each label, at most
MIN_TOXIC, MIN_TOXIC_SHARE = 8, 0.02  # toxic texts in which a learned stem must occur, and their share
LONGER = 0.9  # a longer stem replaces a shorter one if so much of its toxic texts remain
MAX_CLEAN_SHARE = 0.1  # its clean texts, scaled to equal classes, per toxic text
MIN_CLEAN = 3  # clean texts that make a word an exception
STEM_LENGTHS = range(3, 13)
STEM_WEIGHT = 5.0  # of a built-in stem
WEIGHT = 3.0  # of a learned stem, at most
STEEPNESS = 4.0  # minus the logit of a text without matches

# Built-in stems, phrases that excuse them, and letters that look alike.
STEMS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting"]
PHRASES = ["trash can", "trash bin", "trash bag", "clown fish", "clownfish", "sore loser"]
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a"}


class _Fold(dict):
    """Code point to folded text, worked out once for each code point."""

    def __missing__(self, point: int) -> str:
        character = chr(point)
        if 0xFF01 <= point <= 0xFF5E:
            character = chr(point - 0xFEE0)
        low = character.lower()
        low = LOOKALIKES.get(low, low)
        low = SUBSTITUTES.get(low, low)
        self[point] = low if low.isalpha() or low == "$" else " "
        return self[point]


FOLD = _Fold()
_SIGN = re.compile(r"\$(?=[^\W\d_])")


def fold(text: str) -> str:
    """Folded text between blanks; a dollar sign is an s in front of a letter."""
    folded = text.translate(FOLD)
    if "$" in folded:
        folded = _SIGN.sub("s", folded).replace("$", " ")
    return f" {folded} "


def build(weights: dict[str, float], phrases: list[str]) -> ahocorasick.Automaton:
    """Entries carry their weight, phrases none; both start at the start of a word."""
    automaton = ahocorasick.Automaton()
    for stem, weight in weights.items():
        automaton.add_word(f" {stem}", (len(stem) + 1, weight))
    for phrase in phrases:
        automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
    automaton.make_automaton()
    return automaton


def matched(automaton: ahocorasick.Automaton, folded: str) -> list[float]:
    """Weights of the entries outside of exception phrases, at most one for each word start."""
    entries: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded):
        start = end + 1 - length
        if weight is None:
            excused.append((start, end))
        elif start not in entries or weight > entries[start][1]:
            entries[start] = (end, weight)
    if excused:
        ends: dict[int, int] = {}
        for start, end in excused:
            ends[start] = max(end, ends.get(start, -1))
        reach, kept = -1, []
        for start in sorted({*entries, *ends}):
            reach = max(reach, ends.get(start, -1))
            if start in entries and entries[start][0] > reach:
                kept.append(entries[start][1])
        return kept
    return [weight for _, weight in entries.values()]


def strength(weights: list[float], folded: str) -> float:
    """Sum of the weights, normalised by the words of the folded text."""
    if not weights:
        return 0.0
    words = len(folded.split())
    return sum(weights) / (1 + math.log2(1 + words / 200) / 4)


def learn_lexicon(texts: list[str], labels: list[int]) -> tuple[dict[str, float], list[str]]:
    """Stems with weights and exception words, from the texts in which words and stems occur."""
    words = [set(fold(t).split()) for t in texts]
    n = [max(1, labels.count(v)) for v in (0, 1)]
    by_word = [Counter(), Counter()]
    for own, label in zip(words, labels):
        by_word[label].update(own)
    scale = n[1] / n[0]

    def clean(word: str) -> bool:
        """As common in clean texts as chance would have it, or nearly."""
        return by_word[0][word] >= MIN_CLEAN and by_word[0][word] * scale > MAX_CLEAN_SHARE * by_word[1][word]

    usual = {w for w in by_word[0] if clean(w)}
    by_stem = [Counter(), Counter()]
    for own, label in zip(words, labels):
        rare = own - usual
        by_stem[label].update({w[:k] for w in rare for k in STEM_LENGTHS if len(w) >= k} | rare)
    least = max(MIN_TOXIC, MIN_TOXIC_SHARE * n[1])
    pure = {
        stem: toxic for stem, toxic in by_stem[1].items()
        if toxic >= least and by_stem[0][stem] * scale <= MAX_CLEAN_SHARE * toxic
    }
    found: dict[str, float] = {}
    for stem in sorted(pure, key=lambda s: (len(s), s)):
        longer = [s for s in pure if len(s) == len(stem) + 1 and s.startswith(stem) and pure[s] >= LONGER * pure[stem]]
        if not longer and not any(stem[:k] in found for k in range(1, len(stem))):
            ratio = (pure[stem] + 0.5) / (by_stem[0][stem] * scale + 0.5)
            found[stem] = min(WEIGHT, math.log(ratio))
    return found, sorted(w for w in usual if any(w.startswith(s) for s in found))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic function that is 0.5 where the fewest texts are on the wrong side.

    Classes weigh alike; of equally good places the middle of the widest gap is taken.
    """
    if len(set(y.tolist())) < 2 or len(set(x.tolist())) < 2:
        return STEEPNESS, -STEEPNESS
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    order = np.argsort(x, kind="stable")
    x, signed = x[order], (balance * np.where(y == 1, 1.0, -1.0))[order]
    ends = np.flatnonzero(np.diff(x) > 0)
    errors = np.cumsum(signed)[ends]  # toxic below, less clean below
    best = np.flatnonzero(np.isclose(errors, errors.min()))
    low = ends[best[np.argmax(x[ends[best] + 1] - x[ends[best]])]]
    middle = float(x[low] + x[low + 1]) / 2
    return STEEPNESS / middle, -STEEPNESS


def train(texts: list[str], labels: list[int]) -> dict:
    """The lexicon, its exceptions and the logistic function, as plain values."""
    learned, excused = learn_lexicon(texts, labels) if texts else ({}, [])
    weights = {**learned, **{s: STEM_WEIGHT for s in STEMS}}
    phrases = sorted({*PHRASES, *excused})
    automaton = build(weights, phrases)
    x = [strength(matched(automaton, f), f) for f in map(fold, texts)]
    slope, offset = fit(np.array(x), np.array(labels)) if texts else (STEEPNESS, -STEEPNESS)
    return {"weights": weights, "phrases": phrases, "slope": slope, "offset": offset}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``score``, ``predicted``, and the number and sum of matches."""
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out")
    )
    schema = StructType([
        StructField(id_col, narrow.schema["id"].dataType), StructField("held_out", BooleanType()),
        StructField("score", DoubleType()), StructField("predicted", IntegerType()),
        StructField("n_matches", LongType()), StructField("weight", DoubleType()),
    ])

    def task(batches):
        automaton = build(model["weights"], model["phrases"])
        for batch in batches:
            counts, sums, scores = [], [], []
            for text in batch.column(1).to_pylist():
                folded = fold(text or "")
                weights = matched(automaton, folded)
                x = strength(weights, folded)
                counts.append(len(weights))
                sums.append(float(sum(weights)))
                scores.append(1 / (1 + math.exp(-(model["slope"] * x + model["offset"]))))
            yield {
                id_col: batch.column(0), "held_out": batch.column(2), "score": pa.array(scores, pa.float64()),
                "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                "n_matches": pa.array(counts, pa.int64()), "weight": pa.array(sums, pa.float64()),
            }

    return arrow(narrow, task, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS, **names: str) -> DataFrame:
    """Train on at most ``rows`` labelled rows of each label that are not held out, score every row."""
    return score(docs, train(*sample(docs, labels, label, rows, **names)), **names)
