"""Token counts under a unigram vocabulary, without building the tokens.

The pieces of a public vocabulary file and their scores are taken as a unigram
model.  An Aho-Corasick automaton lists the vocabulary's matches by their end;
dynamic programming carries, for each end, the best score and the number of
pieces of the path that has it.  Ties go as in the tokenizer: a path replaces
another only if its score is strictly greater, and candidates for an end come by
growing start, so the longest last piece wins.  A character that is no piece
costs ten less than the worst piece, is tried after all pieces, and counts its
UTF-8 bytes.

No piece holds a word mark behind another character, so the best path of a text
is that of its words, and counts of words are kept in a bounded cache.
A text that holds the mark itself is taken whole.

Defined results: a null or empty text has 0 tokens.  Repeated rows are counted
each; a null id stays null; an empty table gives an empty result.  Only id and
text are read.
"""

from __future__ import annotations

import re

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import arrow

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_COST = 10.0
CACHED_WORDS = 500_000


class Unigram:
    _kept: dict[str, "Unigram"] = {}

    def __init__(self, vocabulary: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.values()) - UNKNOWN_COST
        self.single = {p for p in vocabulary if len(p) == 1}
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in vocabulary)
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> "Unigram":
        if path not in cls._kept:
            cls._kept[path] = cls(read_vocabulary(path))
        return cls._kept[path]

    def best(self, marked: str) -> int:
        """Pieces of the best path through a text whose blanks are marks."""
        score, count = [0.0] + [None] * len(marked), [0] * (len(marked) + 1)
        ends: dict[int, list] = {}
        for end, match in self.automaton.iter(marked):
            ends.setdefault(end, []).append(match)
        for end, character in enumerate(marked):
            top, n = None, 0
            # The automaton gives the longest match first, that is, the smallest start.
            for length, value in ends.get(end, ()):
                if (total := score[end + 1 - length] + value) is not None and (top is None or total > top):
                    top, n = total, count[end + 1 - length] + 1
            if character not in self.single:
                total = score[end] + self.unknown
                if top is None or total > top:
                    top, n = total, count[end] + len(character.encode("utf-8", "surrogatepass"))
            score[end + 1], count[end + 1] = top, n
        return count[-1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits or MARK in text:
            return self.best(MARK + text.replace(" ", MARK))
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [w[1:] for w in re.findall(r" *[^ ]+| +", " " + text)]
        else:
            words = text.split(" ")
        known, total = self.known, 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.best(MARK + word.replace(" ", MARK))
                if len(known) >= CACHED_WORDS:
                    known.clear()
                if len(word) <= 64:
                    known[word] = n
            total += n
        return total


def read_vocabulary(path: str) -> dict[str, float]:
    """Pieces that match text, with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = (model.is_unknown, model.is_control, model.is_byte, model.is_unused)
    plain = [i for i in range(model.get_piece_size()) if not any(f(i) for f in skip)]
    return {model.id_to_piece(i): model.get_score(i) for i in plain}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id, n_tokens)`` for each row."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_t_text"))
    schema = StructType([narrow.schema[id_col], StructField("n_tokens", LongType())])

    def task(batches):
        model = Unigram.of(path)
        for batch in batches:
            counts = [model.count(t or "") for t in batch.column(1).to_pylist()]
            yield {id_col: batch.column(0), "n_tokens": pa.array(counts, pa.int64())}

    return arrow(narrow, task, schema)
