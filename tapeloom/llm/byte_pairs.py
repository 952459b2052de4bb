"""Byte-pair ids of many short words at once, with the merges of a public vocabulary.

All words of a batch are one array of symbols.  A step looks up the rank of each pair
of neighbours, takes the best rank of each piece and merges its pairs, so the number of
steps is that of the longest word's merges and not of all words.
"""

from __future__ import annotations

import json

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"  # without the apostrophe, which can begin a contraction
# Words whose pieces are runs of letters, digits or marks, and single line ends between them.
SIMPLE = rf"(?:[{LETTERS}]+|[0-9]+|[{MARKS}]+)+(?:\n(?:[{LETTERS}]+|[0-9]+|[{MARKS}]+)+)*"
NONE = np.int64(1) << 40
BLANK = 0


def _classes() -> np.ndarray:
    kinds = np.full(256, 1)  # letters, and the bytes of those beyond ASCII
    for b in range(128):
        kinds[b] = 2 if chr(b).isdigit() else 1 if chr(b).isalpha() else 3
    kinds[10], kinds[32] = 4, BLANK
    return kinds


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class Merges:
    """Ranks and results of pairs, in an open-addressing table of arrays."""

    def __init__(self, path: str):
        with open(path) as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        results = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.mask = (1 << max(4, (4 * len(keys)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, NONE)  # the rank above the 20 bits of the result
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            slot, first = np.unique(at[left], return_index=True)
            free = self.keys[slot] < 0
            won = left[first[free]]
            self.keys[slot[free]] = keys[won]
            self.values[slot[free]] = won << 20 | results[won]
            left = np.setdiff1d(left, won)
            at[left] = (at[left] + 1) & self.mask
        self.kinds = _classes()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & self.mask

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """Rank and result of each pair, ``NONE`` if it does not merge."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def ids(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word behind a blank; words must match ``SIMPLE``."""
        raw = np.frombuffer((" " + " ".join(words)).encode(), np.uint8)
        kind = self.kinds[raw]
        after = np.append(kind[1:], BLANK)
        ends = (after == BLANK) | ((kind != after) & (kind != BLANK))
        symbols, final = self.of_byte[raw], np.zeros(len(raw), np.int64)
        piece = np.cumsum(ends) - ends
        word = np.cumsum(kind == BLANK) - 1
        place = np.arange(len(raw))
        alive = np.ones(len(raw), bool)
        while len(symbols) > 1:
            # A pair within one piece, or nothing.
            value = np.full(len(symbols), NONE)
            inside = np.flatnonzero(piece[:-1] == piece[1:])
            value[inside] = self._found(symbols[inside] << 32 | symbols[inside + 1])
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            best = np.repeat(np.minimum.reduceat(value, first), np.diff(first, append=len(piece)))
            merge = (value == best) & (best < NONE)
            # Of overlapping pairs, as in a run of one symbol, every other one from the left.
            spots = np.flatnonzero(merge)
            run = np.maximum.accumulate(np.where(np.diff(spots, prepend=-2) != 1, spots, 0))
            spots = spots[(spots - run) % 2 == 0]
            symbols[spots] = value[spots] & ((1 << 20) - 1)
            gone = np.zeros(len(symbols), bool)
            gone[spots + 1] = True
            alive[place[gone]] = False
            done = best >= NONE
            final[place[done]] = symbols[done]
            stay = ~done & ~gone
            symbols, piece, place = symbols[stay], piece[stay], place[stay]
        final[place] = symbols
        ids, word = final[alive].astype("<u4").tobytes(), word[alive]
        cuts = [*(4 * np.flatnonzero(np.diff(word, prepend=-1))).tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]
