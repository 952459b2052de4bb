"""Suffix order of many short strings by induced sorting, with common prefixes, in bulk array steps.

The strings are laid end to end, each followed by a mark smaller than any byte.  A
suffix is of type L if it is larger than the one that begins a byte later, else S; an
S suffix behind an L suffix is a seed.

1. Seeds are sorted by recursion: the stretches from seed to seed get names in their
   order, and the strings of names are sorted by their first 2, 4, 8, ... names until
   no two that differ share a rank.
2. L suffixes are induced in ascending order, then S suffixes in descending order.
   The next suffixes come from a priority queue of tuples ``(place, common prefix with
   the entry before)``.  Its order is first the byte and then the time of entry, and
   everything that is at the head is taken at once: entries of one byte that are there
   already are in order, and what they induce for the same byte comes after them.
3. The common prefix of two induced suffixes is one more than the least common prefix
   between their sources, which a table of minima over the sources' batch answers.
   Only the first entry of a batch for a byte is compared by its bytes.

The queue keeps tuples in memory up to a limit and then appends them to an unnamed
temporary file of the task, one run for each write, as Spark's own sorts spill.  Such a
file belongs to one attempt of one task and vanishes with it.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict, deque

import numpy as np

TUPLE = np.dtype([("place", np.int64), ("common", np.int64)])
END = 0  # the mark behind each string; bytes are stored one higher
BATCH = 1 << 20  # tuples that are taken from the queue at once


class SpillQueue:
    """Tuples by byte, each byte's in order of entry; what exceeds the limit lies on disk."""

    def __init__(self, limit: int):
        self.limit, self.held, self.file = limit, 0, None
        self.runs: dict[int, deque] = defaultdict(deque)

    def push(self, byte: int, entries: np.ndarray) -> None:
        self.runs[byte].append(entries)
        self.held += len(entries)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for byte, runs in self.runs.items():
            held = [r for r in runs if isinstance(r, np.ndarray)]
            if held:
                # Runs in memory are always the youngest ones of their byte.
                for _ in held:
                    runs.pop()
                runs.append((self.file.seek(0, 2), sum(map(len, held))))
                for run in held:
                    self.file.write(run.tobytes())
        self.held = 0

    def _read(self, run: tuple[int, int] | np.ndarray) -> np.ndarray:
        if isinstance(run, np.ndarray):
            self.held -= len(run)
            return run
        self.file.seek(run[0])
        return np.frombuffer(self.file.read(run[1] * TUPLE.itemsize), TUPLE)

    def take(self, byte: int, last: bool = False) -> np.ndarray | None:
        """The oldest tuples of a byte in their order, or its youngest ones; None if there are none."""
        runs, parts, size = self.runs[byte], [], 0
        while runs and size < BATCH:
            run = runs.pop() if last else runs.popleft()
            if isinstance(run, tuple) and run[1] > BATCH:
                at, n = run
                if last:
                    runs.append((at, n - BATCH))
                    run = (at + (n - BATCH) * TUPLE.itemsize, BATCH)
                else:
                    runs.appendleft((at + BATCH * TUPLE.itemsize, n - BATCH))
                    run = (at, BATCH)
            parts.append(self._read(run))
            size += len(parts[-1])
        return np.concatenate(parts[::-1] if last else parts) if parts else None


class Strings:
    """Strings laid end to end, with types, and what is needed to compare them."""

    def __init__(self, strings: list[bytes], depth: int):
        self.depth = depth
        lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.stops = self.starts + lengths  # where the marks stand
        n = int(len(strings) + lengths.sum())
        self.padded = np.zeros(n + depth + 16, np.uint8)
        self.data = self.padded[:n]
        raw = np.frombuffer(b"\0".join(strings), np.uint8)
        self.data[: len(raw)] = raw
        self.data += 1
        self.data[self.stops] = END
        self.owner = np.repeat(np.arange(len(strings), dtype=np.int32), lengths + 1)
        # The type of a run of equal bytes is decided where the run ends.
        differs = np.flatnonzero(self.data[:-1] != self.data[1:])
        ends = np.append(differs, n - 1)
        falls = np.append(self.data[differs] > self.data[differs + 1], False)
        self.is_l = np.repeat(falls, np.diff(ends, prepend=-1))
        self.is_l[self.stops] = False
        self.seed = np.zeros(n, bool)
        self.seed[1:] = ~self.is_l[1:] & self.is_l[:-1]
        self.seed[self.stops] = True
        self.words = np.ndarray((len(self.padded) - 7,), "<u8", self.padded.data, strides=(1,))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, at most ``depth``."""
        most = np.minimum(self.stops[self.owner[a]] - a, self.stops[self.owner[b]] - b)
        most = np.minimum(most, self.depth)
        found, differs = np.zeros(len(a), np.int64), np.zeros(len(a), np.uint64)
        open_ = np.flatnonzero(most > 0)
        while len(open_):
            at = found[open_]
            x = self.words[a[open_] + at] ^ self.words[b[open_] + at]
            same = x == 0
            differs[open_[~same]] = x[~same]
            open_ = open_[same]
            found[open_] += 8
            open_ = open_[found[open_] < most[open_]]
        # The lowest bit set lies in the first byte that differs.
        some = np.flatnonzero(differs)
        low = differs[some] & (~differs[some] + np.uint64(1))
        found[some] += (np.frexp(low.astype(np.float64))[1] - 1) // 8
        return np.minimum(found, most)


def _refine(ranks: np.ndarray, members: np.ndarray, order: np.ndarray, keys: np.ndarray) -> None:
    """Split groups of equal rank by ``keys``, in place.

    ``members`` holds whole groups and ``order`` sorts it by rank and key.  A rank is the
    place of its group's first member among all, so other groups' ranks stay valid.
    """
    r, k = ranks[members][order], keys[order]
    new_rank = np.diff(r, prepend=-1) != 0
    new = new_rank | (np.diff(k, prepend=k[:1]) != 0)
    spots = np.arange(len(order))
    group = np.maximum.accumulate(np.where(new_rank, spots, 0))
    ranks[members[order]] = r + np.maximum.accumulate(np.where(new, spots, 0)) - group


def seed_order(s: Strings) -> np.ndarray:
    """Places of the seeds that are not marks, in the order of their suffixes."""
    places = np.flatnonzero(s.seed)
    n, is_mark = len(places), s.data[places] == END
    stop, inner = np.flatnonzero(is_mark), np.flatnonzero(~is_mark)
    # A stretch reaches to the next seed and includes its first byte; eight bytes at a time, filled up with the largest.
    length = np.append(np.diff(places), 0) + 1
    ranks = np.full(n, len(inner))
    ranks[inner] = 0
    low, open_ = 0, inner
    while len(open_):
        left = np.clip(length[open_] - low, 0, 8)
        word = s.words[places[open_] + np.minimum(low, length[open_])].byteswap()
        word |= np.where(left < 8, np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * left % 64).astype(np.uint64), np.uint64(0))
        order = np.lexsort((word, ranks[open_])) if low else np.argsort(word)
        _refine(ranks, open_, order, word)
        low += 8
        # Ranks that several stretches share, one of them longer, stay open.
        size = np.bincount(ranks, minlength=n + 1)
        longer = np.zeros(n + 1, bool)
        longer[ranks[inner[length[inner] > low]]] = True
        open_ = inner[(size[ranks[inner]] > 1) & longer[ranks[inner]]]
    # The ranks are names, and the strings of names are sorted the same way; behind a mark there is nothing.
    ranks[stop] = -1
    step = 1
    until = np.repeat(stop, np.diff(stop, prepend=-1)) - np.arange(n)  # names before the mark
    while True:
        size = np.bincount(ranks[inner], minlength=n + 1)
        open_ = inner[size[ranks[inner]] > 1]
        if not len(open_) or step > int(until.max()):
            break
        ahead = np.where(until[open_] > step, ranks[np.minimum(open_ + step, n - 1)] + 1, 0)
        keys = (ranks[open_] * (n + 2) + ahead).astype(np.int64)
        _refine(ranks, open_, np.argsort(keys), ahead)
        if np.count_nonzero(np.bincount(ranks[open_])) == np.count_nonzero(size > 1):
            break
        step *= 2
    return places[inner[np.argsort(ranks[inner], kind="stable")]]


class _Minima:
    """Least values of ranges of one array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each ``values[low:high]``, which is not empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - 2**k])
        return out


def _induce(s: Strings, sources: np.ndarray, queue: SpillQueue, last: dict[int, int], wanted: bool) -> None:
    """Pushes the suffixes one byte before a batch of sources, if they are of the wanted type."""
    before = sources["place"] - 1
    fits = np.flatnonzero(before >= 0)
    before = before[fits]
    ok = (s.is_l[before] == wanted) & (s.data[before] != END)
    fits, before = fits[ok], before[ok]
    if not len(before):
        return
    byte = s.data[before]
    order = np.argsort(byte, kind="stable")
    byte, before, source = byte[order], before[order], fits[order]
    first = np.flatnonzero(np.diff(byte.astype(np.int16), prepend=-1))
    common = np.empty(len(before), np.int64)
    inner = np.ones(len(before), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    if len(inner):
        minima = _Minima(np.minimum(sources["common"], s.depth).astype(np.int16))
        common[inner] = np.minimum(1 + minima.least(source[inner - 1] + 1, source[inner] + 1).astype(np.int64), s.depth)
    heads = byte[first].tolist()
    known = np.array([last.get(b, -1) for b in heads], np.int64)
    common[first] = 0
    met = np.flatnonzero(known >= 0)
    if len(met):
        common[first[met]] = s.common(known[met], before[first[met]])
    entries = np.empty(len(before), TUPLE)
    entries["place"], entries["common"] = before, common
    stops = np.append(first[1:], len(before))
    for b, low, high in zip(heads, first.tolist(), stops.tolist()):
        queue.push(b, entries[low:high].copy())
        last[b] = int(before[high - 1])


def suffix_order(s: Strings, limit: int):
    """Batches of tuples in descending suffix order; ``common`` is with the suffix before, at most ``depth``.

    Common prefixes end where a string ends.  Suffixes that are equal up to their
    strings' ends come in any order.  A queue holds ``limit`` tuples in memory.
    """
    seeds = seed_order(s)
    entries = np.zeros(len(seeds), TUPLE)
    entries["place"] = seeds
    for low in range(1, len(seeds), BATCH):
        high = min(low + BATCH, len(seeds))
        entries["common"][low:high] = s.common(seeds[low - 1 : high - 1], seeds[low:high])
    by_byte = np.searchsorted(s.data[seeds], np.arange(257))

    # Ascending: L suffixes from marks, L suffixes and seeds.
    larger, kept, last = SpillQueue(limit), SpillQueue(limit), {}
    marks = np.zeros(len(s.stops), TUPLE)
    marks["place"] = s.stops
    for low in range(0, len(marks), BATCH):
        _induce(s, marks[low : low + BATCH], larger, last, True)
    for byte in range(1, 256):
        while (batch := larger.take(byte)) is not None:
            kept.push(byte, batch)
            _induce(s, batch, larger, last, True)
        own = entries[by_byte[byte] : by_byte[byte + 1]]
        for low in range(0, len(own), BATCH):
            _induce(s, own[low : low + BATCH], larger, last, True)
    del entries, seeds, marks

    # Descending: S suffixes from S and L suffixes.
    smaller, last = SpillQueue(limit), {}
    for byte in range(255, 0, -1):
        before = None
        while (batch := smaller.take(byte)) is not None:
            _induce(s, batch, smaller, last, False)
            before = batch["place"][-1:]
            yield batch
        own_common = 0  # of the L suffix last handed out with the next smaller one
        while (batch := kept.take(byte, last=True)) is not None:
            turned = np.empty(len(batch), TUPLE)
            turned["place"] = batch["place"][::-1]
            turned["common"][1:] = batch["common"][:0:-1]
            turned["common"][0] = own_common if before is None else s.common(before, turned["place"][:1])[0]
            own_common, before = int(batch["common"][0]), None
            _induce(s, turned, smaller, last, False)
            yield turned


def repeated(strings: list[bytes], weights: np.ndarray, depth: int, limit: int = 1 << 22):
    """``(string, first, last)``: runs of places where a text of ``depth`` bytes begins that occurs twice or more.

    A string counts ``weights`` times.  Places are counted from the string's start.
    """
    s = Strings(strings, depth)
    found = np.zeros(len(s.data), bool)
    waiting, sum_before = -1, 0  # the open group: its only place as long as it counts once, and its count
    for batch in suffix_order(s, limit):
        places = batch["place"]
        group = np.cumsum(batch["common"] < depth)
        count = np.bincount(group, weights=weights[s.owner[places]])
        count[0] += sum_before
        found[places[count[group] >= 2]] = True
        if waiting >= 0 and group[0] == 0 and count[0] >= 2:
            found[waiting] = True
        sum_before = min(int(count[-1]), 2)
        waiting = int(places[-1]) if sum_before < 2 else -1
    at = np.flatnonzero(found)
    at = at[s.stops[s.owner[at]] - at >= depth]
    owner = s.owner[at].astype(np.int64)
    new = (np.diff(at, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0)
    first = np.flatnonzero(new)
    final = np.append(first, len(at))[1:] - 1
    base = s.starts[owner[first]]
    return owner[first], at[first] - base, at[final] - base
