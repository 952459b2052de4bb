"""Best-fit packing of token sequences, planned on a histogram of lengths.

1. A scan tokenizes each text, appends the end id and cuts texts that are too long
   into pieces.  It writes one narrow row per piece, numbered within its task and
   length.
2. The number of pieces of each length is all that planning needs, at most
   ``capacity`` numbers whatever the input.  ``plan_sequences`` consumes them:
   for a length, longest first, it looks for one, two or three other lengths that
   fill the gap exactly, takes such a combination as often as all of its lengths
   are available, and at last places what remains by best fit.  Work and result are
   bounded by the capacity: a pattern of lengths has a count, not a row per sequence.
3. Each piece finds its place from its length and its number among the pieces of
   that length: the number within its task plus the counts of the tasks before,
   which is a sum over tasks and not over rows.

Defined results: a null text is empty and has the end id alone.  Only texts above
the capacity are cut; their first piece takes the remainder.  Repeated rows are
pieces of their own; a null id stays null.  An empty table gives an empty result.
Only id and text are read, so other columns and their names do not matter.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..session import to_scratch
from .byte_pairs import SIMPLE, Merges
from .common import arrow

CAPACITY = 2048
END_ID = 0
CACHED_UNITS = 300_000  # about 60 MB, and as many of the generation before
CACHED_LENGTH = 64
JOINED_UNITS = 8192
GROUP_CHARS = 1 << 20
TOKENIZER = "byte_bpe_50k.json"


class Tokens:
    """Ids of texts, with a cache of blank-separated units.

    The tokenizer's own first step never joins what a single blank separates, so
    a unit's ids do not depend on its neighbours.  The exception is a run of white
    space that holds a blank before its last character; such texts are given to the
    tokenizer whole.  Units that the cache lacks are merged many at a time
    (``byte_pairs``) or, if they are not of the simple kind, given to the tokenizer.
    The cache has two generations: a full one becomes the older one, whose units
    come back when they are met again.
    """

    _across = re.compile(r"\s (?:\s|\Z)")
    _simple = re.compile(SIMPLE)
    _kept: dict[str, "Tokens"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges = Merges(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.leads: dict[str, bytes] = {}  # of units that start a text

    @classmethod
    def of(cls, path: str) -> "Tokens":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _units(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units that follow a blank."""
        found: dict[str, bytes] = {}
        simple = [u for u in units if self._simple.fullmatch(u)]
        for low in range(0, len(simple), JOINED_UNITS):
            part = simple[low : low + JOINED_UNITS]
            found.update(zip(part, self.merges.ids(part)))
        rest = [u for u in units if u not in found]
        if rest:
            encoded = self.library.encode_batch_fast([" " + u for u in rest], add_special_tokens=False)
            found.update((u, np.array(e.ids, "<u4").tobytes()) for u, e in zip(rest, encoded))
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        if len(self.known) > CACHED_UNITS:
            self.known, self.older = {}, self.known
        get, open_texts, lacking = self.known.get, [], set()
        for i, text in enumerate(texts):
            if self._across.search(text):
                out[i] = self._encode(text).tobytes()
                continue
            units = text.split(" ")
            first = self.leads.get(units[0])
            if first is None:
                first = self._encode(units[0]).tobytes()
                if len(units[0]) <= CACHED_LENGTH and len(self.leads) < CACHED_UNITS // 10:
                    self.leads[units[0]] = first
            found = list(map(get, units[1:]))
            if None in found:
                holes = [k for k, ids in enumerate(found) if ids is None]
                lacking.update([units[k + 1] for k in holes])
                open_texts.append((i, first, units, found, holes))
            else:
                out[i] = first + b"".join(found)
        new = {u: self.older[u] for u in lacking if u in self.older}
        new.update(self._units(sorted(lacking.difference(new))))
        self.known.update((u, ids) for u, ids in new.items() if len(u) <= CACHED_LENGTH)
        for i, first, units, found, holes in open_texts:
            for k in holes:
                found[k] = new[units[k + 1]]
            out[i] = first + b"".join(found)
        return out


def pieces(
    docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """``(id, piece, start, length, crc, task, no)`` for each piece, and ``ids`` if asked for."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([
        narrow.schema["id"], StructField("piece", IntegerType()), StructField("start", LongType()),
        StructField("length", LongType()), StructField("crc", LongType()), StructField("task", LongType()),
        StructField("no", LongType()),
        *([StructField("ids", ArrayType(IntegerType()))] if with_ids else []),
    ])
    end = np.array([END_ID], "<u4").tobytes()

    def task(batches):
        tokens, me, counts = Tokens.of(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            low = 0
            while low < len(texts):
                high, chars = low, 0
                while high < len(texts) and chars < GROUP_CHARS:
                    chars += len(texts[high] or "")
                    high += 1
                out = {f.name: [] for f in schema}
                for key, ids in zip(keys[low:high], tokens.ids([t or "" for t in texts[low:high]])):
                    ids += end
                    total = len(ids) // 4
                    cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        own = ids[4 * a : 4 * b]
                        values = (key, number, a, b - a, zlib.crc32(own), me, counts[b - a])
                        for column, value in zip(out.values(), values):
                            column.append(value)
                        if with_ids:
                            out["ids"].append(np.frombuffer(own, "<u4").astype(np.int32))
                        counts[b - a] += 1
                yield out
                low = high

    return arrow(narrow, task, schema)


class Available:
    """Counts of lengths, with an index of exact sums of one, two and three of them.

    A combination that has run out stays so, as counts only fall; so each
    index entry is passed over once.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity = [0] * (capacity + 1), capacity
        for length, n in counts.items():
            self.counts[length] = n
        self.pair_at: dict[int, int] = {}
        self.triple_at: dict[int, int] = {}

    def has(self, parts: list[int]) -> int:
        """How often all of these lengths can be taken together."""
        return min(self.counts[p] // parts.count(p) for p in parts)

    def pair(self, total: int, taken: list[int]) -> list[int] | None:
        """Two lengths of this sum that can be taken together with those ``taken``, the larger one as large as possible."""
        counts, a = self.counts, self.pair_at.get(total, total - 1)
        while 2 * a >= total and not (counts[a] and counts[total - a]):
            a -= 1
        self.pair_at[total] = a
        # Only pairs that share a length with ``taken`` can fail here, so few are passed over.
        while 2 * a >= total and a:
            if counts[a] and counts[total - a] and self.has([*taken, a, total - a]):
                return [a, total - a]
            a -= 1
        return None

    def triple(self, total: int, long: int) -> list[int] | None:
        """Three lengths of this sum that can be taken together with ``long``."""
        a = self.triple_at.get(total, total - 2)
        while 3 * a >= total and not self.counts[a]:
            a -= 1
        self.triple_at[total] = a
        while 3 * a >= total and a:
            rest = self.pair(total - a, [long, a]) if self.counts[a] else None
            if rest:
                return [a, *rest]
            a -= 1
        return None

    def filling(self, long: int) -> list[int] | None:
        """One, two or three lengths that fill up ``long`` exactly."""
        gap = self.capacity - long
        if gap == 0:
            return []
        if self.has([long, gap]):
            return [gap]
        return self.pair(gap, [long]) or self.triple(gap, long)


def fill_exactly(left: Available) -> list[tuple[list[tuple[int, int]], int]]:
    """Takes full sequences of up to four lengths, longest first, until none is left."""
    plan = []
    for long in range(left.capacity, 0, -1):
        while left.counts[long] and (parts := left.filling(long)) is not None:
            pattern = Counter([long, *parts])
            times = left.has([long, *parts])
            for length, n in pattern.items():
                left.counts[length] -= n * times
            plan.append((sorted(pattern.items(), reverse=True), times))
    return plan


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``([(length, repeats), ...], sequences)`` that use each length as often as it occurs."""
    left = Available(counts, capacity)
    plan = fill_exactly(left)

    # Best fit for the rest, longest first: groups of equal sequences by the gap they leave.
    by_gap: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(pattern: list[tuple[int, int]], gap: int, times: int) -> None:
        if times:
            if not by_gap[gap]:
                bisect.insort(gaps, gap)
            by_gap[gap].append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = left.counts[length]
        while n:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                pattern, times = by_gap[gap].pop()
                if not by_gap[gap]:
                    gaps.pop(at)
            else:
                gap, pattern, times = capacity, [], n
            each = gap // length
            full = min(times, n // each)
            put([*pattern, (length, each)], gap - each * length, full)
            n, times = n - full * each, times - full
            if n and times:
                put([*pattern, (length, n)], gap - n * length, 1)
                n, times = 0, times - 1
            if pattern:
                put(pattern, gap, times)
    return plan + [group for groups in by_gap.values() for group in groups]


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, as runs of their numbers, in order."""
    taken, base, rows = Counter(), 0, []
    for pattern, times in plan:
        offset = 0
        for length, each in pattern:
            rows.append((length, taken[length], base, offset, each))
            taken[length] += each * times
            offset += length * each
        base += times
    rows.sort()
    names = ("length", "first", "sequence", "offset", "each")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """One row per piece with its place: ``sequence_id`` and ``offset``; with the ``ids`` themselves if asked for."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    cut = to_scratch(pieces(docs, id_col, text_col, path, capacity, with_ids), "pieces")
    by_task = to_scratch(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # At most one row for each possible length.
    counts = dict(by_task.groupBy("length").agg(F.sum("n")).collect())
    place = slots(plan_sequences(counts, capacity))
    # Runs of one length are in order of their first number; so are these keys.
    keys = (place["length"] << 44) + place["first"]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # The shifts grow with the number of tasks, so they are merged and never broadcast.
    numbered = cut.join(shifts.hint("merge"), ["task", "length"]).select(
        "id", "piece", "start", "length", "crc", (F.col("no") + F.col("shift")).alias("number"),
        *(["ids"] if with_ids else []),
    )
    schema = StructType([
        StructField(id_col, cut.schema["id"].dataType), *[cut.schema[c] for c in ("piece", "start", "length")],
        StructField("ids_crc32", LongType()), StructField("sequence_id", LongType()), StructField("offset", LongType()),
        *([cut.schema["ids"]] if with_ids else []),
    ])

    def put(batches):
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 44) + number, "right") - 1
            nth = number - place["first"][at]
            values = [
                *[batch.column(i) for i in range(5)],
                pa.array(place["sequence"][at] + nth // place["each"][at]),
                pa.array(place["offset"][at] + nth % place["each"][at] * length),
                *([batch.column(6)] if with_ids else []),
            ]
            yield dict(zip([f.name for f in schema], values))

    return arrow(numbered, put, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` from the pieces with their ids; at most ``capacity`` ids each."""
    part = F.struct("offset", "ids")
    ordered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return ordered.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
