"""Exact duplicates by Grace hashing: partition by hash, then compare whole texts in a table that fits.

1. Each task of the scan runs its rows through an open-addressing table and
   passes on one representative per distinct content it saw, so a group of
   copies that holds a third of all rows reaches the shuffle as one row per task.
2. Representatives are dealt to buckets by a hash of their content.  A bucket's
   table takes new contents up to a byte limit; then it is frozen.  Contents
   that are not in a frozen table go to the next level as a spill table in the
   shared folder, are dealt out anew by another hash, and so on until
   nothing spills.
3. Rows learn their group through the number of their representative.  No text
   takes part in that join.

A content is the text without white space.  Hashes only choose a bucket and a
slot; two contents are equal when all of their bytes are.

Defined results: a null text counts as empty, and all empty texts are one group.
The row with the most code points in its original text stays, then the smallest
id, a null id last, then the row read first; so of fully repeated rows exactly
one stays.  An empty table gives an empty result.  Other columns are not looked
at, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import to_scratch
from .common import arrow, empty_as_bytes, slices

BUCKET_BYTES = 16 << 20  # aim for the contents of a bucket
TABLE_BYTES = 32 << 20  # a table takes no new content beyond this
BLANKS = b" \t\n\x0b\x0c\r"


class ContentTable:
    """Open addressing with linear probing; compares complete contents."""

    def __init__(self, max_bytes: int):
        self.max_bytes = max_bytes
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for number, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number

    def find(self, h: int, content: bytes) -> tuple[int, bool]:
        """Number of the content and whether it is new; -1 if it is neither known nor can be taken."""
        mask = len(self.slots) - 1
        at = h & mask
        while (number := int(self.slots[at])) >= 0:
            if self.hashes[number] == h and self.contents[number] == content:
                return number, False
            at = (at + 1) & mask
        if self.bytes >= self.max_bytes:
            return -1, False
        number = len(self.contents)
        self.slots[at] = number
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return number, True


def _better(a: tuple, b: tuple) -> bool:
    """Order of rows ``(n_chars, id, task, row)``: longer, smaller id (null last), read first."""
    return (-a[0], a[1] is None, a[1] if a[1] is not None else 0, a[2:]) < (
        -b[0], b[1] is None, b[1] if b[1] is not None else 0, b[2:],
    )


def _long(name: str) -> StructField:
    return StructField(name, LongType())


def _local_groups(docs: DataFrame, id_col: str, text_col: str, table_bytes: int) -> DataFrame:
    """Every row as ``(task, row, rep)``, and a row with its whole content for each representative.

    Names of the input's columns live inside ``whole`` and cannot clash.
    """
    id_type = docs.schema[id_col].dataType
    whole = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    schema = StructType([
        _long("task"), _long("row"), _long("rep"), StructField("id", id_type), _long("n_chars"),
        _long("hash"), StructField("sha", StringType()), _long("members"), _long("bytes"), StructField("whole", whole),
    ])
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)

    def task(batches):
        me, rows, reps = TaskContext.get().partitionId(), 0, 0
        table, found = ContentTable(table_bytes), []

        def flush():
            out = {f.name: [] for f in schema}
            for number, (best, count, columns) in enumerate(found):
                values = {
                    "task": me, "row": best[3], "rep": reps + number, "id": best[1], "n_chars": best[0],
                    "hash": table.hashes[number] - (1 << 63), "members": count, "bytes": len(table.contents[number]),
                    "sha": hashlib.sha256(table.contents[number]).hexdigest(),
                    "whole": {f"c{i}": v for i, v in enumerate(columns)},
                }
                for name, value in values.items():
                    out[name].append(value)
                if len(out["task"]) == 500:
                    yield out
                    out = {f.name: [] for f in schema}
            yield out

        for batch in slices(batches):
            ids = batch.column(id_at).to_pylist()
            texts = empty_as_bytes(batch.column(text_at))
            out = {f.name: [None] * len(ids) for f in schema}
            for i, (key, text) in enumerate(zip(ids, texts)):
                content = text.translate(None, BLANKS)
                h = xxhash.xxh64_intdigest(content)
                number, new = table.find(h, content)
                if number < 0:
                    yield from flush()
                    reps += len(found)
                    table.clear()
                    found = []
                    number, new = table.find(h, content)
                row = (len(text.decode()), key, me, rows)
                if new:
                    found.append((row, 1, [c[i].as_py() for c in batch.columns]))
                else:
                    best, count, columns = found[number]
                    if _better(row, best):
                        best, columns = row, [c[i].as_py() for c in batch.columns]
                    found[number] = (best, count + 1, columns)
                out["task"][i], out["row"][i], out["rep"][i] = me, rows, reps + number
                out["id"][i], out["n_chars"][i] = key, row[0]
                rows += 1
            yield out
        yield from flush()

    return arrow(docs, task, schema)


def _merge(reps: DataFrame, text_field: str, table_bytes: int, carry: bool) -> DataFrame:
    """Groups of equal contents within each partition.

    ``level`` 0 rows carry the group of a representative; with ``carry``, one of
    them has the row that stays in ``whole``.  ``level`` 1 rows are spilled
    representatives.
    """
    schema = StructType([
        *reps.schema, StructField("keep_id", reps.schema["id"].dataType), _long("keep_task"), _long("keep_row"),
        _long("group_size"), _long("level"),
    ])
    names = [f.name for f in schema]

    def task(batches):
        table, groups, members, shas, kept = ContentTable(table_bytes), [], [], [], {}
        for batch in slices(batches):
            spilled = []
            for row in batch.to_pylist():
                content = (row["whole"][text_field] or "").encode().translate(None, BLANKS)
                number, new = table.find(row["hash"] + (1 << 63), content)
                if number < 0:
                    spilled.append({**row, "level": 1})
                    continue
                key = (row["n_chars"], row["id"], row["task"], row["row"])
                if new:
                    groups.append([key, 0])
                    shas.append(row["sha"])
                elif _better(key, groups[number][0]):
                    groups[number][0] = key
                if carry and groups[number][0] == key:
                    kept[number] = row["whole"]
                groups[number][1] += row["members"]
                members.append((number, row["task"], row["rep"]))
            yield {n: [r.get(n) for r in spilled] for n in names}
        for low in range(0, len(members), 1000):
            out = {n: [] for n in names}
            for number, at, rep in members[low : low + 1000]:
                (n_chars, key, keep_task, keep_row), size = groups[number]
                # The representative whose own row stays carries the row.
                values = {
                    "task": at, "rep": rep, "sha": shas[number], "keep_id": key, "keep_task": keep_task,
                    "keep_row": keep_row, "group_size": size, "level": 0, "n_chars": n_chars,
                    "whole": kept.pop(number) if at == keep_task and number in kept else None,
                }
                for n in names:
                    out[n].append(values.get(n))
            yield out

    return arrow(reps, task, schema)


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES, table_bytes: int = TABLE_BYTES, carry: bool = False,
) -> tuple[DataFrame, list[DataFrame]]:
    """All rows with their representative, and the solved levels of representatives."""
    spark = docs.sparkSession
    local = to_scratch(_local_groups(docs, id_col, text_col, table_bytes), "exact-local")
    text_field = f"c{docs.columns.index(text_col)}"
    open_reps, solved, level = local.where(F.col("hash").isNotNull()), [], 0
    while True:
        size = open_reps.agg(F.sum("bytes")).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // bucket_bytes + 1)
        dealt = open_reps.repartition(buckets, F.xxhash64("hash", F.lit(level)))
        merged = to_scratch(_merge(dealt, text_field, table_bytes, carry), "exact-level")
        solved.append(merged.where("level = 0"))
        open_reps = merged.where("level = 1").select(*local.columns)
        if open_reps.isEmpty():
            return local, solved
        level += 1


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.union(frame)
    return whole


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    local, solved = groups(narrow, "id", "text", **limits)
    found = _union(solved).select("task", "rep", "sha", "keep_id", "keep_task", "keep_row", "group_size")
    rows = local.where(F.col("hash").isNull()).select("task", "row", "rep", "id")
    kept = (F.col("task") == F.col("keep_task")) & (F.col("row") == F.col("keep_row"))
    return rows.join(found, ["task", "rep"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows that stay, with all their columns."""
    _, solved = groups(docs, id_col, text_col, carry=True, **limits)
    rows = _union(solved).where(F.col("whole").isNotNull())
    return rows.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)])
