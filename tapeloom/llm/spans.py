"""Places of all matches of a pattern in a text, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NEAR = 48  # code points of context on each side
RUN = 256  # finished spans are moved in runs, so that appending costs little

SPAN = "struct<hit:string,before:string,after:string,start:bigint,end:bigint>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<hit, before, after, start, end>>``.

    ``start`` and ``end`` count code points, the end exclusive.  ``before`` and
    ``after`` are up to ``NEAR`` code points between this match and its
    neighbours.  The matches are cut out by the pattern and the pieces between
    them by a split on it; places are running sums of both lengths.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    rows = F.zip_with(hits, F.slice(pieces, 1, F.size(hits)), lambda h, p: F.struct(h.alias("hit"), p.alias("piece")))
    rows = F.zip_with(
        rows, F.slice(pieces, 2, F.size(hits)), lambda r, p: F.struct(r["hit"], r["piece"], F.left(p, F.lit(NEAR)).alias("after"))
    )
    empty = F.array().cast(f"array<{SPAN}>")
    begin = F.struct(
        F.lit(0).cast("bigint").alias("at"), empty.alias("run"), F.array().cast(f"array<array<{SPAN}>>").alias("done")
    )

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["piece"])
        end = start + F.length(row["hit"])
        span = F.struct(
            row["hit"].alias("hit"), F.right(row["piece"], F.lit(NEAR)).alias("before"), row["after"].alias("after"),
            start.alias("start"), end.alias("end"),
        )
        full = F.size(acc["run"]) >= RUN
        return F.struct(
            end.alias("at"),
            F.when(full, F.array(span)).otherwise(F.concat(acc["run"], F.array(span))).cast(f"array<{SPAN}>").alias("run"),
            F.when(full, F.concat(acc["done"], F.array(acc["run"]))).otherwise(acc["done"]).alias("done"),
        )

    placed = F.aggregate(rows, begin, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["run"]))))
    return F.when(text.rlike(pattern), placed).otherwise(empty)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    each = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(each, ",")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
