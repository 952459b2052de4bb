"""Optional search filters on a video's date, type and score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import parse_iso

Range = Sequence  # [low or None, high or None]


def in_range(column: Column, low: Column | None, high: Column | None) -> Column | None:
    """Inclusive range with optional ends; None when both ends are open.

    A null value fails any active range.
    """
    if low is None and high is None:
        return None
    if low is None:
        return column <= high
    if high is None:
        return column >= low
    return column.between(low, high)


@dataclass(frozen=True)
class Filters:
    """Conditions a video must meet; an unset one lets everything through."""

    release_date: Range | None = None
    video_type: Sequence[str] | None = None
    review_score: Range | None = None

    def predicates(self) -> list[Column]:
        found: list[Column | None] = []
        if self.release_date is not None:
            ends = [None if d is None else parse_iso(F.lit(d)) for d in self.release_date]
            found.append(in_range(F.col("publish_date"), *ends))
        if self.video_type:
            found.append(F.col("video_type").isin(*self.video_type))
        if self.review_score is not None:
            ends = [None if s is None else F.lit(s) for s in self.review_score]
            found.append(in_range(F.col("review_score"), *ends))
        return [p for p in found if p is not None]

    def active(self) -> bool:
        return bool(
            (self.release_date is not None and any(d is not None for d in self.release_date))
            or self.video_type
            or (self.review_score is not None and any(s is not None for s in self.review_score))
        )

    def condition(self) -> Column:
        return reduce(lambda a, b: a & b, self.predicates(), F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition()) if self.active() else df
