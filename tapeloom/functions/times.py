"""Times without a zone, and the freshness test."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

# Fixed value: the form in which callers send dates.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]'Z'"


def parse_iso(text: Column) -> Column:
    """``2020-01-31T00:00:00.000Z`` to a timestamp without a zone."""
    return F.to_timestamp_ntz(text, F.lit(ISO_FORMAT))


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds to a timestamp without a zone."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def now(clock: datetime | None = None) -> Column:
    """The given clock, or the start time of the query."""
    moment = F.current_timestamp() if clock is None else F.lit(clock)
    return moment.cast("timestamp_ntz")


def is_fresh(latest: Column, days: float | None, clock: datetime | None = None) -> Column:
    """True when ``latest`` lies within the last ``days``; never with ``days=None``."""
    if days is None:
        return F.lit(False)
    horizon = now(clock) - F.make_dt_interval(days=F.lit(0), secs=F.lit(float(days) * 86400).cast("decimal(18,6)"))
    return F.coalesce(latest > horizon, F.lit(False))


def minutes_to_seconds(minutes: float) -> float:
    return minutes * 60
