"""The newest row of each key from a stream, whatever order rows arrive in.

State holds time and tie of one row per key: the newest so far by time, then by the larger tie.  An older
row that arrives later changes nothing.  A key that stays quiet is forgotten once the
watermark has passed its newest time by ``forget_after``; a timer does that, so state is
bounded by the keys of that span.  A row that comes for a forgotten key counts as new.

Every change of a key's newest row is put out, so the last row put out for a key is its
newest.  Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_db(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
# A missing time as a number of microseconds.
_NO_TIME = np.iinfo(np.int64).min


def _plain(value):
    """A value of a frame as Python's own; null becomes None."""
    if pd.isna(value):
        return None
    return value.item() if isinstance(value, np.generic) else value


class _Newest(StatefulProcessor):
    def __init__(self, columns: list[str], time: str, tie: str, schema: T.StructType, forget_ms: int):
        self.columns, self.time, self.tie, self.schema, self.forget_ms = columns, time, tie, schema, forget_ms
        self.time_at, self.tie_at = columns.index(time), columns.index(tie)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("newest", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = row = None
        for part in rows:
            place = self._newest_place(part)
            if place is not None:
                found = tuple(_plain(part[c].iat[place]) for c in self.columns)
                if row is None or self._rank(found) >= self._rank(row):
                    best, row = part.iloc[place : place + 1], found
        if best is not None and self._keep(row):
            yield best if list(best.columns) == self.columns else best[self.columns]

    def _keep(self, row: tuple) -> bool:
        """Hold a row unless the held one is as new."""
        before = self.held.get()
        if before is not None:
            if self._rank(before) >= self._rank(row):
                return False
            # A held row has one timer, and its time follows from the row.
            self.handle.deleteTimer(self._expiry(before))
        self.held.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row))
        self.handle.registerTimer(self._expiry(row))
        return True

    def _newest_place(self, part: pd.DataFrame) -> int | None:
        """Where the newest row stands; of equal times the larger tie, a null tie first, then the later row."""
        times = part[self.time].to_numpy().astype("datetime64[us]").astype(np.int64)
        if not len(times) or times.max() == _NO_TIME:
            return None
        last = np.flatnonzero(times == times.max())
        if len(last) > 1:
            ties = part[self.tie].iloc[last]
            if ties.notna().any():
                last = last[(ties == ties.max()).to_numpy(bool, na_value=False)]
        return int(last[-1])

    def _rank(self, row: tuple) -> tuple:
        tie = row[self.tie_at]
        return pd.Timestamp(row[self.time_at]), tie is not None, 0 if tie is None else tie

    def _expiry(self, row: tuple) -> int:
        return int(pd.Timestamp(row[self.time_at]).timestamp() * 1000) + self.forget_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class _NewestRow(_Newest):
    """The same on plain rows, which spares the frames of each key.

    Rows bring times with their zone, so the state holds them as microseconds.
    """

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = rank = None
        for row in rows:
            time, tie = row[self.time], row[self.tie]
            if time is not None:
                here = (time, tie is not None, 0 if tie is None else tie)
                if best is None or here >= rank:
                    best, rank = row, here
        if best is None:
            return
        micros = (rank[0] - (_EPOCH if rank[0].tzinfo else _EPOCH.replace(tzinfo=None))) // timedelta(microseconds=1)
        if self._keep((micros, best[self.tie])):
            yield Row(*self.columns)(*[best[c] for c in self.columns])

    def _rank(self, held: tuple) -> tuple:
        return held[0], held[1] is not None, 0 if held[1] is None else held[1]

    def _expiry(self, held: tuple) -> int:
        return held[0] // 1000 + self.forget_ms


def newest_rows(stream: DataFrame, key: str, time: str, tie: str, delay: str, forget_after_ms: int) -> DataFrame:
    """Changes of the newest row of each key, with the columns of ``stream``; ``time`` is a timestamp.

    ``delay`` is how late rows may be for the watermark; later ones are dropped by the stream.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    held = T.StructType([T.StructField("micros", T.LongType()), T.StructField("tie", schema[tie].dataType)])
    worker = _NewestRow(stream.columns, time, tie, held, forget_after_ms)
    return stream.withWatermark(time, delay).groupBy(key).transformWithState(
        statefulProcessor=worker, outputStructType=schema, outputMode="Update", timeMode="EventTime"
    )


def run_available(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has landed; the changes of each batch lie in a folder of their own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    with rocks_db(changes.sparkSession):
        query = (
            changes.writeStream.foreachBatch(write)
            .outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return query
