"""The newest row of each key from a stream: late, out-of-order and equal rows, and expiry."""

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Row

from tapeloom.streaming import latest

START = datetime(2024, 1, 1, 10)
SCHEMA = "key string, no bigint, ts timestamp, note string"


def _run(spark, tmp_path, files, delay="10 days", forget_minutes=60 * 24 * 30):
    """Each file is a batch of ``(key, no, minutes after the start, note)``."""
    for n, rows in enumerate(files):
        made = [(k, i, None if m is None else START + timedelta(minutes=m), t) for k, i, m, t in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = latest.newest_rows(stream, "key", "ts", "no", delay, forget_minutes * 60_000)
    query = latest.run_available(changes, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("batch", "key").collect()
    return [(r.batch, r.key, r.no, r.note) for r in rows], query


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    files = [
        [("a", 1, 5, "x"), ("a", 2, 9, "y"), ("b", 1, 0, None)],
        [("a", 3, 7, "late"), ("b", 2, 0, "tie"), ("c", 9, None, "no time")],
        [("a", 4, 20, "new"), ("b", 1, 0, "smaller tie"), ("d", None, 3, "no tie")],
    ]
    got, _ = _run(spark, tmp_path, files)
    assert got == [(0, "a", 2, "y"), (0, "b", 1, None), (1, "b", 2, "tie"), (2, "a", 4, "new"), (2, "d", None, "no tie")]


def test_quiet_keys_come_back(spark, tmp_path):
    """The watermark of the second file passes key a by more than it is kept; b stays."""
    files = [[("a", 1, 0, "first"), ("b", 1, 170, "x")], [("b", 2, 200, "y")], [("b", 3, 201, "z")], [("a", 2, 199, "again")]]
    got, _ = _run(spark, tmp_path, files, "10 minutes", 60)
    assert got == [(0, "a", 1, "first"), (0, "b", 1, "x"), (1, "b", 2, "y"), (2, "b", 3, "z"), (3, "a", 2, "again")]


class _Handle:
    """State and timers of one key."""

    def __init__(self):
        self.row, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.timers.append(timer)


def test_a_timer_forgets_a_key():
    """One timer, moved by each newer row; when it fires, an older row counts as new."""
    handle = _Handle()
    worker = latest._Newest(["key", "no", "ts"], "ts", "no", None, 60_000)
    worker.init(handle)

    def feed(no, minute):
        part = pd.DataFrame({"key": ["a"], "no": [no], "ts": [pd.Timestamp(START + timedelta(minutes=minute))]})
        return [int(r.no.iloc[0]) for r in worker.handleInputRows(("a",), iter([part]), None)]

    millis = lambda m: int(pd.Timestamp(START + timedelta(minutes=m)).timestamp() * 1000) + 60_000
    assert feed(1, 5) == [1] and handle.timers == [millis(5)]
    assert feed(2, 3) == [] and handle.timers == [millis(5)]
    assert feed(3, 8) == [3] and handle.timers == [millis(8)]
    assert list(worker.handleExpiredTimer(("a",), None, None)) == [] and not handle.exists()
    assert feed(4, 1) == [4]


def test_a_key_costs_few_calls_of_its_state():
    """Every call is a message to the engine; timers are not listed to find the one that goes."""

    class Counted(_Handle):
        calls = 0

        def __getattribute__(self, name):
            if name in ("exists", "get", "update", "listTimers", "deleteTimer", "registerTimer"):
                Counted.calls += 1
            return super().__getattribute__(name)

    handle = Counted()
    worker = latest._Newest(["key", "no", "ts"], "ts", "no", None, 60_000)
    worker.init(handle)
    at = lambda *minutes: [pd.NaT if m is None else pd.Timestamp(START + timedelta(minutes=m)) for m in minutes]

    def feed(*parts):
        Counted.calls = 0
        frames = [pd.DataFrame({"note": ["x"] * len(n), "ts": t, "no": n, "key": ["a"] * len(n)}) for n, t in parts]
        found = list(worker.handleInputRows(("a",), iter(frames), None))
        return [(int(r.no.iloc[0]), list(r.columns)) for r in found], Counted.calls

    columns = ["key", "no", "ts"]
    assert feed(([1, 7, 2], at(5, 5, None)), ([3], at(4))) == ([(7, columns)], 3)
    assert feed(([9], at(2))) == ([], 1)
    assert feed(([8, 9], at(None, None))) == ([], 0)
    assert feed(([4, 5], at(9, 9))) == ([(5, columns)], 4)
    assert len(handle.timers) == 1


def test_plain_rows_hold_microseconds():
    handle = _Handle()
    worker = latest._NewestRow(["key", "no", "ts"], "ts", "no", None, 60_000)
    worker.init(handle)
    tokyo = timezone(timedelta(hours=9))

    def feed(*rows):
        made = [Row(ts=t, key="a", no=n) for n, t in rows]
        return [tuple(r) for r in worker.handleInputRows(("a",), iter(made), None)]

    first = datetime(1970, 1, 1, 9, 0, 1, 5, tzinfo=tokyo)
    assert feed((1, None)) == [] and handle.row is None
    assert feed((2, first), (None, first)) == [("a", 2, first)]
    assert handle.row == (1_000_005, 2) and handle.timers == [61_000]
    assert feed((1, first)) == [] and feed((9, first - timedelta(seconds=1))) == []
    later = first + timedelta(seconds=2)
    assert feed((None, later)) == [("a", None, later)] and handle.row == (3_000_005, None) and handle.timers == [63_000]
