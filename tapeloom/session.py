"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


def build_session(app: str = "tapeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and timestamps pinned to UTC.

    ``conf`` keys use ``__`` for dots: ``spark__driver__memory="8g"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only when that setting is missing and the
    session runs in one process, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tapeloom-")
    return f"{root.rstrip('/')}/tapeloom-{label}-{uuid.uuid4().hex}"


def to_scratch(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the scratch folder and reading it back.

    The result survives executor loss, and the planner knows its real size, so
    it picks a broadcast only when the written data is small enough.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Largest result `pin` brings to the driver.  Callers pass frames that already
# end in a limit, so the check only guards against misuse.
PIN_ROWS = 60_000


def pin(df: DataFrame, max_rows: int = PIN_ROWS) -> pa.Table:
    """Evaluate a small, limited frame once.

    Without this, a top-k that is used in three places of a plan scans the
    base table three times.  `local` turns the rows into a frame again.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"refusing to pin more than {max_rows} rows; limit the frame first")
    layout = to_arrow_schema(df.schema)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(layout)]
    return pa.Table.from_arrays(columns, schema=layout)


def local(spark: SparkSession, rows: pa.Table) -> DataFrame:
    """A frame of pinned rows, whose size the planner knows.

    The rows are few, so they stay in one partition and need no shuffles.
    """
    layout = from_arrow_schema(rows.schema, prefer_timestamp_ntz=True)
    return spark.createDataFrame(rows, layout).coalesce(1)


def settled(df: DataFrame, bound: int, key: str) -> tuple[DataFrame, list | DataFrame]:
    """As ``fixed``, with the keys as a list or, above the bound for lists, as a frame."""
    frame, keys = fixed(df, bound, key)
    return frame, frame.select(key) if keys is None else keys


def fixed(df: DataFrame, bound: int, key: str) -> tuple[DataFrame, list | None]:
    """A frame of at most ``bound`` rows, evaluated once, and its keys.

    A short one is held as local rows.  A long one is written to the scratch
    folder, and its keys are not listed.
    """
    if bound > PIN_ROWS:
        return to_scratch(df, "fixed"), None
    rows = pin(df)
    return local(df.sparkSession, rows), rows.column(key).to_pylist()
