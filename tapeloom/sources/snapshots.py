"""Tables that are replaced in one step, with readers pinned to a version.

A version's rows lie in a folder of their own.  A manifest, one small file written after
all rows, names the folder and the version before it; the newest complete manifest is the
table.  So a writer that stops at any point leaves the old table or the new one, whole, and
a reader that has pinned a version keeps reading it while others replace the table.

Manifests are numbered.  Two writers that take the same number at once leave two manifests;
the one with the smaller folder name counts, for all readers alike, and its writer can tell.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

MANIFEST = "number bigint, folder string, layout string, dropped boolean"


@dataclass(frozen=True)
class Version:
    """One state of a table; ``folder`` is None before the first one and after a drop."""

    root: str
    number: int = 0
    folder: str | None = None
    layout: str | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of this version, whatever happens to the table."""
        if self.folder is None:
            raise ValueError(f"there is no table in {self.root}")
        schema = T.StructType.fromJson(json.loads(self.layout))
        return spark.read.schema(schema).parquet(f"{self.root}/data/{self.folder}")


def _manifests(spark: SparkSession, root: str) -> list[Version]:
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifests/*").collect()
    except AnalysisException:
        return []
    found = [Version(root, r["number"], None if r["dropped"] else r["folder"], r["layout"]) for r in rows]
    return sorted(found, key=lambda v: (v.number, [-ord(c) for c in v.folder or ""]))


def current(spark: SparkSession, root: str) -> Version:
    """The newest version."""
    found = _manifests(spark, root)
    return found[-1] if found else Version(root)


def exists(spark: SparkSession, root: str) -> bool:
    return current(spark, root).folder is not None


def _publish(spark: SparkSession, root: str, after: Version, folder: str, layout: str | None, dropped: bool) -> Version:
    row = spark.createDataFrame([(after.number + 1, folder, layout, dropped)], MANIFEST)
    row.coalesce(1).write.parquet(f"{root}/manifests/{folder}")
    return Version(root, after.number + 1, None if dropped else folder, layout)


def replace(df: DataFrame, root: str) -> Version:
    """The rows of ``df`` become the table; ``df`` may read the table itself."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    after = current(spark, root)
    df.write.parquet(f"{root}/data/{folder}")
    return _publish(spark, root, after, folder, df.schema.json(), False)


def append(df: DataFrame, root: str) -> Version:
    """The table with the rows of ``df`` added, as a new version.

    Columns are matched by name.  The rows that were there are read and written again; for
    large tables that only grow, write parts side by side instead.
    """
    spark = df.sparkSession
    now = current(spark, root)
    return replace(df if now.folder is None else now.read(spark).unionByName(df), root)


def drop(spark: SparkSession, root: str) -> Version:
    """No table, as a new version; pinned versions stay readable."""
    return _publish(spark, root, current(spark, root), uuid.uuid4().hex, None, True)


def history(spark: SparkSession, root: str) -> list[Version]:
    """All complete versions, oldest first."""
    return _manifests(spark, root)


def unreferenced(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Data folders that a sweep may remove: not among the last ``keep`` versions.

    Folders without a manifest belong to writers that stopped or still run, and are not listed.
    """
    versions = _manifests(spark, root)
    kept = {v.folder for v in versions[-keep:]}
    return [f"{root}/data/{v.folder}" for v in versions if v.folder and v.folder not in kept]


def sweep(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove the data of old versions through the file system that holds them."""
    jvm, old = spark._jvm, unreferenced(spark, root, keep)
    for folder in old:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(old)
