"""A vector index that takes new vectors, forgets deleted ones and splits full cells.

Vectors lie in parts, one for each change, filed by cell inside a part.  A version is a
small table of the cells that count: center, number of vectors and their sum, kept cell by
cell as vectors come.  A version also names its parts and its lists of deleted ids.  It is
written after everything it names, in one folder, so readers see the version before or the
new one and never half of a change; old versions stay readable.

- ``add`` files new vectors under the stored centers.  Only the new vectors are read.
- ``delete`` writes ids; searches leave them out by an anti join on the probed cells.
- ``split`` cuts every cell above a limit in two by a few rounds of 2-means, all such cells
  in the same scans.  Only their vectors are read; they move to a new part under new numbers,
  and the version stops naming the old cell.

Every live vector is in exactly one live cell, so probing all cells is exact after any
sequence of changes.  Ids should be unique: a deleted id stays deleted.  Vectors without
direction lie in a cell of their own, which never splits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import matrix_of, unit_rows
from ..session import to_scratch
from . import ivf
from .joins import absent

SPLIT_ROUNDS = 5
VERSION = "cell int, center array<double>, n bigint, total array<double>, parts array<string>, deletes array<string>, metric string"


@dataclass(frozen=True)
class GrowingIndex(ivf.IvfIndex):
    """One version of an index; searches take it like any other index.  ``cells`` counts live cells."""

    version: str = ""
    id_col: str = "id"

    def _state(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(VERSION).parquet(f"{self.path}/versions/{self.version}")

    def _listed(self, spark: SparkSession, name: str) -> list[str]:
        row = self._state(spark).select(name).first()
        return list(row[0]) if row else []

    def filed(self, spark: SparkSession) -> DataFrame:
        """Vectors of the live cells, deleted ones included."""
        live = [r[0] for r in self._state(spark).select("cell").collect()]
        folders = [f"{self.path}/vectors/part={p}" for p in self._listed(spark, "parts")]
        rows = spark.read.option("basePath", f"{self.path}/vectors").parquet(*folders).drop("part")
        return rows.where(F.col("cell").isin(*live))

    def vectors(self, spark: SparkSession) -> DataFrame:
        gone = [f"{self.path}/deletes/{d}" for d in self._listed(spark, "deletes")]
        return absent(self.filed(spark), spark.read.parquet(*gone), self.id_col) if gone else self.filed(spark)

    def centroids(self, spark: SparkSession) -> DataFrame:
        return self._state(spark).where(F.col("cell") >= 0).select("cell", "center")


def _publish(spark: SparkSession, index: GrowingIndex, state: DataFrame) -> GrowingIndex:
    """Write a version, at most ``cells`` rows, and point to it."""
    number = int(index.version.split("-")[0]) + 1 if index.version else 0
    name = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    state = to_scratch(state.select(*StructType.fromDDL(VERSION).names), "version")
    state.coalesce(1).write.parquet(f"{index.path}/versions/{name}")
    cells = state.where(F.col("cell") >= 0).count()
    return GrowingIndex(index.path, cells, index.metric, name, index.id_col)


def _vector_sums(rows: DataFrame, vector: str, dims: int, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """``n`` and ``total`` of unit vectors by small integer ``keys``; tasks add up before the shuffle."""
    keys = list(keys)
    layout = pa.schema([*[(k, pa.int32()) for k in keys], ("n", pa.int64()), ("total", pa.list_(pa.float64()))])

    def task(batches):
        sums: dict[tuple, list] = {}
        for batch in batches:
            groups = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(len(keys))])
            usable, found = matrix_of(batch.column(len(keys)), dims)
            units = np.zeros((batch.num_rows, dims))
            units[usable] = np.nan_to_num(unit_rows(found))
            for key in np.unique(groups, axis=1).T:
                own = (groups == key[:, None]).all(axis=0)
                held = sums.setdefault(tuple(key.tolist()), [0, np.zeros(dims)])
                held[0] += int(own.sum())
                held[1] += units[own].sum(axis=0)
        if sums:
            out = {name: [k[i] for k in sums] for i, name in enumerate(keys)}
            out |= {"n": [v[0] for v in sums.values()], "total": [v[1].tolist() for v in sums.values()]}
            yield pa.RecordBatch.from_pydict(out, schema=layout)

    kinds = ", ".join(f"{k} int" for k in keys)
    parts = rows.select(*keys, vector).mapInArrow(task, f"{kinds}, n bigint, total array<double>")
    each = parts.select(*keys, "n", F.posexplode("total").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    # One number for each dimension of a group.
    listed = each.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "x"))).alias("l"))
    return listed.select(*keys, "n", F.transform("l", lambda p: p["x"]).alias("total"))


def _write_part(index: GrowingIndex, filed: DataFrame) -> str:
    part = f"p{uuid.uuid4().hex}"
    filed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{index.path}/vectors/part={part}")
    return part


def create(
    df: DataFrame, path: str, cells: int = 500, vector: str = "embedding", id_col: str = "id", metric: str = "cosine",
    centers: np.ndarray | None = None, seed: int = 7,
) -> GrowingIndex:
    """A first version with all rows of ``df``; centers are given or trained."""
    spark = df.sparkSession
    centers = ivf.train_centroids(df, cells, vector, seed) if centers is None else centers
    index = GrowingIndex(path, len(centers), metric, "", id_col)
    rows = [(i, [float(x) for x in c], 0, [], [], [], metric) for i, c in enumerate(centers)]
    rows.append((ivf.NO_CELL, [], 0, [], [], [], metric))
    return add(_publish(spark, index, spark.createDataFrame(rows, VERSION)), df, vector)


def latest(spark: SparkSession, path: str, id_col: str = "id") -> GrowingIndex:
    """The newest complete version below ``path``."""
    files = spark.read.schema(VERSION).parquet(f"{path}/versions/*").select("metric", "cell", F.input_file_name().alias("file"))
    name = F.element_at(F.split("file", "/"), -2)
    row = files.groupBy(name.alias("name"), "metric").agg(F.count_if(F.col("cell") >= 0).alias("cells")).orderBy(F.col("name").desc()).first()
    return GrowingIndex(path, row["cells"], row["metric"], row["name"], id_col)


def add(index: GrowingIndex, df: DataFrame, vector: str = "embedding") -> GrowingIndex:
    """The next version, with the vectors of ``df`` filed under the stored centers."""
    spark = df.sparkSession
    state = index._state(spark)
    known = state.where(F.col("cell") >= 0).select("cell", "center").orderBy("cell").collect()
    numbers = F.array(*[F.lit(r["cell"]) for r in known])
    centers = np.array([r["center"] for r in known])
    if ivf._dimensions(df, vector) != centers.shape[1]:
        raise ValueError("the vectors and the centers differ in length")
    nearest = ivf.nearest_cell(F.col(vector), centers)
    filed = df.withColumn("_at", nearest).withColumn("cell", F.coalesce(F.get(numbers, F.col("_at")), F.lit(ivf.NO_CELL)))
    part = _write_part(index, filed.drop("_at"))
    fresh = spark.read.parquet(f"{index.path}/vectors/part={part}")
    sums = _vector_sums(fresh, vector, centers.shape[1]).select("cell", F.col("n").alias("_n"), F.col("total").alias("_total"))
    both = F.when(F.size("total") == 0, F.col("_total")).otherwise(F.zip_with("total", "_total", lambda a, b: a + b))
    joined = state.join(sums, "cell", "left")
    return _publish(spark, index, joined.select(
        "cell", "center", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
        F.when(F.col("_total").isNull(), F.col("total")).otherwise(both).alias("total"),
        F.array_append("parts", F.lit(part)).alias("parts"), "deletes", "metric",
    ))


def delete(index: GrowingIndex, ids: DataFrame) -> GrowingIndex:
    """The next version, without the rows whose id is in the one-column frame ``ids``.

    Counts of cells keep the deleted rows until their cell is split.
    """
    spark = ids.sparkSession
    name = f"d{uuid.uuid4().hex}"
    ids.select(F.col(ids.columns[0]).alias(index.id_col)).distinct().write.parquet(f"{index.path}/deletes/{name}")
    return _publish(spark, index, index._state(spark).withColumn("deletes", F.array_append("deletes", F.lit(name))))


def _sides(rows: DataFrame, vector: str, pairs: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``side``: the nearer of the two centers of the row's own cell."""
    sent = {cell: unit_rows(two) for cell, two in pairs.items()}
    dims = len(next(iter(sent.values()))[0])

    @F.arrow_udf("int")
    def side(cell: pa.Array, vectors: pa.Array) -> pa.Array:
        numbers, out = cell.to_numpy(), np.zeros(len(cell), np.int32)
        usable, found = matrix_of(vectors, dims)
        at = np.flatnonzero(usable)
        for c in np.unique(numbers[at]):
            own = numbers[at] == c
            out[at[own]] = (found[own] @ sent[int(c)].T).argmax(axis=1)
        return pa.array(out)

    return rows.withColumn("side", side(F.col("cell"), F.col(vector)))


def split(index: GrowingIndex, spark: SparkSession, limit: int, vector: str = "embedding", rounds: int = SPLIT_ROUNDS) -> GrowingIndex:
    """The next version, in which cells with more than ``limit`` vectors are two cells each.

    A cell whose vectors all have one direction stays whole.  Call it again until
    the version stays the same if cells may be more than twice the limit.
    """
    state = index._state(spark)
    full = {r["cell"]: r["center"] for r in state.where((F.col("n") > limit) & (F.col("cell") >= 0)).collect()}
    if not full:
        return index
    rows = index.vectors(spark).where(F.col("cell").isin(*full))
    # A cell's first pair: its row with the smallest hash and the row least like it.
    start = rows.groupBy("cell").agg(F.min_by(vector, F.xxhash64(index.id_col)).alias("one"))
    ones = {r["cell"]: np.array(r["one"], np.float64) for r in start.collect()}
    if not ones:
        return index
    away, dims = _farthest(rows, vector, ones), len(next(iter(ones.values())))
    pairs = {c: np.stack([ones[c], away[c]]) for c in ones}
    for _ in range(rounds):
        sums = _vector_sums(_sides(rows, vector, pairs), vector, dims, ("cell", "side")).collect()
        moved = {c: two.copy() for c, two in pairs.items()}
        for r in sums:
            moved[r["cell"]][r["side"]] = np.array(r["total"])
        pairs = moved
    first = (state.agg(F.max("cell")).first()[0] or 0) + 1
    last = _vector_sums(_sides(rows, vector, pairs), vector, dims, ("cell", "side")).collect()
    parted = sorted(c for c in pairs if sum(r["cell"] == c for r in last) == 2)
    if not parted:
        return index
    number = {(c, s): first + 2 * i + s for i, c in enumerate(parted) for s in (0, 1)}
    keys = [x for (c, s), n in number.items() for x in (F.lit(2 * c + s), F.lit(n))]
    filed = _sides(rows.where(F.col("cell").isin(*parted)), vector, pairs)
    filed = filed.withColumn("cell", F.element_at(F.create_map(*keys), 2 * F.col("cell") + F.col("side"))).drop("side")
    part = _write_part(index, filed)
    made = [
        (number[r["cell"], r["side"]], pairs[r["cell"]][r["side"]].tolist(), r["n"], list(r["total"]))
        for r in last if r["cell"] in parted
    ]
    listed = state.select(F.array_append("parts", F.lit(part)).alias("parts"), "deletes", "metric").limit(1)
    new = spark.createDataFrame(made, "cell int, center array<double>, n bigint, total array<double>").crossJoin(F.broadcast(listed))
    kept = state.where(~F.col("cell").isin(*parted)).withColumn("parts", F.array_append("parts", F.lit(part)))
    return _publish(spark, index, kept.unionByName(new))


def _farthest(rows: DataFrame, vector: str, ones: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Of each cell, the vector least like the given one."""
    sent = {c: unit_rows(v[None])[0] for c, v in ones.items()}
    dims = len(next(iter(sent.values())))

    @F.arrow_udf("double")
    def likeness(cell: pa.Array, vectors: pa.Array) -> pa.Array:
        numbers, out = cell.to_numpy(), np.full(len(cell), np.inf)
        usable, found = matrix_of(vectors, dims)
        at = np.flatnonzero(usable)
        for i, c in zip(range(len(at)), numbers[at].tolist()):
            out[at[i]] = found[i] @ sent[c] / max(np.linalg.norm(found[i]), 1e-300)
        return pa.array(out)

    alike = rows.withColumn("_alike", likeness(F.col("cell"), F.col(vector)))
    found = alike.groupBy("cell").agg(F.min_by(vector, "_alike").alias("two"))
    return {r["cell"]: np.array(r["two"], np.float64) for r in found.collect()}


def drift(index: GrowingIndex, spark: SparkSession) -> DataFrame:
    """``(cell, n, drift)``: one minus the cosine of a cell's center and the sum of its vectors."""
    dot = F.aggregate(F.zip_with("center", "total", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    length: Callable = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = index._state(spark).where((F.col("cell") >= 0) & (F.size("total") > 0))
    return rows.select("cell", "n", (1 - F.try_divide(dot, length(F.col("center")) * length(F.col("total")))).alias("drift"))
