"""Embedding whitening: a weighted covariance over distinct vectors.

Entries become whole numbers, floor(SCALE * c) + BASE, and rows with the same whole numbers form one group. The fit runs over the groups: a group
weighs as many as it has rows ("counts"), or one ("one", which keeps frequent copies from bending the axes). Sums are exact; vectors are
centred, multiplied by their weights and by each other (one matrix product a batch, one small triangle a task), and Spark
adds the triangles up. The eigenvectors of that matrix, whose size depends on the vectors' width alone, are found on the driver. Each
distinct vector is whitened once, and rows are joined with their group's result; groups so frequent that they would fill a task are
joined where their rows are (`join_by_counts`).

Rows whose vector is null or holds a null or non-finite entry are dropped. Shorter vectors act as if filled with zeros. Entries
beyond 2^56 end there. Each row counts, whether its id is repeated or null. A component without variance (LEAST_VARIANCE of the trace or
less, which rounding alone can make) isn't returned, so equal vectors and an empty table give no components: of equal
vectors each row comes with empty arrays, an empty table gives no rows. A deviation beyond the range of long ends at its limit. No other column is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, drop_stored, join_by_counts, lean, stored

SCALE, BASE, COMPONENTS = 64, 1_000_000, 32
#: Least share of the trace that an eigenvalue must have: below it rounding decides.
LEAST_VARIANCE = 1e-12
SAFE, LIMIT = float(1 << 61), (1 << 63) - 1


def sound(vector: Column) -> Column:
    """Not null, and every entry a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def whole(vector: Column) -> Column:
    """Entries as whole numbers."""
    edge = float(1 << 62)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * float(SCALE), F.lit(edge)), F.lit(-edge))) + BASE)


def matrix(column: pa.Array, width: int, fill: float) -> np.ndarray:
    """Rows of a list column as a matrix; what short rows lack is `fill`."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths())
    if (ends == width).all():
        return values.reshape(len(ends), width)
    out = np.full((len(ends), width), fill, values.dtype)
    out[np.arange(width) < ends[:, None]] = values
    return out


@dataclass
class Fit:
    """Exact number and sums of the fit list, its components (columns) with their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, m: np.ndarray) -> np.ndarray:
        """x - S / n: whole parts are taken off exactly, so only the small rest is rounded."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = np.array([(s - self.n * b) / self.n for s, b in zip(self.sums, near)])
        return (m - np.array(near, np.int64)).astype(np.float64) - rest

    def deviations(self, m: np.ndarray) -> np.ndarray:
        """Sum of (n x - S)^2 of each row, exact."""
        s = np.array(self.sums, object)
        far = max((abs(self.n * int(v) - t) for col, t in zip(m.T, self.sums) for v in (col.min(), col.max())), default=0)
        if float(far) * far * m.shape[1] < SAFE and self.n * float(np.abs(m).max(initial=0)) < SAFE:
            d = self.n * m - s.astype(np.int64)
            return (d * d).sum(axis=1)
        return np.array([min(LIMIT, int(((self.n * row - s) ** 2).sum())) for row in m.astype(object)], np.int64)

    def whitened(self, m: np.ndarray) -> np.ndarray:
        return self.centred(m) @ self.axes / np.sqrt(self.values)


def _totals(table: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], keys: list[str]) -> list:
    """What work() yields in each task, added up by keys; as many rows as there are keys come to the driver."""
    names = [part.split()[0] for part in schema.split(",")]
    types = {"int": pa.int32(), "double": pa.float64(), "decimal(38": pa.decimal128(38, 0)}
    kinds = [types[part.split()[1]] for part in schema.replace(",0)", "").split(",")]

    def run(batches):
        rows = list(work(batches))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names[: len(kinds)])

    parts = table.mapInArrow(lean(run), schema)
    with bounded_batches(table.sparkSession):
        return parts.groupBy(*keys).agg(F.sum(names[len(keys)]).alias("total")).collect()


def exact_sums(groups: DataFrame, width: int) -> list[int]:
    """Sum of weight times vector over all groups(v, weight), in each dimension."""

    def work(batches):
        total = [0] * width
        for b in batches:
            if b.num_rows:
                m, w = matrix(b.column("v"), width, BASE), np.asarray(b.column("weight"))
                if float(np.abs(m).max(initial=0)) * float(w.sum()) >= SAFE:
                    m, w = m.astype(object), w.astype(object)
                total = [t + int(s) for t, s in zip(total, w @ m)]
        yield from ((k, Decimal(t)) for k, t in enumerate(total))

    got = {r["dim"]: int(r["total"]) for r in _totals(groups.select("v", "weight"), "dim int, s decimal(38,0)", work, ["dim"])}
    return [got.get(k, 0) for k in range(width)]


def covariance(groups: DataFrame, width: int, n: int, centre: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Weighted covariance, divisor n, of what centre() makes of the vectors of groups(v, weight)."""

    def work(batches):
        acc = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                c = centre(b.column("v"))
                acc += (c * np.asarray(b.column("weight"))[:, None]).T @ c
        i, j = np.triu_indices(width)
        yield from zip(i.tolist(), j.tolist(), acc[i, j].tolist())

    out = np.zeros((width, width))
    for r in _totals(groups.select("v", "weight"), "i int, j int, s double", work, ["i", "j"]):
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["total"] / n
    return out


def fit(groups: DataFrame, width: int, n: int, components: int) -> Fit:
    """Components of groups(v, weight) by falling variance; each has its largest entry positive."""
    made = Fit(n, exact_sums(groups, width), np.zeros((width, 0)), np.zeros(0), 0.0)
    v = covariance(groups, width, n, lambda col: made.centred(matrix(col, width, BASE)))
    values, axes = np.linalg.eigh(v)
    made.trace = float(np.trace(v))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST_VARIANCE * made.trace]
    made.values, made.axes = values[order], axes[:, order]
    tops = np.abs(made.axes).argmax(axis=0)
    made.axes = made.axes * np.where(made.axes[tops, np.arange(len(order))] < 0, -1.0, 1.0)
    return made


def identity_error(done: DataFrame, k: int, n: int) -> float:
    """Largest difference between the covariance of whitened vectors (done(v, weight)) and the identity matrix."""
    if not k:
        return 0.0

    def work(batches):
        total = np.zeros(k)
        for b in batches:
            if b.num_rows:
                total += np.asarray(b.column("weight")) @ matrix(b.column("v"), k, 0.0)
        yield from enumerate(total.tolist())

    mean = np.zeros(k)
    for r in _totals(done.select("v", "weight"), "dim int, s double", work, ["dim"]):
        mean[r["dim"]] = r["total"] / n
    return float(np.abs(covariance(done, k, n, lambda col: matrix(col, k, 0.0) - mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, weigh: str = "counts", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, whitened and explained (arrays, a place for each component) and identity_error of every sound row.

    weigh: "counts" fits over all rows, "one" over the distinct vectors.
    """
    if weigh not in ("counts", "one"):
        raise ValueError(f"weigh must be counts or one, not {weigh}")
    spark, x = vectors.sparkSession, F.col(vector_col)
    # The condition stands apart from the conversion, which needs entries that are numbers.
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(sound(x), whole(x)).alias("x")).where("x is not null")
    rows = stored(rows.withColumn("h", F.xxhash64("x")))
    distinct = stored(rows.groupBy("h", "x").agg(F.count("*").alias("copies")))
    weight = F.col("copies") if weigh == "counts" else F.lit(1).cast("long")
    n_rows, n, width = distinct.agg(F.sum("copies"), F.sum(weight), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    model = fit(distinct.select(F.col("x").alias("v"), weight.alias("weight")), width, n, components)
    k = len(model.values)

    def apply(batches):
        for b in batches:
            m = matrix(b.column("x"), width, BASE)
            z = model.whitened(m).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(z))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.deviations(m)), lists], [*b.schema.names, "deviation", "whitened"])

    with bounded_batches(spark):
        done = stored(distinct.mapInArrow(lean(apply), "h long, x array<long>, copies long, deviation long, whitened array<double>"))
    drop_stored(distinct)
    off = identity_error(done.select(F.col("whitened").alias("v"), weight.alias("weight")), k, n)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    both = join_by_counts(rows, done, ["h", "x"], "copies", n_rows)
    return both.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(off).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's whitened components, fitted over all rows."""
    got = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = got.select("*", F.posexplode("whitened").alias("at", "value"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.get("explained", F.col("at")).alias("explained"), "identity_error")


QUERIES = {"op11_whitening": op11_whitening}
