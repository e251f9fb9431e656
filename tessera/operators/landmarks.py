"""Kernel machines over a bounded dictionary of rows.

A dictionary is a set of rows whose images in a kernel's space nearly span those of all rows: every other row lies within a
tolerance of their span (approximate linear dependence). Every row then becomes a vector of at most as many
numbers as the dictionary has rows, whose products are the kernel's up to that tolerance, and ridge, k-means and any
linear method run on these vectors.

Tasks choose greedily among their own rows by pivoted Cholesky steps, choices of tasks are merged a few at a time
by the same steps, and rows that the merged dictionary leaves too far away go through again, until no row is left or the dictionary
has reached its bound. Only the dictionary, bounded by a parameter, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import graphs
from tessera.plans.shared import discard, materialize
from tessera.plans.session import table

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: A merging task takes about so many times the bound of the dictionary.
FAN_IN = 8


def linear() -> Kernel:
    """Products of vectors."""
    return lambda x, y: x @ y.T


def radial(gamma: float) -> Kernel:
    """exp(-gamma * squared distance)."""

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
        return np.exp(-gamma * np.maximum(d, 0))

    return kernel


def polynomial(gamma: float, coef: float, degree: float) -> Kernel:
    """(gamma * product + coef) to a power."""
    return lambda x, y: (gamma * (x @ y.T) + coef) ** degree


def sigmoid(gamma: float, coef: float) -> Kernel:
    """tanh(gamma * product + coef); for some parameters it is no true kernel."""
    return lambda x, y: np.tanh(gamma * (x @ y.T) + coef)


def _own(kernel: Kernel, x: np.ndarray) -> np.ndarray:
    """The kernel of every row with itself."""
    return np.array([kernel(r[None, :], r[None, :])[0, 0] for r in x])


def _triangle(matrix: np.ndarray) -> np.ndarray:
    """The lower triangle whose product with its transpose is the matrix; rounding that makes it indefinite is evened out."""
    try:
        return np.linalg.cholesky(matrix)
    except np.linalg.LinAlgError:
        return np.linalg.cholesky(matrix + 1e-10 * np.trace(matrix) / len(matrix) * np.eye(len(matrix)))


class Choice:
    """Rows chosen so far and the lower triangle of their kernel matrix."""

    def __init__(self, kernel: Kernel, most: int, tolerance: float, rows: np.ndarray | None = None):
        self.kernel, self.most, self.tolerance = kernel, most, tolerance
        self.rows = np.empty((0, 0)) if rows is None else rows
        self.lower = _triangle(kernel(rows, rows)) if rows is not None and len(rows) else np.empty((0, 0))

    def images(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of rows in the space of the choice, and the squared distances to it."""
        if not len(self.rows):
            return np.empty((len(x), 0)), _own(self.kernel, x)
        z = np.linalg.solve(self.lower, self.kernel(self.rows, x)).T
        return z, np.maximum(_own(self.kernel, x) - (z * z).sum(1), 0)

    def extend(self, x: np.ndarray) -> list[int]:
        """Places of the rows of x that join: each time the farthest, ties to the first, while it is beyond the tolerance."""
        z, away = self.images(x)
        joined = []
        while len(self.rows) < self.most and len(x):
            best = int(np.argmax(away))
            if not away[best] > self.tolerance:
                break
            root = np.sqrt(away[best])
            column = (self.kernel(x, x[best][None, :])[:, 0] - z @ z[best]) / root
            n = len(self.rows)
            lower = np.zeros((n + 1, n + 1))
            lower[:n, :n], lower[n, :n], lower[n, n] = self.lower, z[best], root
            self.rows = np.vstack([self.rows, x[best]]) if n else x[best][None, :]
            self.lower = lower
            z = np.column_stack([z, column])
            away = np.maximum(away - column * column, 0)
            away[best] = 0.0
            joined.append(best)
        return joined


def vectors(column: pa.Array) -> np.ndarray:
    """The rows of a column of arrays as a matrix."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), int(lengths[0]) if len(lengths) else 0)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, not empty and finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)))


def _choose(df: DataFrame, kernel: Kernel, most: int, tolerance: float, held: np.ndarray | None) -> DataFrame:
    """The rows (v) that every task adds to the dictionary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choice = Choice(kernel, most, tolerance, held)
        known = len(choice.rows)
        for b in batches:
            for start in range(0, len(b), 1024):
                choice.extend(vectors(b.column(0).slice(start, 1024)))
        new = choice.rows[known:].tolist()
        if new:
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.list_(pa.float64()))], names=["v"])

    return df.mapInArrow(run, T.StructType([T.StructField("v", T.ArrayType(T.DoubleType()))]))


def _merged(df: DataFrame, kernel: Kernel, most: int, tolerance: float, held: np.ndarray | None) -> np.ndarray:
    """The rows that join the dictionary, of all tasks' choices."""
    found, parts = materialize(_choose(df, kernel, most, tolerance, held), "choice"), 0
    while parts != 1:
        parts = max(1, -(-found.count() // (FAN_IN * most)))
        last, found = found, materialize(_choose(found.repartition(parts, F.xxhash64("v")), kernel, most, tolerance, held), "choice")
        discard(last)
    rows = [r.v for r in found.collect()]  # at most the bound
    discard(found)
    return np.array(rows, dtype=np.float64).reshape(len(rows), -1) if rows else np.empty((0, 0))


def dictionary(df: DataFrame, vector: str, kernel: Kernel, most: int = 100, tolerance: float = 1e-3, rounds: int = 20) -> np.ndarray:
    """At most `most` vectors of df in whose span, up to a squared distance of the tolerance, all others lie, unless the bound was reached.

    Nulls and vectors with null or non-finite components don't take part; all vectors have one length. An empty
    table, or one of zero images, gives no row.
    """
    rows = usable(df, vector).select(F.col(vector).cast("array<double>").alias("v"))
    held: np.ndarray | None = None
    for _ in range(rounds):
        left = rows if held is None else _mapped(rows, "v", kernel, held).filter(F.col("away") > tolerance).select("v")
        new = _merged(left, kernel, most, tolerance, held)
        if not len(new):
            break
        held = new if held is None else np.vstack([held, new])
        if len(held) >= most:
            break
    return np.empty((0, 0)) if held is None else held


@dataclass(frozen=True)
class Space:
    """A dictionary and its kernel: what maps rows to vectors."""

    kernel: Kernel
    rows: np.ndarray

    def images(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return Choice(self.kernel, len(self.rows), 0.0, self.rows).images(x)


def _mapped(df: DataFrame, vector: str, kernel: Kernel, rows: np.ndarray) -> DataFrame:
    space = Space(kernel, rows)
    names, at = df.columns, df.columns.index(vector)
    schema = T.StructType([*df.schema.fields, T.StructField("z", T.ArrayType(T.DoubleType())), T.StructField("away", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), 1024):
                part = b.slice(start, 1024)
                z, away = space.images(vectors(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(z.tolist(), pa.list_(pa.float64())), pa.array(away)], names=[*names, "z", "away"])

    return df.mapInArrow(run, schema)


def mapped(df: DataFrame, vector: str, kernel: Kernel, rows: np.ndarray) -> DataFrame:
    """df with z, each row's vector in the dictionary's space, and away, its squared distance to the space; unusable rows drop, columns of these names give way."""
    return _mapped(usable(df, vector).drop("z", "away"), vector, kernel, rows)


def summed(df: DataFrame, columns: list[str], make: Callable[[list[pa.Array]], np.ndarray], size: int) -> np.ndarray:
    """Sums of an array over all rows: one row a task and place, added up by Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += make(b.columns)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "x"])

    added = df.select(*columns).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for row in added:
        out[row.i] = row.x
    return out


@dataclass(frozen=True)
class Ridge:
    """Weights over a space, the penalty and the mean squared error with each row left out."""

    space: Space
    weights: np.ndarray
    penalty: float
    error: float

    def predict(self, df: DataFrame, vector: str, out: str = "predicted") -> DataFrame:
        """df with the predicted value; unusable rows drop."""
        w = F.array(*[F.lit(float(x)) for x in self.weights])
        dot = F.aggregate(F.zip_with("z", w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return mapped(df.drop(out), vector, self.space.kernel, self.space.rows).withColumn(out, dot).drop("z", "away")


def kernel_ridge(df: DataFrame, vector: str, label: str, kernel: Kernel, penalties: tuple[float, ...] = (1.0,), most: int = 100, tolerance: float = 1e-3) -> Ridge:
    """Ridge regression in a kernel's space; of several penalties, the one with the least squared error when each row is left out.

    Rows with equal vectors are one, with their number and the mean and variance of their labels. One pass sums products of the vectors, one
    the errors of all penalties by the closed form of leaving a row out; rows without a label don't take part.
    """
    known = usable(df.filter(F.col(label).isNotNull()), vector).select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y"))
    known = materialize(known.groupBy("v").agg(F.count("*").cast("double").alias("n"), F.avg("y").alias("y"), F.var_pop("y").alias("spread")), "labels")
    rows = dictionary(known, "v", kernel, most, tolerance)
    if not len(rows):
        raise ValueError("no row to learn from")
    m = len(rows)
    at = mapped(known, "v", kernel, rows).select("z", "n", "y", "spread")

    def products(columns: list[pa.Array]) -> np.ndarray:
        z, n, y = vectors(columns[0]), columns[1].to_numpy(), columns[2].to_numpy()
        return np.concatenate([((z.T * n) @ z).ravel(), z.T @ (n * y), [n.sum()]])

    added = summed(at, ["z", "n", "y"], products, m * m + m + 1)
    gram, right, n = added[: m * m].reshape(m, m), added[m * m : -1], added[-1]
    inverses = [np.linalg.inv(gram + p * np.eye(m)) for p in penalties]
    weights = [i @ right for i in inverses]

    def errors(columns: list[pa.Array]) -> np.ndarray:
        z, (count, y, spread) = vectors(columns[0]), (c.to_numpy() for c in columns[1:])
        out = []
        for inverse, w in zip(inverses, weights, strict=True):
            own = np.minimum(((z @ inverse) * z).sum(1), 1 - 1e-9)
            out.append((count * (spread + (y - z @ w) ** 2) / (1 - own) ** 2).sum())
        return np.array(out)

    error = summed(at, ["z", "n", "y", "spread"], errors, len(penalties)) / n
    discard(known)
    best = int(np.argmin(error))
    return Ridge(Space(kernel, rows), weights[best], penalties[best], float(error[best]))


def kernel_kmeans(df: DataFrame, key: str, vector: str, kernel: Kernel, k: int, most: int = 100, tolerance: float = 1e-3, rounds: int = 10) -> DataFrame:
    """(key, cluster): k-means in a kernel's space; clusters are named by their smallest key."""
    rows = dictionary(df, vector, kernel, most, tolerance)
    at = materialize(mapped(df.select(key, F.col(vector).cast("array<double>").alias("v")), "v", kernel, rows).select(key, "z"), "images")
    near = graphs.kmeans(at, key, "z", k, rounds)[1]
    names = near.groupBy("cluster").agg(F.min(key).alias("_name"))
    return near.join(names, "cluster").select(key, F.col("_name").alias("cluster"))


def _price_curve(s, d):
    """Predicted price of a line by its quantity, a quadratic kernel over all lines."""
    lines = table(s, d, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"))
    lines = lines.withColumn("v", F.array(F.col("quantity") / 50.0))
    model = kernel_ridge(lines, "v", "price", polynomial(1.0, 1.0, 2), (10.0,), 10, 1e-9)
    return model.predict(lines.select("quantity", "v").distinct(), "v").select("quantity", F.round("predicted", 2).alias("predicted"))


def _span(s, d):
    """How far every vector lies from the span of a dictionary as large as vectors are long: rounded, nothing."""
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = dictionary(e, "v", linear(), 512, 1e-6)
    return mapped(e, "v", linear(), rows).select("vec_id", F.round("away", 3).alias("away"), F.round(F.aggregate(F.transform("z", lambda x: x * x), F.lit(0.0), lambda a, x: a + x), 4).alias("length2"))


QUERIES = {"kernel_ridge_curve": _price_curve, "dictionary_span": _span}

#: The quadratic kernel's own coordinates are 1, sqrt(2) u and u * u; three equations are solved by determinants.
ORACLES = {
    "kernel_ridge_curve": """
WITH l AS (SELECT l_quantity::DOUBLE AS quantity, l_quantity::DOUBLE / 50.0 AS u, l_extendedprice::DOUBLE AS y FROM lineitem),
s AS (SELECT count(*) + 10.0 AS a, sqrt(2) * sum(u) AS b, sum(u * u) AS c, 2 * sum(u * u) + 10.0 AS d, sqrt(2) * sum(u ** 3) AS e, sum(u ** 4) + 10.0 AS f,
  sum(y) AS p, sqrt(2) * sum(u * y) AS q, sum(u * u * y) AS r FROM l),
t AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s),
w AS (SELECT (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS w0, (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / det AS w1,
  (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det AS w2 FROM t)
SELECT DISTINCT quantity, round(w0 + w1 * sqrt(2) * u + w2 * u * u, 2) AS predicted FROM l, w""",
    "dictionary_span": "SELECT vec_id, 0.0::DOUBLE AS away, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS length2 FROM embeddings WHERE embedding IS NOT NULL",
}
