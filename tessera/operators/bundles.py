"""Cutting-plane trainers: linear classifiers, rankers and sequence labellers.

All minimise half the squared length of the weights plus c times a convex risk. A step asks for the risk and a subgradient at the
present weights, which is one aggregation over the rows; each answer is a plane below the risk, and the next weights
minimise the objective over the planes so far. The driver holds the planes (numbers of weights times steps, both
bounded) and solves that small problem; the best objective found less the planes' minimum bounds the
distance to the optimum. Rows stay where they lie, and a lost task repeats one sum.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.landmarks import summed, usable, vectors
from tessera.plans.prefix import running
from tessera.plans.session import table
from tessera.plans.shared import discard, materialize, staged

Risk = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass(frozen=True)
class Fit:
    """Weights, the objective at them, how far it may be from the least one, and the steps taken."""

    weights: np.ndarray
    objective: float
    gap: float
    steps: int


def lowest(planes: np.ndarray, heights: np.ndarray, c: float, free: np.ndarray, exact: float = 1e-9, rounds: int = 20_000) -> tuple[np.ndarray, float]:
    """Weights least in half their squared length plus c times the highest plane, and that least value (from below).

    The dual is solved to within exact by moving mass between two planes at a time, from the lowest in use to the highest. free marks
    weights that may be negative.
    """
    mass = np.zeros(len(planes))
    mass[int(np.argmax(heights))] = c
    down = -mass @ planes

    def held() -> np.ndarray:
        return np.where(free, down, np.maximum(down, 0))

    value = 0.0
    for _ in range(rounds):
        w = held()
        slope = heights + planes @ w
        value = float(mass @ heights) - 0.5 * float(w @ w)
        high = int(np.argmax(slope))
        low = int(np.argmin(np.where(mass > 0, slope, np.inf)))
        if c * slope[high] - float(mass @ slope) <= exact:
            break
        apart = planes[high] - planes[low]
        move = min(mass[low], (slope[high] - slope[low]) / max(float(apart @ apart), 1e-300))
        mass[high] += move
        mass[low] -= move
        down = down - move * apart
    return held(), value


def minimise(risk: Risk, size: int, c: float, close: float = 1e-3, most: int = 200, prior: np.ndarray | None = None, positive: int = 0, idle: int = 20) -> Fit:
    """Weights whose objective is within c * close of the least, or the best after most steps.

    The risk is 0 or more. With a prior the length is that of the weights' difference from it; the first `positive` weights
    stay 0 or more (without a prior). Planes that carry no mass for `idle` steps are dropped.
    """
    if prior is not None and positive:
        raise ValueError("a prior and weights without sign don't go together")
    base = np.zeros(size) if prior is None else np.asarray(prior, dtype=np.float64)
    free = np.arange(size) >= positive
    planes, heights, unused = np.zeros((1, size)), np.zeros(1), np.zeros(1, dtype=int)
    w, best, at, low = np.zeros(size), np.inf, np.zeros(size), 0.0
    step = 0
    for step in range(1, most + 1):
        value, slope = risk(w + base)
        objective = 0.5 * float(w @ w) + c * value
        if objective < best:
            best, at = objective, w
        if best - low <= c * close:
            break
        planes, heights, unused = np.vstack([planes, slope]), np.append(heights, value - w @ slope), np.append(unused, 0)
        w, bound = lowest(planes, heights, c, free, max(0.1 * (best - low), 1e-3 * c * close))
        low = max(low, bound)
        if best - low <= c * close:
            break
        used = heights + planes @ w >= (heights + planes @ w).max() - 1e-3 * (best - low)
        unused = np.where(used, 0, unused + 1)
        kept = unused <= idle
        kept[0] = True
        planes, heights, unused = planes[kept], heights[kept], unused[kept]
    return Fit(at + base, best, max(best - low, 0.0), step)


def score(vector: str, weights: np.ndarray) -> Column:
    """The product of a vector column with weights."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vector, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _weighted(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of weight times v, and of part, over rows (v, weight, part)."""

    def make(columns: list[pa.Array]) -> np.ndarray:
        return np.append(columns[1].to_numpy() @ vectors(columns[0]).reshape(-1, size), columns[2].to_numpy().sum())

    return summed(rows, ["v", "weight", "part"], make, size + 1)


# ---- classes


def hinge(df: DataFrame, vector: str, label: str) -> tuple[Risk, int]:
    """Mean of 1 - y * score, where above 0, of rows with label y of 1 or -1; and the number of weights."""
    rows = materialize(usable(df, vector).filter(F.col(label).isin(1, -1)).select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y")), "classes")
    first = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size")).first()
    if not first.n:
        raise ValueError("no row to learn from")

    def risk(w: np.ndarray) -> tuple[float, np.ndarray]:
        short = 1 - F.col("y") * score("v", w)
        parts = rows.withColumn("part", F.greatest(short, F.lit(0.0))).withColumn("weight", F.when(F.col("part") > 0, -F.col("y")).otherwise(0.0))
        total = _weighted(parts, first.size) / first.n
        return float(total[-1]), total[:-1]

    return risk, first.size


def linear_machine(df: DataFrame, vector: str, label: str, c: float = 1.0, **settings) -> Fit:
    """A linear support vector machine without an offset; give vectors a constant component for one."""
    risk, size = hinge(df, vector, label)
    return minimise(risk, size, c, **settings)


# ---- ranks


#: How many relevant and other rows a row stands for.
_RELS, _OTHERS = "rel * c", "(1 - rel) * c"


def _pairs(df: DataFrame, query: str, relevant: str, vector: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows (q, rel, v, c), equal ones once with their number c, the relevant and other rows of each query, the pairs of all and the number of weights."""
    rows = usable(df, vector).filter(F.col(query).isNotNull() & F.col(relevant).isNotNull())
    rows = rows.select(F.col(query).alias("q"), F.col(relevant).cast("int").alias("rel"), F.col(vector).cast("array<double>").alias("v"))
    rows = materialize(rows.groupBy("q", "rel", "v").agg(F.count("*").alias("c")), "ranks")
    sizes = materialize(rows.groupBy("q").agg(F.sum(F.expr(_RELS)).cast("double").alias("rels"), F.sum(F.expr(_OTHERS)).cast("double").alias("others")), "ranks")
    first = sizes.agg(F.sum(F.col("rels") * F.col("others")).alias("pairs")).first()
    return rows, sizes, first.pairs or 0, rows.agg(F.max(F.size("v"))).first()[0] or 0


def _violations(rows: DataFrame, sizes: DataFrame, w: np.ndarray) -> DataFrame:
    """rows with weight and part: the pairs of the rows it stands for that are less than 1 apart in score, negative for relevant rows, and their share of the loss.

    In the order of scores, relevant ones lowered by 1, a relevant row's pairs are the others behind it and another row's the
    relevant ones before it. Both are running counts over the order of queries and scores, in ranges, so a query
    of any size is split.
    """
    at = rows.withColumn("s", score("v", w)).withColumn("t", F.col("s") - F.col("rel"))
    order = [F.asc("q"), F.asc("t"), F.asc("rel"), F.asc(F.xxhash64("v"))]
    counted = staged(lambda: running(at, order, {"_rels": F.expr(_RELS).cast("double"), "_others": F.expr(_OTHERS).cast("double")}), "counted")
    start = counted.groupBy("q").agg(F.min(F.col("_rels") - F.expr(_RELS)).alias("_r0"), F.min(F.col("_others") - F.expr(_OTHERS)).alias("_o0"))
    whole = counted.join(start.join(sizes, "q"), "q")
    relevant = F.col("rel") == 1
    n = F.when(relevant, F.col("others") - (F.col("_others") - F.col("_o0"))).otherwise(F.col("_rels") - F.col("_r0"))
    n = n * F.col("c")
    out = whole.withColumn("weight", F.when(relevant, -n).otherwise(n)).withColumn("part", F.when(relevant, n * (1 - F.col("s"))).otherwise(n * F.col("s")))
    held = materialize(out.select("v", "weight", "part"), "violations")
    discard(counted)
    return held


def ranking(df: DataFrame, query: str, relevant: str, vector: str) -> tuple[Risk, int]:
    """Mean of 1 - score + other score, where above 0, over all pairs of a relevant row and another of its query; and the number of weights.

    Rows with the same query, score and kind are equal pairs; a query without both kinds has none. Nulls and unusable vectors
    don't take part; a table without pairs is an error.
    """
    rows, sizes, pairs, size = _pairs(df, query, relevant, vector)
    if not pairs:
        raise ValueError("no pair to learn from")

    def risk(w: np.ndarray) -> tuple[float, np.ndarray]:
        found = _violations(rows, sizes, w)
        total = _weighted(found, size) / pairs
        discard(found)
        return float(total[-1]), total[:-1]

    return risk, size


def rank_machine(df: DataFrame, query: str, relevant: str, vector: str, c: float = 1.0, **settings) -> Fit:
    """Weights that put relevant rows of a query before its other rows."""
    risk, size = ranking(df, query, relevant, vector)
    return minimise(risk, size, c, **settings)


def right_order(df: DataFrame, query: str, relevant: str, vector: str, weights: np.ndarray) -> float:
    """Share of pairs whose relevant row scores higher; equal scores count as wrong."""
    rows, sizes, pairs, _ = _pairs(df, query, relevant, vector)
    if not pairs:
        raise ValueError("no pair to judge")
    at = rows.withColumn("s", score("v", weights))
    order = [F.asc("q"), F.asc("s"), F.desc("rel"), F.asc(F.xxhash64("v"))]
    counted = staged(lambda: running(at, order, {"_others": F.expr(_OTHERS).cast("double")}), "counted")
    start = counted.groupBy("q").agg(F.min(F.col("_others") - F.expr(_OTHERS)).alias("_o0"))
    return (counted.filter("rel = 1").join(start, "q").agg(F.sum((F.col("_others") - F.col("_o0")) * F.col("c"))).first()[0] or 0.0) / pairs


# ---- sequences


@dataclass(frozen=True)
class Labels:
    """How weights are laid out: one a pair of following labels, then one a label and symbol."""

    labels: int
    symbols: int

    @property
    def size(self) -> int:
        return self.labels * (self.labels + self.symbols)

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of following labels, and of labels by symbols."""
        cut = self.labels * self.labels
        return w[:cut].reshape(self.labels, self.labels), w[cut:].reshape(self.labels, self.symbols)

    def counts(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How often a labelled sequence uses each weight."""
        out = np.zeros(self.size)
        np.add.at(out, y[:-1] * self.labels + y[1:], 1)
        np.add.at(out, self.labels * self.labels + y * self.symbols + x, 1)
        return out

    def best(self, w: np.ndarray, x: np.ndarray, avoid: np.ndarray | None = None, loss: float = 1.0) -> tuple[np.ndarray, float]:
        """The labelling with the highest score, ties to the smaller labels from the end, and that score; each label other than avoid's adds loss."""
        follow, emit = self.parts(w)
        own = emit[:, x].T
        if avoid is not None:
            own = own + loss
            own[np.arange(len(x)), avoid] -= loss
        n = len(x)
        total, back = own[0], np.zeros((n, self.labels), dtype=np.int64)
        for i in range(1, n):
            through = total[:, None] + follow
            back[i] = through.argmax(0)
            total = through[back[i], np.arange(self.labels)] + own[i]
        y = np.empty(n, dtype=np.int64)
        y[-1] = int(total.argmax())
        for i in range(n - 1, 0, -1):
            y[i - 1] = back[i, y[i]]
        return y, float(total.max())


def _sequences(df: DataFrame, symbols: str, labels: str, shape: Labels) -> DataFrame:
    """Rows (x, y) that are whole: as many labels as symbols, none null, all in range, at least one."""

    def inside(column: str, n: int) -> Column:
        return F.forall(column, lambda v: v.isNotNull() & (v >= 0) & (v < n))

    rows = df.select(F.col(symbols).cast("array<int>").alias("x"), F.col(labels).cast("array<int>").alias("y"))
    return rows.filter((F.size("x") > 0) & (F.size("x") == F.size("y")) & inside("x", shape.symbols) & inside("y", shape.labels))


def labelling(df: DataFrame, symbols: str, labels: str, shape: Labels, loss: float = 1.0) -> Risk:
    """Mean over sequences of the highest score of a labelling plus loss a wrong label, less the score of the true one.

    Sequences are decoded in Arrow batches, each in time of its length; what leaves a task is one sum a weight.
    """
    rows = materialize(_sequences(df, symbols, labels, shape), "sequences")
    n = rows.count()
    if not n:
        raise ValueError("no sequence to learn from")

    def risk(w: np.ndarray) -> tuple[float, np.ndarray]:
        def make(columns: list[pa.Array]) -> np.ndarray:
            out = np.zeros(shape.size + 1)
            for xs, ys in zip(columns[0], columns[1], strict=True):
                x, y = np.array(xs.as_py()), np.array(ys.as_py())
                found, top = shape.best(w, x, y, loss)
                true = shape.counts(x, y)
                out[:-1] += shape.counts(x, found) - true
                out[-1] += max(top - float(true @ w), 0.0)
            return out

        total = summed(rows, ["x", "y"], make, shape.size + 1) / n
        return float(total[-1]), total[:-1]

    return risk


def label_machine(df: DataFrame, symbols: str, labels: str, shape: Labels, c: float = 1.0, loss: float = 1.0, **settings) -> Fit:
    """Weights of a sequence labeller; the number of weights, which the driver holds, follows labels and symbols."""
    return minimise(labelling(df, symbols, labels, shape, loss), shape.size, c, **settings)


def labelled(df: DataFrame, symbols: str, shape: Labels, weights: np.ndarray, out: str = "labelled") -> DataFrame:
    """df with the best labels of each symbol sequence; null for null, empty and out-of-range ones."""
    df = df.drop(out)
    at = df.columns.index(symbols)

    def run(batches):
        for b in batches:
            found = []
            for x in b.column(at).to_pylist():
                whole = x and all(v is not None and 0 <= v < shape.symbols for v in x)
                found.append(shape.best(weights, np.array(x))[0].tolist() if whole else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


# ---- queries

#: Weights at which the queries take risks.
AT = (0.8, -0.5, 0.3)


def _lines(s, d):
    """Lines with three measures; dear ones are relevant, years are the queries."""
    li, dear = table(s, d, "lineitem"), F.col("l_extendedprice").cast("double") > 40_000
    v = F.array(F.col("l_quantity").cast("double") / 25.0, F.col("l_discount").cast("double") * 20.0, F.col("l_tax").cast("double") * 25.0)
    return li.select(F.year("l_shipdate").alias("year"), dear.alias("dear"), v.alias("v"), F.when(dear, 1).otherwise(-1).alias("y"))


def _answer(s, risk, size):
    value, slope = risk(np.array(AT))
    row = [float(round(value, 6)), *[float(round(x, 6)) for x in slope]]
    return s.createDataFrame([tuple(x + 0.0 for x in row)], ", ".join(f"{n} double" for n in ["risk", *[f"slope{i}" for i in range(size)]]))


def _weights(s, fit: Fit):
    return s.createDataFrame([(i, float(round(w, 2)) + 0.0) for i, w in enumerate(fit.weights)], "place int, weight double")


QUERIES = {
    "ranking_risk": lambda s, d: _answer(s, *ranking(_lines(s, d), "year", "dear", "v")),
    "hinge_risk": lambda s, d: _answer(s, *hinge(_lines(s, d), "v", "y")),
    "rank_machine": lambda s, d: _weights(s, rank_machine(_lines(s, d), "year", "dear", "v", 10.0, close=1e-3, most=12)),
}
_LINES = "l AS (SELECT year(l_shipdate) AS q, (l_extendedprice::DOUBLE > 40000)::INT AS rel, l_quantity::DOUBLE / 25.0 AS a, l_discount::DOUBLE * 20.0 AS b, l_tax::DOUBLE * 25.0 AS c FROM lineitem)"
_SCORED = f"{_LINES}, s AS (SELECT *, 0.0::DOUBLE + a * {AT[0]}::DOUBLE + b * {AT[1]}::DOUBLE + c * {AT[2]}::DOUBLE AS s FROM l)"
ORACLES = {
    "ranking_risk": f"""WITH {_SCORED}, o AS (SELECT *, sum(1 - rel) OVER w AS others, sum(rel) OVER w AS rels, sum(1 - rel) OVER (PARTITION BY q) AS all_others FROM s WINDOW w AS (PARTITION BY q ORDER BY s - rel, rel)),
n AS (SELECT *, CASE WHEN rel = 1 THEN all_others - others ELSE rels END AS n FROM o), p AS (SELECT sum(r * o)::DOUBLE AS pairs FROM (SELECT sum(rel) AS r, sum(1 - rel) AS o FROM l GROUP BY q))
SELECT round(sum(CASE WHEN rel = 1 THEN n * (1 - s) ELSE n * s END) / max(pairs), 6) AS risk, round(sum((1 - 2 * rel) * n * a) / max(pairs), 6) AS slope0, round(sum((1 - 2 * rel) * n * b) / max(pairs), 6) AS slope1,
round(sum((1 - 2 * rel) * n * c) / max(pairs), 6) AS slope2 FROM n, p""",
    "hinge_risk": f"""WITH {_SCORED}, h AS (SELECT *, 2 * rel - 1 AS y, 1 - (2 * rel - 1) * s AS m FROM s)
SELECT round(avg(greatest(m, 0)), 6) AS risk, round(sum(CASE WHEN m > 0 THEN -y * a ELSE 0 END) / count(*), 6) AS slope0, round(sum(CASE WHEN m > 0 THEN -y * b ELSE 0 END) / count(*), 6) AS slope1,
round(sum(CASE WHEN m > 0 THEN -y * c ELSE 0 END) / count(*), 6) AS slope2 FROM h""",
}
