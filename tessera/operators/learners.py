"""Learners that fit in a few distributed passes, and wrappers of the library's own."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.regression import IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import table


def gram(df: DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y (a constant last) and the row count by one aggregation; what reaches the driver is a square of the feature count."""
    cols = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    n = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(c * F.col(target)).alias(f"b{i}") for i, c in enumerate(cols)]
    row = df.dropna(subset=[*features, target]).agg(F.count("*").alias("n"), *sums).first()
    g = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g, np.array([row[f"b{i}"] or 0.0 for i in range(n)]), row.n


def ridge(df: DataFrame, features: list[str], target: str, strength: float = 0.0) -> np.ndarray:
    """Weights and constant that minimise squared error plus strength times squared weights; the constant is free."""
    g, b, _ = gram(df, features, target)
    penalty = strength * np.eye(len(b))
    penalty[-1, -1] = 0
    return np.linalg.lstsq(g + penalty, b, rcond=None)[0]


def predicted(features: list[str], weights: np.ndarray) -> Column:
    """The linear function as one generated expression."""
    return sum((F.col(f) * float(w) for f, w in zip(features, weights[:-1], strict=True)), F.lit(float(weights[-1])))


def discriminants(df: DataFrame, features: list[str], label: str, dims: int) -> np.ndarray:
    """Directions that separate classes best against their spread inside: rows are directions. One aggregation a class."""
    cols = [F.col(f).cast("double") for f in features]
    d = len(cols)
    sums = [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)] + [F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *sums).collect()
    total = sum(r.n for r in rows)
    means = np.array([[r[f"m{i}"] for i in range(d)] for r in rows])
    weight = np.array([r.n / total for r in rows])
    centre = weight @ means
    between = ((means - centre) * weight[:, None]).T @ (means - centre)
    within = np.zeros((d, d))
    for r, w in zip(rows, weight, strict=True):
        for i in range(d):
            for j in range(d):
                within[i, j] += w * r[f"c{min(i, j)}_{max(i, j)}"]
    values, vectors = np.linalg.eig(np.linalg.solve(within + 1e-9 * np.eye(d), between))
    order = np.argsort(-values.real)[:dims]
    return vectors.real[:, order].T


def canonical(df: DataFrame, left: list[str], right: list[str], k: int, ridge_: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left directions, right directions, correlations) of the k pairs of projections that agree most; one aggregation of covariances."""
    cols = [*left, *right]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.dropna(subset=cols).agg(*[F.covar_samp(F.col(cols[i]), F.col(cols[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    c = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        c[i, j] = c[j, i] = row[f"c{i}_{j}"]
    n = len(left)

    def whitening(m: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(m + ridge_ * np.eye(len(m)))
        return vectors / np.sqrt(np.maximum(values, 1e-12))

    wl, wr = whitening(c[:n, :n]), whitening(c[n:, n:])
    u, s, vt = np.linalg.svd(wl.T @ c[:n, n:] @ wr)
    return (wl @ u)[:, :k].T, (wr @ vt.T)[:, :k].T, s[:k]


def folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """A fold for each row by its key's hash: stable, no ordering."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(k)))


def cross_validated(df: DataFrame, key: str, features: list[str], target: str, k: int, strength: float = 0.0) -> DataFrame:
    """Predictions of each row by the ridge of the other folds."""
    x = folds(df, key, k)
    parts = [x.filter(F.col("fold") == i).withColumn("guess", predicted(features, ridge(x.filter(F.col("fold") != i), features, target, strength))) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _assembled(features: list[str]) -> list:
    return [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True)]


def linear_svm(df: DataFrame, features: list[str], label: str, strength: float = 0.01):
    """Two-class linear support vector machine; label 0 or 1."""
    return Pipeline(stages=[*_assembled(features), LinearSVC(featuresCol="_features", labelCol=label, regParam=strength)]).fit(df)


def multiclass(df: DataFrame, features: list[str], label: str, strength: float = 0.01):
    """One classifier a class, the highest score wins."""
    each = LogisticRegression(regParam=strength, featuresCol="_features", labelCol=label)
    return Pipeline(stages=[*_assembled(features), OneVsRest(classifier=each, featuresCol="_features", labelCol=label)]).fit(df)


def forest(df: DataFrame, features: list[str], target: str, trees: int = 100, min_leaf: int = 5, seed: int = 0):
    """Bagged regression trees over a third of the features each split."""
    return Pipeline(stages=[*_assembled(features), RandomForestRegressor(featuresCol="_features", labelCol=target, numTrees=trees, minInstancesPerNode=min_leaf, featureSubsetStrategy="onethird", seed=seed)]).fit(df)


def elastic_net(df: DataFrame, features: list[str], target: str, strength: float, mixing: float = 1.0):
    return Pipeline(stages=[*_assembled(features), LinearRegression(featuresCol="_features", labelCol=target, regParam=strength, elasticNetParam=mixing)]).fit(df)


def principal(df: DataFrame, features: list[str], k: int):
    """Standardised features projected on their k principal directions."""
    return Pipeline(stages=[*_assembled(features), PCA(k=k, inputCol="_features", outputCol="components")]).fit(df)


def isotonic(df: DataFrame, x: str, y: str):
    """The rising step function nearest to the points."""
    return Pipeline(stages=[VectorAssembler(inputCols=[x], outputCol="_x"), IsotonicRegression(featuresCol="_x", labelCol=y)]).fit(df)


def platt(df: DataFrame, score: str, positive: str) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + e ** (a * score + b)) is the chance of the positive class, with the usual smoothed targets; Newton steps, one aggregation each."""
    n = df.agg(F.sum(F.when(F.col(positive), 1.0).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(positive), 0.0).otherwise(1.0)).alias("q")).first()
    high, low = (n.p + 1) / (n.p + 2), 1 / (n.q + 2)
    t = F.when(F.col(positive), high).otherwise(low)
    a, b = 0.0, float(np.log((n.q + 1) / (n.p + 1)))
    s = F.col(score)
    for _ in range(25):
        p = 1 / (1 + F.exp(F.lit(a) * s + b))
        d1, d2 = t - p, p * (1 - p)
        m = df.agg(F.sum(s * d1).alias("ga"), F.sum(d1).alias("gb"), F.sum(s * s * d2).alias("h11"), F.sum(s * d2).alias("h21"), F.sum(d2).alias("h22")).first()
        step = np.linalg.solve(np.array([[m.h11 + 1e-12, m.h21], [m.h21, m.h22 + 1e-12]]), np.array([m.ga, m.gb]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _ridge_query(s, d):
    x = table(s, d, "lineitem")
    w = ridge(x, ["l_quantity"], "l_extendedprice")
    return x.select("l_orderkey", "l_linenumber", F.round(predicted(["l_quantity"], w), 2).alias("guess")).groupBy("guess").agg(F.count("*").alias("n"))


QUERIES = {"linear_regression": _ridge_query}
ORACLES = {
    "linear_regression": """WITH w AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT round(l_quantity * a + b, 2) AS guess, count(*) AS n FROM lineitem, w GROUP BY 1"""
}
