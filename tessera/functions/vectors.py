"""Kernels, geometry and numeric functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.session import table


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance2(a: Column, b: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def linear(a: Column, b: Column) -> Column:
    return dot(a, b)


def polynomial(a: Column, b: Column, gamma: float, coef: float, degree: float) -> Column:
    return F.pow(F.lit(gamma) * dot(a, b) + coef, F.lit(degree))


def radial(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-F.lit(gamma) * distance2(a, b))


def sigmoid(a: Column, b: Column, gamma: float, coef: float) -> Column:
    return F.tanh(F.lit(gamma) * dot(a, b) + coef)


def histogram_intersection(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def log1pexp(x: Column) -> Column:
    """log(1 + e ** x) without overflow."""
    return F.when(x > 37, x).otherwise(F.log1p(F.exp(F.least(x, F.lit(37.0)))))


def safe_log(x: Column, least: float = 1e-10) -> Column:
    return F.ln(F.greatest(x, F.lit(least)))


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (left, top, right, bottom), edges included."""

    def area(left: Column, top: Column, right: Column, bottom: Column) -> Column:
        return F.greatest(right - left + 1, F.lit(0)) * F.greatest(bottom - top + 1, F.lit(0))

    inner = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    return F.coalesce(F.try_divide(inner.cast("double"), area(*a) + area(*b) - inner), F.lit(0.0))


def _pairs(s, d):
    """Each vector beside the first."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    first = e.filter("vec_id = 0").select(F.col("embedding").alias("c"))  # one row
    return e.crossJoin(F.broadcast(first))


def _kernels(s, d):
    a, b = F.col("embedding"), F.col("c")
    return _pairs(s, d).select(
        "vec_id", F.round(linear(a, b), 5).alias("linear"), F.round(polynomial(a, b, 0.5, 1.0, 2.0), 5).alias("poly"), F.round(radial(a, b, 0.5), 5).alias("rbf"),
        F.round(sigmoid(a, b, 0.5, 0.1), 5).alias("sigmoid"), F.round(histogram_intersection(a, b), 5).alias("hist"), F.round(cosine(a, b), 5).alias("cosine"),
    )


def _boxes(s, d):
    x = table(s, d, "part").select("p_partkey", F.col("p_size").alias("z"), (F.col("p_partkey") % 40).cast("int").alias("k"))
    box = [F.col("k"), F.col("k") + 1, F.col("k") + F.col("z"), F.col("k") + 20]
    return x.select("p_partkey", F.round(overlap(box, [F.lit(10), F.lit(10), F.lit(35), F.lit(35)]), 6).alias("iou"))


QUERIES = {
    "kernels": _kernels,
    "box_overlap": _boxes,
    "stable_logs": lambda s, d: table(s, d, "supplier").select("s_suppkey", F.round(log1pexp(F.col("s_acctbal") / 100), 6).alias("soft"), F.round(safe_log(F.col("s_acctbal")), 6).alias("log")),
}

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
ORACLES = {
    "kernels": f"""WITH p AS (SELECT e.vec_id, e.embedding AS a, f.embedding AS b FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) f),
k AS (SELECT vec_id, {_DOT.format(a='a', b='b')} AS d, {_DOT.format(a='a', b='a')} AS aa, {_DOT.format(a='b', b='b')} AS bb,
  list_sum(list_transform(list_zip(a, b), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS q, list_sum(list_transform(list_zip(a, b), lambda p: least(p[1], p[2])::DOUBLE)) AS h FROM p)
SELECT vec_id, round(d, 5) AS linear, round(pow(0.5 * d + 1, 2), 5) AS poly, round(exp(-0.5 * q), 5) AS rbf, round(tanh(0.5 * d + 0.1), 5) AS sigmoid, round(h, 5) AS hist, round(d / sqrt(aa * bb), 5) AS cosine FROM k""",
    "box_overlap": """WITH x AS (SELECT p_partkey, p_size AS z, (p_partkey % 40)::INT AS k FROM part),
b AS (SELECT p_partkey, greatest(least(k + z, 35) - greatest(k, 10) + 1, 0) * greatest(least(k + 20, 35) - greatest(k + 1, 10) + 1, 0) AS i, greatest(z + 1, 0) * 20 AS own FROM x)
SELECT p_partkey, round(i::DOUBLE / (own + 26 * 26 - i), 6) AS iou FROM b""",
    "stable_logs": """SELECT s_suppkey, round(CASE WHEN s_acctbal / 100 > 37 THEN s_acctbal / 100 ELSE ln(1 + exp(least(s_acctbal / 100, 37.0))) END, 6) AS soft, round(ln(greatest(s_acctbal, 1e-10)), 6) AS log FROM supplier""",
}
