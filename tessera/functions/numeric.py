"""Sparse vectors, arrays as vectors and matrices, plane geometry, sets and hashes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import table


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


# sparse vectors: maps from index to value


def sparse_dot(a: Column, b: Column) -> Column:
    return _sum(F.map_values(F.map_zip_with(a, b, lambda k, x, y: _zero(x) * _zero(y))))


def sparse_distance2(a: Column, b: Column) -> Column:
    return _sum(F.map_values(F.map_zip_with(a, b, lambda k, x, y: (_zero(x) - _zero(y)) * (_zero(x) - _zero(y)))))


def sparse_add(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: _zero(x) + _zero(y))


def sparse_scale(a: Column, c: float) -> Column:
    return F.transform_values(a, lambda k, x: x * c)


def sparse_length2(a: Column) -> Column:
    return _sum(F.transform(F.map_values(a), lambda x: x * x))


def dense(a: Column, n: int) -> Column:
    """The first n places of a sparse vector as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _zero(F.try_element_at(a, i)))


def sparse_vectors(df: DataFrame, by: str, index: str, value: str) -> DataFrame:
    """(by, vector): values of equal index add up first."""
    return df.groupBy(by, index).agg(F.sum(value).alias("_v")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(index), F.col("_v"))))).alias("vector"))


# arrays as vectors


def normalized(a: Column) -> Column:
    """a over its length; a zero vector stays."""
    n = F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x)))
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / _sum(e))


# matrices as rows (i, j, v)


def matrix_vector(m: DataFrame, v: DataFrame) -> DataFrame:
    """(i, v) of a matrix times a vector (j, x): a join on the shared index and a sum."""
    return m.join(v, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def matrix_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of a product of two matrices in rows."""
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
    return a.select("i", F.col("j").alias("k"), "v").join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def trace(m: DataFrame) -> DataFrame:
    return m.filter("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


# points and boxes: x, y columns


def signed_distance(ax, ay, bx, by, px: Column, py: Column) -> Column:
    """Distance of a point to the line from a to b, positive on its left."""
    dx, dy = bx - ax, by - ay
    return (dx * (py - ay) - dy * (px - ax)) / F.sqrt(F.lit(1.0) * (dx * dx + dy * dy))


def rotated(cx: float, cy: float, px: Column, py: Column, angle: float) -> tuple[Column, Column]:
    """A point turned about a centre."""
    c, s = math.cos(angle), math.sin(angle)
    return (px - cx) * c - (py - cy) * s + cx, (px - cx) * s + (py - cy) * c + cy


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two directions, 0 to 180."""
    return F.degrees(F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by)))


def polygon_area(points: Column) -> Column:
    """Area of a polygon of structs (x, y) in order."""
    n = F.size(points)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: points[i]["x"] * points[(i + 1) % n]["y"] - points[(i + 1) % n]["x"] * points[i]["y"])
    return F.when(n >= 3, F.abs(_sum(terms)) / 2).otherwise(0.0)


def box_intersection(a: list[Column], b: list[Column]) -> list[Column]:
    """The box that two boxes (left, top, right, bottom) share; empty where right < left or bottom < top."""
    return [F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise from the leftmost lowest."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(order):
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def hulls(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, pos, x, y) of each group's hull. A first pass keeps only the extremes of each column of x, so a large group arrives small."""
    kinds = dict(df.dtypes)
    ends = df.groupBy(by, x).agg(F.min(y).alias("a"), F.max(y).alias("b")).select(by, F.col(x).cast("double").alias("x"), F.explode(F.array("a", "b")).alias("y"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        h = convex_hull(f[["x", "y"]].to_numpy(dtype=float))
        return pd.DataFrame({by: f[by].iloc[0], "pos": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    return ends.select(by, "x", F.col("y").cast("double").alias("y")).groupBy(by).applyInPandas(run, f"`{by}` {kinds[by]}, pos long, x double, y double")


# sets


def set_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the intersection, union and both differences of two one-column tables, as sets: one aggregation over tagged rows."""
    name = a.columns[0]
    tagged = a.select(F.col(name).alias("v"), F.lit(1).alias("s")).unionByName(b.select(F.col(b.columns[0]).alias("v"), F.lit(2).alias("s")))
    sides = tagged.groupBy("v").agg(F.bit_or("s").alias("s"))
    return sides.agg(*[F.count(F.when(F.col("s").isin(k), 1)).alias(n) for n, k in (("shared", [3]), ("either", [1, 2, 3]), ("only_a", [1]), ("only_b", [2]))])


# hashes


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two integers."""
    return F.bit_count(a.bitwiseXOR(b))


def murmur3(data: bytes, seed: int = 0) -> int:
    """The public 32-bit Murmur3 of bytes."""
    c1, c2, h, mask = 0xCC9E2D51, 0x1B873593, seed, 0xFFFFFFFF

    def scramble(k: int) -> int:
        k = k * c1 & mask
        return ((k << 15 | k >> 17) & mask) * c2 & mask

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if len(data) > whole:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def murmur3_all(values: list[bytes], seed: int = 0) -> np.ndarray:
    """The Murmur3 of many byte strings at once: a step takes one word of every string that still has one, the longest first."""
    size = np.array([len(v) for v in values], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    starts = np.cumsum((size + 3) // 4) - (size + 3) // 4
    words = np.frombuffer(b"".join(values[i] + b"\0" * (-len(values[i]) % 4) for i in order), dtype="<u4")
    h = np.full(len(values), seed, dtype=np.uint32)

    def turned(x: np.ndarray, k: int) -> np.ndarray:
        return x << np.uint32(k) | x >> np.uint32(32 - k)

    def scramble(k: np.ndarray) -> np.ndarray:
        return turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    whole = size // 4
    for k in range(int(whole[0]) if len(whole) else 0):
        n = int(np.searchsorted(-whole, -k, "left"))  # strings with more than k whole words
        h[:n] = turned(h[:n] ^ scramble(words[starts[:n] + k]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    rest = np.flatnonzero(size % 4)
    h[rest] ^= scramble(words[starts[rest] + whole[rest]])
    h ^= size.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    out = np.empty_like(h)
    out[order] = h ^ h >> np.uint32(16)
    return out


def hashed(df: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """df and the Murmur3 of a string column, null for null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(column)
            values = murmur3_all([v or b"" for v in texts.cast(pa.binary()).to_pylist()], seed).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, mask=texts.is_null().to_numpy(zero_copy_only=False))], names=[*b.schema.names, "murmur"])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("murmur", T.LongType())]))


def _baskets(s, d):
    x = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return sparse_vectors(x, "l_suppkey", "p_size", "l_quantity")


def _sparse(s, d):
    v = _baskets(s, d)
    base = v.filter("l_suppkey = 1").select(F.col("vector").alias("c"))  # one row
    a, c = F.col("vector"), F.col("c")
    return v.crossJoin(F.broadcast(base)).select(
        "l_suppkey", F.round(sparse_dot(a, c), 2).alias("dot"), F.round(sparse_distance2(a, c), 2).alias("dist"), F.round(sparse_length2(sparse_add(a, sparse_scale(c, 2.0))), 2).alias("sum2"),
        F.round(_sum(F.slice(dense(a, 60), 1, 10)), 2).alias("head"),
    )


def _matrix(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


def _points(s, d):
    return table(s, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("y"), F.col("c_custkey").cast("double").alias("x"))


def _geometry(s, d):
    x, y = F.col("x"), F.col("y")
    rx, ry = rotated(10.0, 20.0, x, y, 0.5)
    return _points(s, d).select("c_custkey", F.round(signed_distance(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0), x, y), 4).alias("off"), F.round(rx, 4).alias("rx"), F.round(ry, 4).alias("ry"), F.round(angle_between(x + 1, y, F.lit(1.0), F.lit(0.0)), 4).alias("deg"))


def _areas(s, d):
    h = hulls(_points(s, d), "c_nationkey", "x", "y")
    pts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return h.groupBy("c_nationkey").agg(F.count("*").alias("corners"), pts.alias("p")).select("c_nationkey", "corners", F.round(polygon_area(F.col("p")), 2).alias("area"))


def softmax_rows(df: DataFrame, by: str, value: str) -> DataFrame:
    """df with p, the soft-max of a value among all rows of its group, and unit, the value over the group's length.

    Groups may be large: both sums combine before the shuffle, and no array of a group is built.
    """
    v = F.col(value)
    top = df.groupBy(by).agg(F.max(v).alias("_top"), F.sqrt(F.sum(v.cast("double") * v)).alias("_len"))
    x = df.join(top, by)
    total = x.groupBy(by).agg(F.sum(F.exp(v - F.col("_top"))).alias("_sum"))
    out = x.join(total, by).withColumns({"p": F.exp(v - F.col("_top")) / F.col("_sum"), "unit": F.coalesce(F.try_divide(v.cast("double"), F.col("_len")), F.lit(0.0))})
    return out.drop("_top", "_len", "_sum")


def _soft(s, d):
    x = softmax_rows(table(s, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 500).alias("v")), "c_nationkey", "v")
    return x.select("c_custkey", "c_nationkey", F.round("p", 9).alias("p"), F.round("unit", 6).alias("unit"))


QUERIES = {
    "sparse_vectors": _sparse,
    "matrix_vector": lambda s, d: matrix_vector(_matrix(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("j"), F.col("s_acctbal").alias("x"))).select("i", F.round("v", 2).alias("v")),
    "matrix_product": lambda s, d: matrix_matrix(_matrix(s, d), _matrix(s, d).select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).select("i", "j", F.round("v", 2).alias("v")),
    "matrix_trace": lambda s, d: trace(_matrix(s, d)),
    "plane_geometry": _geometry,
    "hull_areas": _areas,
    "softmax": _soft,
    "set_operations": lambda s, d: set_report(table(s, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey"), table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey")),
    "bit_functions": lambda s, d: table(s, d, "part").select("p_partkey", hamming(F.col("p_partkey"), F.lit(12345)).cast("int").alias("far"), F.bit_count("p_partkey").cast("int").alias("ones")),
    "murmur_hash": lambda s, d: hashed(table(s, d, "part").select("p_partkey", "p_name"), "p_name"),
}

_BASKET = "q AS (SELECT l_suppkey AS s, p_size AS k, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), c AS (SELECT k, v FROM q WHERE s = 1), g AS (SELECT s, k FROM (SELECT DISTINCT s FROM q), (SELECT DISTINCT k FROM q))"
_M = "m AS (SELECT l_linenumber::BIGINT AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
ORACLES = {
    "sparse_vectors": f"""WITH {_BASKET}, z AS (SELECT g.s, g.k, coalesce(q.v, 0) AS a, coalesce(c.v, 0) AS b FROM g LEFT JOIN q ON g.s = q.s AND g.k = q.k LEFT JOIN c ON g.k = c.k)
SELECT s AS l_suppkey, round(sum(a * b), 2) AS dot, round(sum((a - b) * (a - b)), 2) AS dist, round(sum((a + 2 * b) * (a + 2 * b)), 2) AS sum2, round(coalesce(sum(a) FILTER (k < 10), 0), 2) AS head FROM z GROUP BY 1""",
    "matrix_vector": f"WITH {_M} SELECT i, round(sum(v * s_acctbal), 2) AS v FROM m JOIN supplier ON j = s_suppkey GROUP BY 1",
    "matrix_product": f"WITH {_M} SELECT a.i, b.i AS j, round(sum(a.v * b.v), 2) AS v FROM m a JOIN m b ON a.j = b.j GROUP BY 1, 2",
    "matrix_trace": f"WITH {_M} SELECT coalesce(sum(v), 0.0) AS trace FROM m WHERE i = j",
    "plane_geometry": """SELECT c_custkey, round((3.0 * y - 4.0 * x) / 5.0, 4) AS off, round((x - 10) * cos(0.5) - (y - 20) * sin(0.5) + 10, 4) AS rx, round((x - 10) * sin(0.5) + (y - 20) * cos(0.5) + 20, 4) AS ry,
  round(degrees(abs(atan2((x + 1) * 0.0 - y * 1.0, x + 1))), 4) AS deg FROM (SELECT c_custkey, c_custkey::DOUBLE AS x, c_acctbal AS y FROM customer)""",
    "softmax": """WITH a AS (SELECT c_custkey, c_nationkey, c_acctbal / 500 AS v FROM customer), e AS (SELECT *, exp(v - max(v) OVER w) AS e, sqrt(sum(v * v) OVER w) AS n FROM a WINDOW w AS (PARTITION BY c_nationkey))
SELECT c_custkey, c_nationkey, round(e / sum(e) OVER (PARTITION BY c_nationkey), 9) AS p, round(coalesce(v / nullif(n, 0), 0), 6) AS unit FROM e""",
    "set_operations": """WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS shared, (SELECT count(*) FROM (FROM a UNION FROM b)) AS either, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_b""",
    "bit_functions": "SELECT p_partkey, bit_count(xor(p_partkey, 12345))::INT AS far, bit_count(p_partkey)::INT AS ones FROM part",
}
