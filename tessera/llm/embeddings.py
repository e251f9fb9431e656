"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, components.

Equal vectors become one class first. Each class is hashed in every table to the
signs of its dot products with that table's hyperplanes; classes that share a
table's code meet in a bucket and are compared exactly, in double precision. A
pair counts in the first table where its codes agree, so a pair that meets often
counts once and nothing has to be de-duplicated. Buckets of any size are cut into
block pairs. Bits follow the number of classes so that buckets keep their size;
the number of tables follows from bits, threshold and the recall asked for, so the
vectors are shuffled that many times: that is the price of this method.

Edge cases: null or zero vectors and those with null or non-finite components
link with nothing; vectors of different lengths never link; every row is a vector
of its own, repeated ids and rows included; a null vec_id takes part and is never
a component's id unless alone; an empty table gives no row; extra columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.operators.components import components
from tessera.plans.shared import materialize

BUCKET, BLOCK, SEED = 256, 512, 20_24
HASHED = "key long, id long, m long, codes binary, vector binary"


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for n vectors: about BUCKET vectors a bucket, and the chance that a pair at the threshold meets at least recall."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / BUCKET))) if n else 4
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision over their largest component, so that no square or product overflows or vanishes."""
    x = x.astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _hash(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """A row a class and table: bucket key, id, members, codes of all tables, unit vector in double precision's source form."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            ids, members, vectors = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            size = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy()
            starts = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                pick = np.flatnonzero(size == dim)
                x = flat[starts[pick][:, None] + np.arange(dim)]
                if dim not in planes:
                    planes[dim] = _planes(dim, bits, tables)
                sign = (scaled(x) @ planes[dim] > 0).reshape(len(pick), tables, bits)
                codes = (sign * weight).sum(2)
                key = (np.int64(dim) << np.int64(44)) ^ (np.arange(tables, dtype=np.int64) << np.int64(34)) ^ codes
                raw, own = [v.tobytes() for v in x], [c.astype(np.int32).tobytes() for c in codes]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[:, t]), pa.array(ids[pick]), pa.array(members[pick]), pa.array(own, pa.binary()), pa.array(raw, pa.binary())], names=["key", "id", "m", "codes", "vector"]
                    )

    return classes.mapInArrow(run, HASHED)


def _links(dealt: DataFrame, kind: str, tables: int, threshold: float) -> DataFrame:
    def kernel(t: pa.Table):
        ids, m = t["id"].to_numpy(), t["m"].to_numpy()
        x = scaled(np.frombuffer(b"".join(t["vector"].to_pylist()), dtype=kind).reshape(len(ids), -1))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), dtype=np.int32).reshape(len(ids), tables)
        table = int(t["key"][0].as_py() >> 34 & 0x3FF)
        linked = (x @ x.T >= threshold) & blocks.pair_mask(t["_block"].to_numpy(), t["_i"][0].as_py() == t["_j"][0].as_py())
        if linked.any() and table:
            a, b = np.nonzero(linked)
            met = (codes[a, :table] == codes[b, :table]).any(1)
            linked[a[met], b[met]] = False
        return ids, linked @ m, blocks.forest(ids, linked)

    keys = ["key", "_i", "_j"]
    return dealt.mapInArrow(lambda batches: blocks.stream(batches, keys, kernel), blocks.FOUND)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    kind = "<f8" if dict(vectors.dtypes)[column] == "array<double>" else "<f4"
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(finite, F.lit(False)), v))
    rows = rows.withColumn("cid", F.when(v.isNotNull(), F.xxhash64(v)))
    classes = materialize(rows.filter("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("m"), F.first("v").alias("v"), F.min("vec_id").alias("least")), "classes")
    bits, tables = plan(classes.count(), threshold, recall)
    hashed = _hash(classes.select("cid", "m", "v"), bits, tables)
    sizes = materialize(hashed.groupBy("key").agg(F.count("*").alias("_c")).filter("_c > 1"), "buckets")
    found = materialize(_links(blocks.deal(hashed.join(sizes, "key"), "key", "id", "_c", BLOCK), kind, tables, threshold), "links")
    links = found.filter("other IS NULL").groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other IS NOT NULL"))
    return label(rows, classes, links, roots).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def label(rows: DataFrame, classes: DataFrame, links: DataFrame, roots: DataFrame, own: str = "vec_id") -> DataFrame:
    """rows (with cid) and n_links and component_id; classes has cid, m and least, links id and n, roots node and root.

    Small sides that an aggregation makes are written first, so that AQE can split a hot key of the large side.
    """
    about = classes.select("cid", "m", "least").join(links.withColumnRenamed("id", "cid"), "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    about = about.withColumn("root", F.coalesce("root", "cid"))
    about = materialize(about, "about")
    least = materialize(about.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    per_class = about.join(least, "root").select("cid", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.join(per_class, "cid", "left")
    return joined.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")).withColumn("component_id", F.coalesce("component_id", own))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 or more among all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
