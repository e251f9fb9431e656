"""Edge lists, components, communities, nearest neighbours and k-means."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.plans.prefix import numbered
from tessera.plans.shared import discard, materialize
from tessera.plans.session import table


def undirected(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """One row an unordered pair, its smallest weight; loops stay."""
    x = edges.select(F.least(a, b).alias("i1"), F.greatest(a, b).alias("i2"), F.col(weight).alias("w"))
    return x.groupBy("i1", "i2").agg(F.min("w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, loops once."""
    return edges.unionByName(edges.filter("i1 <> i2").select(F.col("i2").alias("i1"), F.col("i1").alias("i2"), "w"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Degree and total weight of each node."""
    return both_ways(edges).groupBy(F.col("i1").alias("node")).agg(F.count("*").alias("degree"), F.round(F.sum("w"), 4).alias("weight"))


def shortest_share(edges: DataFrame, share: float) -> DataFrame:
    """The given share of edges with the smallest weights, ties by pair; places come from distributed ranges, as the share grows with the table."""
    placed = numbered(edges, [F.asc("w"), F.asc("i1"), F.asc("i2")], "_place")
    return placed.filter(F.col("_place") <= int(edges.count() * share)).drop("_place")


def without_shortest(edges: DataFrame, share: float) -> DataFrame:
    """The edges that are not among the given share with the smallest weights."""
    placed = numbered(edges, [F.asc("w"), F.asc("i1"), F.asc("i2")], "_place")
    return placed.filter(F.col("_place") > int(edges.count() * share)).drop("_place")


def angular(df: DataFrame, key: str, vector: str, k: int, rounds: int = 10) -> tuple[list[list[float]], DataFrame]:
    """k-means by angle: vectors are put to length 1 and centres with them; zero vectors drop."""
    n = F.sqrt(F.aggregate(F.transform(vector, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    unit = df.withColumn("_n", n).filter("_n > 0").withColumn(vector, F.transform(vector, lambda x: F.try_divide(x, "_n"))).drop("_n")
    centres = seeds(unit, key, vector, k)
    for _ in range(rounds):
        near = assign(unit, key, vector, centres).select(key, "cluster")
        rows = unit.select(key, vector).join(near, key).select("cluster", F.posexplode(vector).alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x")).collect()
        new = [list(c) for c in centres]
        for row in rows:
            new[row.cluster][row.pos] = row.x
        new = [list(np.array(c) / (np.linalg.norm(c) or 1.0)) for c in new]
        done = np.allclose(new, centres)
        centres = new
        if done:
            break
    return centres, assign(unit, key, vector, centres)


def component_sizes(edges: DataFrame) -> DataFrame:
    """Root and size of each component."""
    return components(edges, "i1", "i2").groupBy("root").agg(F.count("*").alias("n"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of a labelling (node, label): weight inside communities less what chance would put there."""
    x = edges.join(labels.select(F.col("node").alias("i1"), F.col("label").alias("l1")), "i1").join(labels.select(F.col("node").alias("i2"), F.col("label").alias("l2")), "i2")
    ends = x.select(F.col("l1").alias("l"), "w").unionByName(x.select(F.col("l2").alias("l"), "w")).groupBy("l").agg(F.sum("w").alias("k"))
    inside = x.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("l1") == F.col("l2"), F.col("w")).otherwise(0)).alias("own"))
    return inside.crossJoin(F.broadcast(ends.agg(F.sum(F.col("k") * F.col("k")).alias("kk")))).select(F.round(F.col("own") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m")), 6).alias("q"))


def propagate(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, label): every node takes the label of most weight among its neighbours, all at once, ties to the smallest label."""
    links = materialize(both_ways(edges).filter("i1 <> i2"), "links")
    labels = links.select(F.col("i1").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("node", "i2"), "i2").groupBy("i1", "label").agg(F.round(F.sum("w"), 6).alias("v"))
        best = votes.groupBy("i1").agg(F.max(F.struct("v", (-F.col("label")).alias("n"))).alias("b"))
        last, labels = labels, materialize(best.select(F.col("i1").alias("node"), (-F.col("b.n")).alias("label")), "labels")
        discard(last)
    discard(links)
    return labels


def moral_graph(edges: DataFrame) -> DataFrame:
    """The undirected graph of a directed one with the parents of each child joined; parents pair up inside a child only."""
    parents = edges.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("p"))
    wed = parents.select(F.explode("p").alias("a"), "p").select("a", F.explode(F.expr("filter(p, x -> x > a)")).alias("b"))
    plain = edges.select(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b"))
    return plain.unionByName(wed).distinct()


def has_cycle(edges: DataFrame) -> bool:
    """Whether a directed graph (parent, child) has a cycle: nodes without incoming edges are peeled until none is left to peel."""
    now = materialize(edges.select("parent", "child").distinct(), "dag")
    while True:
        n = now.count()
        if not n:
            return False
        left = materialize(now.join(now.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi"), "dag")
        discard(now)
        if left.count() == n:
            discard(left)
            return True
        now = left


def symmetric(edges: DataFrame) -> DataFrame:
    """Number of edges (i1, i2) and of those whose reverse is missing."""
    back = edges.select(F.col("i2").alias("i1"), F.col("i1").alias("i2")).distinct().withColumn("there", F.lit(1))
    return edges.join(back, ["i1", "i2"], "left").agg(F.count("*").alias("n"), F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("one_way"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(src, dst, dist) of the k rows nearest to each query by squared distance, ties by id; a query set against all rows.

    Queries are cut into blocks; every task holds one block of queries beside its own rows, keeps k candidates a query, and
    an aggregation merges them. A block's result is written before the next block is read, so tasks and driver hold one
    block at a time, whatever the number of rows and queries.
    """
    import math

    n = queries.count()
    blocks = max(1, math.ceil(n / block))
    cut = queries.select(F.col(key).alias("qid"), F.col(vector).cast("array<double>").alias("qv"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))
    merged: DataFrame | None = None
    for b in range(blocks):
        held = [(r.qid, r.qv) for r in cut.filter(F.col("block") == b).select("qid", "qv").collect()]  # about one block
        part = materialize(_best(_scan(rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")), held, k), k), "nearest")
        merged = part if merged is None else merged.unionByName(part)
    return merged


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query of what tasks found: at most k rows a query and task."""
    best = found.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "dst"))), 1, k).alias("c"))
    return best.select("src", F.explode("c").alias("e")).select("src", "e.dst", F.round("e.dist", 5).alias("dist"))


def _scan(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    ids, q = np.array([i for i, _ in queries], dtype=np.int64), np.array([v for _, v in queries], dtype=np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for b in batches:
            own = b.column(0).to_numpy()
            x = np.array(b.column(1).to_pylist(), dtype=np.float64)
            for s in range(0, len(own), 2048):
                part, names = x[s : s + 2048], own[s : s + 2048]
                d = np.maximum((q * q).sum(1)[:, None] + (part * part).sum(1)[None, :] - 2 * q @ part.T, 0)
                d[ids[:, None] == names[None, :]] = np.inf
                d, i = np.concatenate([best_d, np.round(d, 9)], axis=1), np.concatenate([best_i, np.broadcast_to(names, d.shape)], axis=1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        on = np.isfinite(best_d)
        src = np.broadcast_to(ids[:, None], best_d.shape)[on]
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(best_i[on]), pa.array(best_d[on])], names=["src", "dst", "dist"])

    return rows.mapInArrow(run, "src long, dst long, dist double")


def sign_code(vector: Column, dim: int, bits: int, seed: int = 1) -> Column:
    """Random-projection code of a vector as a long; planes are drawn from a seed."""
    planes = np.random.default_rng(seed).standard_normal((bits, dim)).round(6)
    terms = [F.when(sum((vector[j] * float(p[j]) for j in range(1, dim)), vector[0] * float(p[0])) > 0, F.lit(1 << b)).otherwise(F.lit(0)) for b, p in enumerate(planes)]
    return sum(terms[1:], terms[0]).cast("long")


def seeds(df: DataFrame, key: str, vector: str, k: int) -> list[list[float]]:
    """k starting centres: the vector of the smallest key, then each time the one farthest from those so far."""
    centres = [list(df.orderBy(key).select(vector).first()[0])]
    for _ in range(k - 1):
        far = df.select(vector, key, F.least(*[distance2(F.col(vector), c) for c in centres], F.lit(float("inf"))).alias("d"))
        centres.append(list(far.agg(F.max(F.struct(F.round("d", 9).alias("d"), (-F.col(key)).alias("n"), F.col(vector).alias("v"))).alias("b")).first().b.v))
    return centres


def distance2(v: Column, centre: list[float]) -> Column:
    """Squared distance to a fixed centre."""
    c = F.array(*[F.lit(float(x)) for x in centre])
    return F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def assign(df: DataFrame, key: str, vector: str, centres: list[list[float]]) -> DataFrame:
    """(key, cluster, dist): the nearest centre, ties to the first."""
    found = F.array_min(F.array(*[F.struct(F.round(distance2(F.col(vector), c), 9).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    return df.select(key, found.alias("f")).select(key, F.col("f.i").alias("cluster"), F.round("f.d", 5).alias("dist"))


def kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int = 10) -> tuple[list[list[float]], DataFrame]:
    """Lloyd's rounds from the deterministic seeds until centres stay; k centres are all that reaches the driver."""
    centres = seeds(df, key, vector, k)
    for _ in range(rounds):
        near = assign(df, key, vector, centres).select(key, "cluster")
        rows = df.select(key, vector).join(near, key).select("cluster", F.posexplode(vector).alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x")).collect()
        new = [list(c) for c in centres]
        for row in rows:
            new[row.cluster][row.pos] = row.x
        if np.allclose(new, centres):
            break
        centres = new
    return centres, assign(df, key, vector, centres)


def _trade(s, d):
    """Parts ordered together with suppliers: a weighted graph between customers' nations and suppliers' nations."""
    li = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    li = li.join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.groupBy(F.col("c_nationkey").cast("long").alias("a"), F.col("s_nationkey").cast("long").alias("b")).agg(F.count("*").cast("double").alias("w"))


def _follow(s, d):
    """Sparse graph on parts: a supplier links the smallest part it ships to each other part of its lines."""
    x = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_partkey").alias("a"), F.collect_set("l_partkey").alias("p"))
    return x.select("a", F.explode("p").alias("b")).filter("a <> b").select(F.least("a", "b").alias("i1"), F.greatest("a", "b").alias("i2"), F.lit(1.0).alias("w")).distinct()


def _queries_and_rows(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return e.filter("vec_id % 50 = 0"), e


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


QUERIES = {
    "undirected_edges": lambda s, d: undirected(_trade(s, d), "a", "b", "w"),
    "both_directions": lambda s, d: both_ways(undirected(_trade(s, d), "a", "b", "w")),
    "neighbour_ranges": lambda s, d: neighbours(undirected(_trade(s, d), "a", "b", "w")),
    "shortest_edges": lambda s, d: shortest_share(undirected(_trade(s, d), "a", "b", "w"), 0.25),
    "longest_edges": lambda s, d: without_shortest(undirected(_trade(s, d), "a", "b", "w"), 0.25),
    "kmeans": lambda s, d: kmeans(_vectors(s, d), "vec_id", "embedding", 4, 5)[1],
    "angular_kmeans": lambda s, d: angular(_vectors(s, d), "vec_id", "embedding", 4, 5)[1],
    "connected_components": lambda s, d: components(_follow(s, d), "i1", "i2"),
    "component_sizes": lambda s, d: component_sizes(_follow(s, d)),
    "modularity": lambda s, d: modularity(undirected(_trade(s, d), "a", "b", "w"), table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("label"))),
    "label_propagation": lambda s, d: propagate(undirected(_trade(s, d), "a", "b", "w"), 2),
    "moral_graph": lambda s, d: moral_graph(table(s, d, "lineitem").select(F.col("l_orderkey").alias("child"), (-F.col("l_partkey")).alias("parent"))),
    "symmetric_edges": lambda s, d: symmetric(_trade(s, d).select(F.col("a").alias("i1"), F.col("b").alias("i2"))),
    "nearest_neighbours": lambda s, d: nearest(*_queries_and_rows(s, d), 5),
    "kmeans_step": lambda s, d: assign(_vectors(s, d), "vec_id", "embedding", seeds(_vectors(s, d), "vec_id", "embedding", 4)),
}

_TRADE = "t AS (SELECT c_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
_UND = f"{_TRADE}, u AS (SELECT least(a, b) AS i1, greatest(a, b) AS i2, min(w) AS w FROM t GROUP BY 1, 2), z AS (SELECT i1, i2, w FROM u UNION ALL SELECT i2, i1, w FROM u WHERE i1 <> i2)"
_FOLLOW = """f AS (SELECT l_suppkey, l_partkey, min(l_partkey) OVER (PARTITION BY l_suppkey) AS a FROM lineitem), e AS (SELECT DISTINCT least(a, l_partkey) AS x, greatest(a, l_partkey) AS y FROM f WHERE a <> l_partkey),
l AS (SELECT x AS p, y AS q FROM e UNION SELECT y, x FROM e), c(node, root) USING KEY (node) AS (SELECT p, min(least(p, q)) FROM l GROUP BY p
  UNION SELECT l.q, min(c.root) FROM c JOIN l ON l.p = c.node JOIN recurring.c AS k ON k.node = l.q WHERE c.root < k.root GROUP BY l.q)"""
_VOTE = """n{k} AS (SELECT i1 AS node, label FROM (SELECT z.i1, n{j}.label, row_number() OVER (PARTITION BY z.i1 ORDER BY round(sum(w), 6) DESC, n{j}.label) AS rn FROM z JOIN n{j} ON z.i2 = n{j}.node WHERE z.i1 <> z.i2 GROUP BY 1, 2) WHERE rn = 1)"""
_DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"

ORACLES = {
    "undirected_edges": f"WITH {_UND} SELECT * FROM u",
    "both_directions": f"WITH {_UND} SELECT * FROM z",
    "neighbour_ranges": f"WITH {_UND} SELECT i1 AS node, count(*) AS degree, round(sum(w), 4) AS weight FROM z GROUP BY 1",
    "shortest_edges": f"WITH {_UND} SELECT i1, i2, w FROM (SELECT *, row_number() OVER (ORDER BY w, i1, i2) AS rn FROM u) WHERE rn <= floor((SELECT count(*) FROM u) * 0.25)",
    "longest_edges": f"WITH {_UND} SELECT i1, i2, w FROM (SELECT *, row_number() OVER (ORDER BY w, i1, i2) AS rn FROM u) WHERE rn > floor((SELECT count(*) FROM u) * 0.25)",
    "connected_components": f"WITH RECURSIVE {_FOLLOW} SELECT * FROM c",
    "component_sizes": f"WITH RECURSIVE {_FOLLOW} SELECT root, count(*) AS n FROM c GROUP BY 1",
    "modularity": f"""WITH {_UND}, x AS (SELECT w, p.n_regionkey AS l1, q.n_regionkey AS l2 FROM u JOIN nation p ON i1 = p.n_nationkey JOIN nation q ON i2 = q.n_nationkey),
k AS (SELECT l, sum(w) AS k FROM (SELECT l1 AS l, w FROM x UNION ALL SELECT l2, w FROM x) GROUP BY 1)
SELECT round(sum(CASE WHEN l1 = l2 THEN w ELSE 0 END) / sum(w) - (SELECT sum(k * k) FROM k) / (4 * sum(w) * sum(w)), 6) AS q FROM x""",
    "label_propagation": f"WITH {_UND}, n0 AS (SELECT DISTINCT i1 AS node, i1 AS label FROM z WHERE i1 <> i2), {_VOTE.format(k=1, j=0)}, {_VOTE.format(k=2, j=1)} SELECT node, label FROM n2",
    "moral_graph": """WITH e AS (SELECT DISTINCT l_orderkey AS child, -l_partkey AS parent FROM lineitem)
SELECT least(parent, child) AS a, greatest(parent, child) AS b FROM e UNION SELECT x.parent, y.parent FROM e x JOIN e y ON x.child = y.child AND x.parent < y.parent""",
    "symmetric_edges": f"WITH {_TRADE} SELECT count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM t q WHERE q.a = t.b AND q.b = t.a)) AS one_way FROM t",
    "nearest_neighbours": f"""WITH p AS (SELECT q.vec_id AS src, e.vec_id AS dst, {_DIST.format(a='q.embedding', b='e.embedding')} AS dist FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)
SELECT src, dst, round(dist, 5) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS rn FROM p) WHERE rn <= 5""",
}


def random_pairs(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n random pairs of different rows' keys, the smaller first, distinct: two hashes of a counter pick two places in key order."""
    placed = numbered(rows.select(key), [F.asc(key)], "pos").withColumn("pos", F.col("pos") - 1)
    size = placed.count()
    draws = rows.sparkSession.range(n).select(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(size)).alias(c) for k, c in enumerate("ab")])
    ends = draws.join(placed.select(F.col("pos").alias("a"), F.col(key).alias("x")), "a").join(placed.select(F.col("pos").alias("b"), F.col(key).alias("y")), "b")
    return ends.filter("x <> y").select(F.least("x", "y").alias("i1"), F.greatest("x", "y").alias("i2")).distinct()


def nearest_by_code(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", bits: int = 64, seed: int = 1, block: int = 4096) -> DataFrame:
    """(src, dst, dist): the k rows nearest to each query; random-projection codes pass over rows that can hardly be among them.

    Vectors at an angle t differ in a binomial number of bits with chance t / pi. A task knows the k-th distance it
    has so far, so the widest angle of a nearer row of that length; a row with more differing bits than such a row has
    with a chance of 99 % is passed over, all others are ranked by true distance. The share of neighbours lost
    is at most about 1 %, whatever the number of rows. Queries go in blocks against all rows.
    """
    import math

    dim = len(rows.select(vector).filter(F.col(vector).isNotNull()).first()[0])
    planes = np.random.default_rng(seed).standard_normal((dim, bits))
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, math.ceil(queries.count() / block))
    found: DataFrame | None = None
    for i in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()  # about one block
        part = materialize(_best(_scan_codes(own, [r.id for r in held], np.array([r.v for r in held], dtype=np.float64).reshape(-1, dim), planes, k), k), "nearest")
        found = part if found is None else found.unionByName(part)
    return found


def most_bits(angle: np.ndarray, bits: int) -> np.ndarray:
    """Differing bits that a pair at the angle exceeds with a chance of about 1 %: a normal bound and a bit for the rounding."""
    p = angle / np.pi
    return bits * p + 2.33 * np.sqrt(bits * p * (1 - p)) + 1


def _scan_codes(rows: DataFrame, ids: list[int], q: np.ndarray, planes: np.ndarray, k: int) -> DataFrame:
    names, bits = np.array(ids, dtype=np.int64), planes.shape[1]
    ones = np.array([bin(b).count("1") for b in range(256)], dtype=np.int16)
    asked, q2 = np.packbits(q @ planes > 0, axis=1), (q * q).sum(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_i = np.full((len(names), k), np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
        for b in batches:
            own = b.column(0).to_numpy()
            x = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(len(own), -1)
            codes, x2 = np.packbits(x @ planes > 0, axis=1), (x * x).sum(1)
            for s in range(0, len(own), 512):
                part, part2, code, here = x[s : s + 512], x2[s : s + 512], codes[s : s + 512], own[s : s + 512]
                far = np.zeros((len(names), len(here)), dtype=np.int16)
                for c in range(code.shape[1]):
                    far += ones[asked[:, c, None] ^ code[None, :, c]]
                lengths = np.sqrt(q2[:, None] * part2[None, :])
                with np.errstate(divide="ignore", invalid="ignore"):
                    cos = (q2[:, None] + part2[None, :] - best_d[:, -1:]) / (2 * lengths)
                near = (far <= most_bits(np.arccos(np.clip(np.nan_to_num(cos, nan=-1.0), -1, 1)), bits)) | (lengths == 0)
                near &= names[:, None] != here[None, :]
                for i in np.flatnonzero(near.any(1)):
                    on = near[i]
                    d = np.round(((part[on] - q[i]) ** 2).sum(1), 9)
                    d, other = np.concatenate([best_d[i], d]), np.concatenate([best_i[i], here[on]])
                    order = np.lexsort((other, d))[:k]
                    best_d[i], best_i[i] = d[order], other[order]
        on = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(names[:, None], best_d.shape)[on]), pa.array(best_i[on]), pa.array(best_d[on])], names=["src", "dst", "dist"])

    return rows.mapInArrow(run, "src long, dst long, dist double")


QUERIES["nearest_by_code"] = lambda s, d: nearest_by_code(*_queries_and_rows(s, d), 5)
QUERIES["random_pairs"] = lambda s, d: random_pairs(table(s, d, "orders"), "o_orderkey", 2000)
