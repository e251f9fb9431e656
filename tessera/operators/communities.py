"""Communities by leading eigenvectors of modularity, and clusters by eigenvectors of an affinity.

Matrices are never built: an edge table is the sparse part, and every product with a
vector is one join of edges with node values and one sum a node; rank-one parts
come from one sum a community. Vectors are tables, written to the shared folder after every
step, so a lost executor costs one step; only k x k matrices and single numbers reach the driver.

Edges have i1, i2 and a weight w of 0 or more, each unordered pair once; a loop counts once
in its node's degree. Nodes without an edge are in no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import graphs
from tessera.plans.shared import discard, materialize
from tessera.plans.session import table

#: Steps of the eigenvector iteration, rounds of moves after it, and the gain below which nothing is split.
STEPS, MOVES, LEAST = 16, 4, 1e-9


def products(links: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """(node, ax): the sparse product of links (i1, i2, w) and a column of values (node, ...)."""
    moved = links.join(values.select(F.col("node").alias("i2"), F.col(column).alias("_v")), "i2")
    return moved.groupBy(F.col("i1").alias("node")).agg(F.sum(F.col("w") * F.col("_v")).alias("ax"))


def start(node: Column) -> Column:
    """A fixed number between -0.5 and 0.5 for a node."""
    return F.pmod(F.pmod(node, F.lit(1000003)) * 7919 + 104729, F.lit(1000003)) / 1000003.0 - 0.5


def _modular(links: DataFrame, state: DataFrame, column: str, two_m: float) -> DataFrame:
    """state and bx: the product of a column with each community's modularity matrix, whose rows sum to 0."""
    dots = state.groupBy("g").agg(F.sum(F.col("k") * F.col(column)).alias("_dot"))
    whole = state.join(products(links, state, column), "node", "left").join(dots, "g")
    return whole.withColumn("bx", F.coalesce("ax", F.lit(0.0)) - F.col("k") * F.col("_dot") / two_m - F.col("d") * F.col(column)).drop("ax", "_dot")


def _step(tables: list[DataFrame], made: DataFrame, tag: str) -> DataFrame:
    """made, written; the table before it is deleted."""
    held = materialize(made, tag)
    discard(tables[-1])
    tables[-1] = held
    return held


def split(links: DataFrame, nodes: DataFrame, two_m: float, steps: int = STEPS, moves: int = MOVES) -> DataFrame:
    """(node, g, s, gain): the side of every node of its community, and what parting the sides adds to modularity.

    nodes has node, g (its community) and k (its degree in the whole graph), links the edges inside communities, both ways.
    A Chebyshev recurrence over the interval of negative eigenvalues lets the most positive ones outgrow all others; a
    community's interval is bounded by its degrees or, where that is less, by the sum of its matrix's squares. Then in every
    round half of the nodes that gain by changing sides change, and the round counts if the community as a whole gained.
    """
    inner = links.groupBy(F.col("i1").alias("node")).agg(F.sum("w").alias("own"))
    sums = nodes.groupBy("g").agg(F.sum("k").alias("kg"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    rows = nodes.join(inner, "node", "left").na.fill(0.0, ["own"]).join(sums, "g").withColumn("d", F.col("own") - F.col("k") * F.col("kg") / two_m)
    ends = links.join(nodes.select(F.col("node").alias("i1"), F.col("k").alias("_k")), "i1").join(nodes.select(F.col("node").alias("i2"), "k", "g"), "i2")
    squares = ends.groupBy("g").agg((F.sum(F.col("w") * F.col("w")) - 2 * F.sum(F.col("w") * F.col("_k") * F.col("k")) / two_m).alias("_a"))
    bounds = rows.groupBy("g").agg((F.max(2 * F.col("own")) + F.max("kk") / two_m).alias("_by_degree"), F.max("kk").alias("kk"), F.max(F.greatest("d", F.lit(0.0))).alias("_d")).join(squares, "g", "left")
    by_squares = F.sqrt(F.greatest(F.coalesce("_a", F.lit(0.0)) + F.pow(F.col("kk") / two_m, 2), F.lit(0.0))) + F.col("_d")
    bounds = bounds.select("g", F.least("_by_degree", by_squares).alias("c"))
    tables = [materialize(rows.join(bounds, "g").select("node", "g", "k", "d", "c", start(F.col("node")).alias("x"), F.lit(0.0).alias("y")), "split")]
    for t in range(steps):
        scaled = F.try_divide(2 * F.col("bx"), F.col("c")) + F.col("x")
        new = scaled if t == 0 else 2 * scaled - F.col("y")
        _step(tables, _modular(links, tables[-1], "x", two_m).select("node", "g", "k", "d", "c", F.coalesce(new, F.lit(0.0)).alias("_x"), F.col("x").alias("y")).withColumnRenamed("_x", "x"), "split")
    sides = tables[-1].withColumn("s", F.when(F.col("x") > 0, 1.0).otherwise(-1.0))
    scored = _scored(_modular(links, sides, "s", two_m))
    now = _step(tables, scored.select("node", "g", "k", "d", "s", "bx", "q"), "sides")
    loops = links.filter("i1 = i2").select(F.col("i1").alias("node"), F.col("w").alias("loop"))
    for r in range(moves):
        own = F.coalesce("loop", F.lit(0.0)) - F.col("k") * F.col("k") / two_m - F.col("d")
        better = (own - F.col("s") * F.col("bx") > LEAST) & (F.pmod(F.col("node") + r, F.lit(2)) == 0)
        tried = now.join(loops, "node", "left").withColumn("_old", F.col("s")).withColumn("_bx", F.col("bx")).withColumn("_q", F.col("q"))
        tried = tried.withColumn("s", F.when(better, -F.col("s")).otherwise(F.col("s"))).drop("bx", "q", "loop")
        tried = _scored(_modular(links, tried, "s", two_m))
        won = F.col("q") > F.col("_q") + LEAST
        picked = [F.when(won, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("s", "_old"), ("bx", "_bx"), ("q", "_q"))]
        now = _step(tables, tried.select("node", "g", "k", "d", *picked), "sides")
    return now.select("node", "g", "s", (F.col("q") / (2 * two_m)).alias("gain"))


def _scored(rows: DataFrame) -> DataFrame:
    """rows and q, the sum of s times bx over their community."""
    return rows.join(rows.groupBy("g").agg(F.sum(F.col("s") * F.col("bx")).alias("q")), "g")


def newman_communities(edges: DataFrame, levels: int = 20, steps: int = STEPS, moves: int = MOVES) -> DataFrame:
    """(node, community) of every node with an edge; a community is named by its smallest node.

    Each level splits all communities that still gain by it in one set of jobs and leaves the others closed; it ends when none is left
    or after levels. Loops, several components and graphs without weight are defined: a graph whose weights sum
    to 0 stays one community; an empty edge table gives no row.
    """
    links = materialize(graphs.both_ways(edges.select("i1", "i2", F.col("w").cast("double").alias("w"))), "links")
    degrees = links.groupBy(F.col("i1").alias("node")).agg(F.sum("w").alias("k"))
    first = degrees.agg(F.min("node").alias("g"), F.sum("k").alias("two_m")).first()
    if first.g is None:
        return degrees.select("node", F.col("node").alias("community"))
    open_ = materialize(degrees.select("node", F.lit(first.g).alias("g"), "k"), "open")
    closed: list[DataFrame] = []
    for _ in range(levels if first.two_m else 0):
        sides = split(links, open_, first.two_m, steps, moves)
        names = sides.groupBy("g", "s").agg(F.min("node").alias("_name"))
        parted = sides.join(names, ["g", "s"]).select("node", F.when(F.col("gain") > LEAST, F.col("_name")).otherwise(F.col("g")).alias("g"), (F.col("gain") > LEAST).alias("_open"))
        parted = materialize(parted, "parted")
        discard(sides)
        closed.append(parted.filter("NOT _open").select("node", F.col("g").alias("community")))
        left = materialize(parted.filter("_open").select("node", "g").join(open_.select("node", "k"), "node"), "open")
        cut = materialize(within(links, left), "links")
        discard(open_, links)
        open_, links = left, cut
        if open_.isEmpty():
            break
    out = open_.select("node", F.col("g").alias("community"))
    for part in closed:
        out = out.unionByName(part)
    return out


def within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links whose ends lie in one community."""
    ends = [nodes.select(F.col("node").alias(i), F.col("g").alias(f"_{i}")) for i in ("i1", "i2")]
    return links.join(ends[0], "i1").join(ends[1], "i2").filter("_i1 = _i2").select("i1", "i2", "w")


# ---- spectral clusters


def _dots(rows: DataFrame, a: str, b: str, k: int) -> np.ndarray:
    """The k x k matrix of products of two array columns, summed over all rows."""
    cells = [F.sum(F.col(a)[i] * F.col(b)[j]).alias(f"_{i}_{j}") for i in range(k) for j in range(k)]
    return np.array(rows.agg(*cells).first(), dtype=np.float64).reshape(k, k)


def _times(column: str, matrix: np.ndarray) -> Column:
    """An array column, a row vector, times a small matrix."""
    k = len(matrix)
    return F.array(*[sum((F.col(column)[i] * float(matrix[i, j]) for i in range(1, k)), F.col(column)[0] * float(matrix[0, j])) for j in range(matrix.shape[1])])


def _block_product(links: DataFrame, rows: DataFrame, column: str, k: int) -> DataFrame:
    """(node, ax): the sparse product with k vectors at once, held as arrays."""
    moved = links.join(rows.select(F.col("node").alias("i2"), F.col(column).alias("_v")), "i2")
    sums = moved.groupBy(F.col("i1").alias("node")).agg(*[F.sum(F.col("w") * F.col("_v")[j]).alias(f"_{j}") for j in range(k)])
    return sums.select("node", F.array(*[f"_{j}" for j in range(k)]).alias("ax"))


def spectral_vectors(edges: DataFrame, k: int, steps: int = 30) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """(eigenvalues, (node, x), residuals): the k largest eigenvalues of the affinity over square roots of degrees, their vectors and how far each is from one.

    Block power iteration of the affinity plus the identity, so that the largest eigenvalues lead; after every step
    vectors are made orthonormal by the inverse root of their k x k matrix of products, at the end they are turned to
    eigenvectors inside their space. Loops don't count; there must be k nodes at least.
    """
    plain = graphs.both_ways(edges.filter("i1 <> i2").select("i1", "i2", F.col("w").cast("double").alias("w"))).filter("w > 0")
    degree = plain.groupBy(F.col("i1").alias("node")).agg(F.sum("w").alias("k"))
    ends = [degree.select(F.col("node").alias(i), F.col("k").alias(f"_{i}")) for i in ("i1", "i2")]
    links = materialize(plain.join(ends[0], "i1").join(ends[1], "i2").select("i1", "i2", (F.col("w") / F.sqrt(F.col("_i1") * F.col("_i2"))).alias("w")), "links")
    drawn = [F.sqrt("k"), *[start(F.col("node") * (2 * j + 1) + 31 * j) for j in range(1, k)]]
    tables = [materialize(degree.select("node", F.array(*drawn).alias("x")), "vectors")]
    values = residuals = np.zeros(k)
    for t in range(steps + 1):
        now = tables[-1]
        basis = inverse_root(_dots(now, "x", "x", k))
        unit = now.select("node", _times("x", basis).alias("x"))
        made = unit.join(_block_product(links, unit, "x", k), "node")
        if t < steps:
            _step(tables, made.select("node", F.zip_with("ax", "x", lambda a, b: a + b).alias("x")), "vectors")
            continue
        made = _step(tables, made, "vectors")
        inner = _dots(made, "x", "ax", k)
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        made = _step(tables, made.select("node", _times("x", turn).alias("x"), _times("ax", turn).alias("ax")), "vectors")
        away = [F.sqrt(F.sum(F.pow(F.col("ax")[j] - F.col("x")[j] * float(values[j]), 2))).alias(f"_{j}") for j in range(k)]
        residuals = np.array(made.agg(*away).first(), dtype=np.float64)
    discard(links)
    return values, tables[-1].select("node", "x"), residuals


def inverse_root(gram: np.ndarray) -> np.ndarray:
    """What turns vectors with this matrix of products into orthonormal ones; raises if they are dependent."""
    if not np.isfinite(gram).all() or np.linalg.eigvalsh(gram)[0] <= 1e-12 * np.trace(gram):
        raise ValueError("fewer independent vectors than asked for")
    return np.linalg.inv(np.linalg.cholesky(gram)).T


def spectral_clusters(edges: DataFrame, k: int, steps: int = 30, rounds: int = 10) -> DataFrame:
    """(node, cluster): k-means over the rows of the k leading eigenvectors, each put to length 1; clusters are named by their smallest node.

    One cluster needs no vectors: all nodes go to the smallest.
    """
    if k == 1:
        ends = graphs.both_ways(edges).select(F.col("i1").alias("node")).distinct()
        return ends.join(F.broadcast(ends.agg(F.min("node").alias("cluster"))))
    _, vectors, _ = spectral_vectors(edges, k, steps)
    length = F.sqrt(F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), lambda s, v: s + v))
    unit = vectors.withColumn("_n", length).select("node", F.when(F.col("_n") > 0, F.transform("x", lambda v: v / F.col("_n"))).otherwise(F.col("x")).alias("x"))
    near = graphs.kmeans(unit, "node", "x", k, rounds)[1]
    names = near.groupBy("cluster").agg(F.min("node").alias("_name"))
    return near.join(names, "cluster").select("node", F.col("_name").alias("cluster"))


# ---- the same in SQL: every step a table


def _sql_product(vector: str, column: str) -> str:
    """node, g and the product with its community's modularity matrix, from the tables st and li of a level."""
    return f"""(SELECT n.node, n.g, coalesce(p.ax, 0) - n.k * t.dot / mm.two_m - n.d * v.{column} AS bx FROM st n JOIN {vector} v ON v.node = n.node
 JOIN (SELECT st.g, sum(st.k * v.{column}) AS dot FROM st JOIN {vector} v ON v.node = st.node GROUP BY 1) t ON t.g = n.g
 LEFT JOIN (SELECT li.i1, sum(li.w * v.{column}) AS ax FROM li JOIN {vector} v ON v.node = li.i2 GROUP BY 1) p ON p.i1 = n.node, mm)"""


def newman_sql(edges: str, levels: int, steps: int = STEPS, moves: int = MOVES) -> str:
    """DuckDB SQL of newman_communities over a list of common tables that define z (i1, i2, w, both ways)."""
    parts = [f"WITH {edges}", "deg AS MATERIALIZED (SELECT i1 AS node, sum(w) AS k FROM z GROUP BY 1)", "mm AS MATERIALIZED (SELECT sum(k) AS two_m FROM deg)"]
    parts.append("g0 AS MATERIALIZED (SELECT node, min(node) OVER () AS g, k FROM deg)")
    for lv in range(levels):
        st, li = f"st{lv}", f"li{lv}"

        def at(sql: str, st: str = st, li: str = li) -> str:
            return sql.replace("st.", f"{st}.").replace("FROM st ", f"FROM {st} ").replace("li.", f"{li}.").replace("FROM li ", f"FROM {li} ")

        parts.append(f"{li} AS MATERIALIZED (SELECT z.* FROM z JOIN g{lv} a ON a.node = i1 JOIN g{lv} b ON b.node = i2 WHERE a.g = b.g)")
        parts.append(f"in{lv} AS MATERIALIZED (SELECT x.node, x.g, x.k, coalesce(o.own, 0) AS own FROM g{lv} x LEFT JOIN (SELECT i1, sum(w) AS own FROM {li} GROUP BY 1) o ON o.i1 = x.node)")
        parts.append(f"sm{lv} AS MATERIALIZED (SELECT g, sum(k) AS kg, sum(k * k) AS kk FROM in{lv} GROUP BY 1)")
        parts.append(f"dg{lv} AS MATERIALIZED (SELECT i.node, i.g, i.k, i.own, s.kk, i.own - i.k * s.kg / two_m AS d FROM in{lv} i JOIN sm{lv} s ON s.g = i.g, mm)")
        parts.append(f"sq{lv} AS MATERIALIZED (SELECT a.g, sum(w * w) - 2 * sum(w * a.k * b.k) / max(two_m) AS a FROM {li} l JOIN g{lv} a ON a.node = l.i1 JOIN g{lv} b ON b.node = l.i2, mm GROUP BY 1)")
        least = "least(max(2 * own) + max(kk) / max(two_m), sqrt(greatest(coalesce(max(sq.a), 0) + (max(kk) / max(two_m)) ** 2, 0)) + max(greatest(d, 0)))"
        parts.append(f"bd{lv} AS MATERIALIZED (SELECT n.g, {least} AS c FROM dg{lv} n LEFT JOIN sq{lv} sq ON sq.g = n.g, mm GROUP BY 1)")
        parts.append(f"{st} AS MATERIALIZED (SELECT n.node, n.g, n.k, n.d, b.c FROM dg{lv} n JOIN bd{lv} b ON b.g = n.g)")
        parts.append(f"v{lv}_0 AS MATERIALIZED (SELECT node, ((((node % 1000003) + 1000003) % 1000003) * 7919 + 104729) % 1000003 / 1000003.0::DOUBLE - 0.5 AS x, 0::DOUBLE AS y FROM {st})")
        for t in range(steps):
            old = f"v{lv}_{t}"
            m = "(2 * b.bx / nullif(n.c, 0) + v.x)"
            new = m if t == 0 else f"2 * {m} - v.y"
            parts.append(f"v{lv}_{t + 1} AS MATERIALIZED (SELECT v.node, coalesce({new}, 0) AS x, v.x AS y FROM {old} v JOIN {at(_sql_product(old, 'x'))} b ON b.node = v.node JOIN {st} n ON n.node = v.node)")
        parts.append(f"r{lv}_s AS MATERIALIZED (SELECT node, CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM v{lv}_{steps})")
        parts.append(f"r{lv}_b AS MATERIALIZED (SELECT v.node, b.g, v.s, b.bx FROM r{lv}_s v JOIN {at(_sql_product(f'r{lv}_s', 's'))} b ON b.node = v.node)")
        parts.append(f"r{lv}_0 AS MATERIALIZED (SELECT *, sum(s * bx) OVER (PARTITION BY g) AS q FROM r{lv}_b)")
        for r in range(moves):
            now = f"r{lv}_{r}"
            own = f"coalesce((SELECT sum(w) FROM {li} l WHERE l.i1 = v.node AND l.i2 = v.node), 0) - n.k * n.k / two_m - n.d"
            parts.append(f"t{lv}_{r} AS MATERIALIZED (SELECT v.node, CASE WHEN {own} - v.s * v.bx > {LEAST} AND (((v.node + {r}) % 2) + 2) % 2 = 0 THEN -v.s ELSE v.s END AS s FROM {now} v JOIN {st} n ON n.node = v.node, mm)")
            parts.append(f"u{lv}_{r} AS MATERIALIZED (SELECT v.node, b.g, v.s, b.bx, sum(v.s * b.bx) OVER (PARTITION BY b.g) AS q FROM t{lv}_{r} v JOIN {at(_sql_product(f't{lv}_{r}', 's'))} b ON b.node = v.node)")
            won = f"n.q > o.q + {LEAST}"
            parts.append(f"r{lv}_{r + 1} AS MATERIALIZED (SELECT o.node, o.g, CASE WHEN {won} THEN n.s ELSE o.s END AS s, CASE WHEN {won} THEN n.bx ELSE o.bx END AS bx, CASE WHEN {won} THEN n.q ELSE o.q END AS q FROM {now} o JOIN u{lv}_{r} n ON n.node = o.node)")
        parts.append(
            f"g{lv + 1} AS MATERIALIZED (SELECT r.node, CASE WHEN q / (2 * two_m) > {LEAST} THEN min(r.node) OVER (PARTITION BY r.g, s) ELSE r.g END AS g, n.k FROM r{lv}_{moves} r JOIN {st} n ON n.node = r.node, mm)"
        )
    return parts[0] + ", " + ", ".join(parts[1:]) + f" SELECT node, g AS community FROM g{levels}"


#: Levels, steps and moves of the query, the same in SQL.
DEPTH = {"levels": 2, "steps": 8, "moves": 2}


def _edges(s, d):
    return graphs.undirected(graphs._trade(s, d), "a", "b", "w")


QUERIES = {
    "newman_communities": lambda s, d: newman_communities(_edges(s, d), **DEPTH),
    "spectral_clusters": lambda s, d: spectral_clusters(_edges(s, d), 3, 8, 5),
}
ORACLES = {"newman_communities": newman_sql(graphs._UND, **DEPTH)}
