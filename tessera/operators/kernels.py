"""Small exact algorithms that run once a group: assignment, linkage, decoding, ranges. Groups are independent and bounded by what they model."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.session import table


def best_assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the one-to-one assignment of largest total; rows at most as many as columns. Shortest augmenting paths, O(n^3)."""
    n, m = cost.shape
    c = -cost.astype(float)
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while owner[j]:
            used[j] = True
            row = owner[j]
            free = ~used[1:]
            reduced = c[row - 1] - u[row] - v[1:]
            better = free & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], j
            nxt = 1 + int(np.argmin(np.where(free, low[1:], np.inf)))
            step = low[nxt]
            u[owner[used]] += step
            v[used] -= step
            low[1:][free] -= step
            j = nxt
        while j:
            owner[j], j = owner[way[j]], way[j]
    out = np.zeros(n, dtype=int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def assigned(df: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """(group, left, right, score): the best one-to-one matching of each group from its scored pairs; missing pairs score 0 and are not returned."""

    def match(f: pd.DataFrame) -> pd.DataFrame:
        m = f.pivot_table(index=left, columns=right, values=score, aggfunc="max")
        a = m.fillna(0.0).to_numpy()
        rows, cols = (np.arange(a.shape[0]), best_assignment(a)) if a.shape[0] <= a.shape[1] else (best_assignment(a.T), np.arange(a.shape[1]))
        keep = ~np.isnan(m.to_numpy()[rows, cols])
        return pd.DataFrame({group: f[group].iloc[0], left: m.index.to_numpy()[rows[keep]], right: m.columns.to_numpy()[cols[keep]], score: a[rows, cols][keep]})

    kinds = dict(df.dtypes)
    return df.select(group, left, right, score).groupBy(group).applyInPandas(match, ", ".join(f"`{c}` {kinds[c]}" for c in (group, left, right, score)))


def complete_linkage(points: np.ndarray, least: int, most: float = np.inf) -> np.ndarray:
    """Labels 0, 1, ... by first appearance: the two clusters with the smallest largest distance join until `least` are left or the distance passes most.

    Ties go to the clusters with the smallest first points. Points on a line take n log n; others hold all distances, and a step renews
    only the nearest clusters that a join has changed.
    """
    n = len(points)
    if n and points.shape[1] == 1 and np.isfinite(points).all():
        return pd.factorize(_linked_line(points[:, 0], max(least, 1), most))[0]
    d = np.zeros((n, n))
    for column in points.T:
        d += (column[:, None] - column[None]) ** 2
    d = np.sqrt(d, out=d)
    np.fill_diagonal(d, np.inf)
    label = np.arange(n)
    near = d.argmin(1) if n else label
    gap = d[label, near]
    for _ in range(n - max(least, 1)):
        i = int(gap.argmin())
        j = int(near[i])
        if not gap[i] < most:
            break
        i, j = min(i, j), max(i, j)
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        gap[j] = np.inf
        stale = np.flatnonzero((near == i) | (near == j))
        stale = np.append(stale[(stale != i) & np.isfinite(gap[stale])], i)
        for k in stale.tolist():
            near[k] = d[k].argmin()
            gap[k] = d[k, near[k]]
        label[label == j] = i
    return pd.factorize(label)[0]


def _linked_line(x: np.ndarray, least: int, most: float) -> np.ndarray:
    """The first point of each point's cluster, for finite points on a line: equal points join first, then neighbours of the order."""
    n, left = len(x), len(x)
    label = np.arange(n)
    order = np.argsort(x, kind="stable")
    opens = np.flatnonzero(np.diff(x[order], prepend=np.nan) != 0)
    groups = np.split(order, opens[1:])
    if not 0 < most:
        return label
    for g in sorted(groups, key=lambda g: g[0]):  # in the order of their first points, as ties go
        if (take := min(len(g) - 1, left - least)) > 0:
            label[g[1 : take + 1]] = g[0]
            left -= take
    if left <= least:
        return label
    low, high, head = [float(x[g[0]]) for g in groups], [float(x[g[0]]) for g in groups], [int(g[0]) for g in groups]
    parent = list(range(len(groups)))
    before, after, version = list(range(-1, len(groups) - 1)), [*range(1, len(groups)), -1], [0] * len(groups)

    def pair(a: int, b: int) -> tuple[float, int, int, int, int, int, int]:
        return high[b] - low[a], min(head[a], head[b]), max(head[a], head[b]), a, b, version[a], version[b]

    heap = [pair(a, a + 1) for a in range(len(groups) - 1)]
    heapq.heapify(heap)
    while left > least and heap:
        gap, _, _, a, b, va, vb = heapq.heappop(heap)
        if (version[a], version[b]) != (va, vb):
            continue
        if not gap < most:
            break
        parent[b], high[a], head[a], after[a] = a, high[b], min(head[a], head[b]), after[b]
        version[a], version[b], left = version[a] + 1, -1, left - 1
        if after[a] >= 0:
            before[after[a]] = a
            heapq.heappush(heap, pair(a, after[a]))
        if before[a] >= 0:
            heapq.heappush(heap, pair(before[a], a))
    for place in range(len(groups)):  # a cluster keeps the place of its leftmost group
        root = parent[place] = parent[parent[place]]
        label[groups[place]] = head[root]
    return label


def agglomerated(df: DataFrame, group: str, key: str, features: list[str], least: int, most: float = float("inf")) -> DataFrame:
    """(group, key, cluster) by complete linkage inside each group."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key)
        return pd.DataFrame({group: f[group], key: f[key], "cluster": complete_linkage(f[features].to_numpy(dtype=float), least, most)})

    kinds = dict(df.dtypes)
    return df.select(group, key, *features).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, cluster long")


def viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """Best label sequence under scores of each label at each place and of each step from label to label; ties to the smaller label."""
    if not len(emit):
        return []
    score, back = emit[0].copy(), []
    for row in emit[1:]:
        total = score[:, None] + move
        back.append(total.argmax(0))
        score = total.max(0) + row
    out = [int(score.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def min_cut(n: int, edges: list[tuple[int, int, float]], source: int, sink: int) -> tuple[float, set[int]]:
    """Value of the largest flow and the nodes on the source's side of a smallest cut, by shortest augmenting paths."""
    left: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        left[a][b] = left[a].get(b, 0.0) + c
        left[b].setdefault(a, 0.0)
    total = 0.0
    while True:
        came, queue = {source: source}, [source]
        for a in queue:
            for b, c in left[a].items():
                if c > 1e-12 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            return total, set(came)
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        flow = min(left[a][b] for a, b in path)
        for a, b in path:
            left[a][b] -= flow
            left[b][a] += flow
        total += flow


def binary_labels(node: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """The 0/1 labelling that maximises the scores of nodes labelled 1 less a penalty for every edge whose ends differ; penalties are not negative."""
    n = len(node)
    links = [(n, i, float(s)) for i, s in enumerate(node) if s > 0] + [(i, n + 1, float(-s)) for i, s in enumerate(node) if s < 0]
    links += [x for a, b, w in edges for x in ((a, b, float(w)), (b, a, float(w)))]
    _, side = min_cut(n + 2, links, n, n + 1)
    return np.array([int(i in side) for i in range(n)])


def best_parse(words: int, lexical: np.ndarray, rules: list[tuple[int, int, int, float]], root: int) -> tuple[float, tuple] | None:
    """Score and tree of the best parse: lexical[i, tag] scores single words, rules (whole, left, right, score) join spans; None if none reaches the root."""
    best: dict[tuple[int, int, int], tuple[float, tuple]] = {}
    for i in range(words):
        for t in np.flatnonzero(np.isfinite(lexical[i])).tolist():
            best[(i, i + 1, t)] = (float(lexical[i, t]), (t, i))
    for width in range(2, words + 1):
        for a in range(words - width + 1):
            b = a + width
            for m in range(a + 1, b):
                for whole, l, r, s in rules:
                    x, y = best.get((a, m, l)), best.get((m, b, r))
                    if x and y and (total := x[0] + y[0] + s) > best.get((a, b, whole), (-np.inf,))[0]:
                        best[(a, b, whole)] = (total, (whole, x[1], y[1]))
    return best.get((0, words, root))


def number_ranges(values: np.ndarray, width: float) -> list[tuple[float, float]]:
    """Ranges no wider than width that cover all values: a sweep from below against merging across the smallest gaps; the fewer, ties to merging."""
    x = np.unique(values)
    if not len(x):
        return []
    sweep: list[list[float]] = []
    for v in x:
        if sweep and v - sweep[-1][0] <= width:
            sweep[-1][1] = v
        else:
            sweep.append([v, v])
    merged = [[v, v] for v in x]
    for i in np.argsort(np.diff(x), kind="stable"):
        a = next(k for k, r in enumerate(merged) if r[0] <= x[i] <= r[1])
        if a + 1 < len(merged) and merged[a + 1][1] - merged[a][0] <= width:
            merged[a : a + 2] = [[merged[a][0], merged[a + 1][1]]]
    best = sweep if len(sweep) < len(merged) else merged
    return [(float(a), float(b)) for a, b in best]


def sampled_distribution(df: DataFrame, step: str, token: str, logit: Column, temperature: float = 1.0, top_k: int = 50, top_p: float = 1.0, min_p: float = 0.0) -> DataFrame:
    """(step, token, p): the chances after the top k logits, a softmax at a temperature, the least share of the best and the least set that holds top_p, renewed to 1."""
    w = Window.partitionBy(step)
    down = w.orderBy(F.desc("l"), F.asc(token))
    x = df.select(step, token, logit.alias("l")).withColumn("rn", F.row_number().over(down)).filter(F.col("rn") <= top_k)
    e = x.withColumn("e", F.exp((F.col("l") - F.max("l").over(w)) / temperature)).withColumn("p", F.col("e") / F.sum("e").over(w))
    if min_p > 0:
        e = e.withColumn("best", F.max("p").over(w)).filter(F.col("p") >= F.lit(min_p) * F.col("best")).drop("best")
    run = F.sum("p").over(down.rowsBetween(Window.unboundedPreceding, -1))
    cut = e.withColumn("before", F.coalesce(run, F.lit(0.0))).filter(F.col("before") < top_p)
    return cut.select(step, token, F.round(F.col("p") / F.sum("p").over(w), 6).alias("p"))


def segment_report(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of found segments: 1 without any found, 1 without any true, F1 0 only if both are 0."""
    t, f = truth.select(*keys).distinct(), found.select(*keys).distinct()
    both = t.join(f, keys, "left_semi").agg(F.count("*").alias("k"))
    sizes = t.agg(F.count("*").alias("n")).crossJoin(f.agg(F.count("*").alias("m"))).crossJoin(both)  # single rows
    p, q = F.coalesce(F.try_divide("k", "m"), F.lit(1.0)), F.coalesce(F.try_divide("k", "n"), F.lit(1.0))
    return sizes.select(F.round(p, 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0)), 6).alias("f1"))


def _pairs(s, d):
    x = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy(F.col("p_size").alias("g"), F.col("s_nationkey").alias("a"), F.col("p_brand").alias("b")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))


def _segments(s, d):
    o = table(s, d, "orders")
    return segment_report(o.filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderstatus"), o.filter("o_totalprice > 200000").select("o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"])


QUERIES = {
    "best_assignment": lambda s, d: assigned(_pairs(s, d), "g", "a", "b", "score"),
    "agglomerative_clusters": lambda s, d: agglomerated(table(s, d, "supplier"), "s_nationkey", "s_suppkey", ["s_acctbal"], 2),
    "token_sampler": lambda s, d: sampled_distribution(table(s, d, "part"), "p_brand", "p_partkey", F.col("p_retailprice") / 50, 0.8, 40, 0.9, 0.01),
    "segment_report": _segments,
}

ORACLES = {
    "token_sampler": """WITH x AS (SELECT p_brand, p_partkey, p_retailprice / 50 AS l, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice / 50 DESC, p_partkey) AS rn FROM part),
e AS (SELECT *, exp((l - max(l) OVER (PARTITION BY p_brand)) / 0.8) AS e FROM x WHERE rn <= 40), p AS (SELECT *, e / sum(e) OVER (PARTITION BY p_brand) AS p FROM e),
m AS (SELECT *, max(p) OVER (PARTITION BY p_brand) AS best FROM p), q AS (SELECT * FROM m WHERE p >= 0.01 * best),
c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY p_brand ORDER BY l DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q)
SELECT p_brand, p_partkey, round(p / sum(p) OVER (PARTITION BY p_brand), 6) AS p FROM c WHERE b < 0.9""",
    "segment_report": """WITH t AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'), f AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 200000),
k AS (SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM f) AS m, (SELECT count(*) FROM t JOIN f USING (o_custkey, o_orderstatus)) AS k), r AS (SELECT coalesce(k / nullif(m, 0), 1) AS p, coalesce(k / nullif(n, 0), 1) AS q FROM k)
SELECT round(p, 6) AS "precision", round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM r""",
}
