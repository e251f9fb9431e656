"""Join trees: the marginals of all variables of a discrete model in two passes of messages.

A model is a list of factors, tables with a column a variable and p. The variables' names alone decide the tree: an elimination order that
adds the fewest links gives cliques, the widest separators join them. Factors, messages and beliefs are tables: a
product is a join on shared variables, a message a sum over the others, each written before the next reads it. The size of a
clique's table is the product of its variables' values, as in any exact method; `query` of factors answers one
question, a calibrated tree all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.factors import conditional, given, marginal, normalized, product, variables
from tessera.plans.session import table
from tessera.plans.shared import materialize


def cliques(scopes: list[set[str]]) -> list[frozenset[str]]:
    """The maximal cliques of the graph in which the variables of each scope are linked, after links that make it chordal.

    Each time the variable goes whose neighbours lack the fewest links, ties by name; its neighbours are linked.
    """
    near: dict[str, set[str]] = {v: set() for scope in scopes for v in scope}
    for scope in scopes:
        for a, b in combinations(sorted(scope), 2):
            near[a].add(b)
            near[b].add(a)
    found: list[frozenset[str]] = []
    while near:

        def lacking(v: str) -> int:
            return sum(b not in near[a] for a, b in combinations(sorted(near[v]), 2))

        var = min(sorted(near), key=lambda v: (lacking(v), len(near[v])))
        own = frozenset({var, *near[var]})
        if not any(own <= c for c in found):
            found.append(own)
        for a, b in combinations(near[var], 2):
            near[a].add(b)
            near[b].add(a)
        for other in near.pop(var):
            near[other].discard(var)
    return found


def tree(of: list[frozenset[str]]) -> list[tuple[int, int]]:
    """Edges (parent, child) of a tree over cliques with the widest separators, parents first; cliques without common variables stay apart."""
    edges, left = [], set(range(len(of)))
    while left:
        root = min(left)
        left.discard(root)
        reached = [root]
        while True:
            open_ = [(-len(of[a] & of[b]), a, b) for a in reached for b in left if of[a] & of[b]]
            if not open_:
                break
            _, a, b = min(open_)
            edges.append((a, b))
            reached.append(b)
            left.discard(b)
    return edges


def joined(factors: list[DataFrame]) -> DataFrame:
    """The product of factors, each taken when it shares a variable with those before, if one does."""
    left = sorted(factors, key=lambda f: -len(variables(f)))
    out = left.pop(0)
    while left:
        at = next((i for i, f in enumerate(left) if set(variables(f)) & set(variables(out))), 0)
        out = product(out, left.pop(at))
    return out


@dataclass(frozen=True)
class JoinTree:
    """Cliques and the calibrated table of each: the product of its factors and all messages to it."""

    cliques: list[frozenset[str]]
    beliefs: list[DataFrame]

    def marginal(self, *names: str) -> DataFrame:
        """The distribution of variables that one clique holds."""
        fit = [i for i, c in enumerate(self.cliques) if set(names) <= c]
        if not fit:
            raise ValueError(f"no clique holds {names}")
        return normalized(marginal(self.beliefs[min(fit, key=lambda i: (len(self.cliques[i]), i))], list(names)))

    def marginals(self) -> DataFrame:
        """(variable, value, p) of every variable."""
        parts = [self.marginal(v).select(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value"), "p") for v in sorted({v for c in self.cliques for v in c})]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def calibrated(factors: list[DataFrame], **evidence) -> JoinTree:
    """The join tree of a model in which some variables hold values; those leave the model.

    Factors without variables left only scale and are dropped. Evidence of chance 0 leaves empty tables.
    """
    known = [given(f, **evidence) for f in factors]
    known = [f for f in known if variables(f)]
    if not known:
        raise ValueError("no variable is left")
    of = cliques([set(variables(f)) for f in known])
    edges = tree(of)
    own: list[list[DataFrame]] = [[] for _ in of]
    for f in known:
        fit = [i for i, c in enumerate(of) if set(variables(f)) <= c]
        own[min(fit, key=lambda i: (len(of[i]), i))].append(f)
    start = [materialize(joined(fs), "clique") if fs else None for fs in own]
    near: dict[int, list[int]] = {i: [] for i in range(len(of))}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    sent: dict[tuple[int, int], DataFrame | None] = {}

    def send(a: int, b: int) -> None:
        """The message from a to b, from all that a holds but b's own."""
        parts = [start[a], *(sent[c, a] for c in near[a] if c != b)]
        parts = [p for p in parts if p is not None]
        shared = of[a] & of[b]
        if not parts:
            sent[a, b] = None
            return
        whole = joined(parts)
        keep = [v for v in variables(whole) if v in shared]
        sent[a, b] = materialize(marginal(whole, keep), "message") if keep else None

    for a, b in reversed(edges):
        send(b, a)
    for a, b in edges:
        send(a, b)
    beliefs = [materialize(joined([p for p in (start[i], *(sent[c, i] for c in near[i])) if p is not None]), "belief") for i in range(len(of))]
    return JoinTree(of, beliefs)


def _network(s, d) -> list[DataFrame]:
    """Priority, status by priority, return flag by status, line status by both."""
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    li = table(s, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line"))
    x = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    first = o.groupBy("priority").agg(F.count("*").cast("double").alias("p"))
    parts = [normalized(first), conditional(o, "status", ["priority"]), conditional(x, "flag", ["status"]), conditional(x, "line", ["status", "flag"])]
    return [materialize(p, "factor") for p in parts]


def _all(s, d):
    return calibrated(_network(s, d), line="F").marginals().select("variable", "value", F.round("p", 6).alias("p"))


QUERIES = {"join_tree_marginals": _all}
ORACLES = {
    "join_tree_marginals": """WITH x AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, l_returnflag AS flag, l_linestatus AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
a AS (SELECT o_orderpriority AS priority, count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS p FROM orders GROUP BY 1, 2),
c AS (SELECT status, flag, count(*) / sum(count(*)) OVER (PARTITION BY status) AS p FROM x GROUP BY 1, 2),
e AS (SELECT status, flag, line, count(*) / sum(count(*)) OVER (PARTITION BY status, flag) AS p FROM x GROUP BY 1, 2, 3),
j AS (SELECT priority, status, flag, a.p * b.p * c.p * e.p AS p FROM a JOIN b USING (priority) JOIN c USING (status) JOIN e USING (status, flag) WHERE line = 'F'),
m AS (SELECT 'priority' AS variable, priority AS value, p FROM j UNION ALL SELECT 'status', status, p FROM j UNION ALL SELECT 'flag', flag, p FROM j)
SELECT variable, value, round(sum(p) / (SELECT sum(p) FROM j), 6) AS p FROM m GROUP BY 1, 2""",
}
