"""Discrete factors as tables: a product is a join on shared variables, a marginal a sum. One column a variable, and p."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import table


#: Rows of a factor that meets all rows of another.
SENT = 100_000


def variables(f: DataFrame) -> list[str]:
    return [c for c in f.columns if c != "p"]


def product(f: DataFrame, g: DataFrame) -> DataFrame:
    """The factor over all variables of both. Without a shared variable every pair of rows meets, so g, which is sent to every task, has at most SENT rows; more are an error."""
    shared = [v for v in variables(f) if v in variables(g)]
    h = g.withColumnRenamed("p", "_q")
    if not shared and h.limit(SENT + 1).count() > SENT:
        raise ValueError(f"factors without a shared variable, and more than {SENT} rows")
    joined = f.join(h, shared) if shared else f.crossJoin(F.broadcast(h))
    return joined.select(*dict.fromkeys([*variables(f), *variables(g)]), (F.col("p") * F.col("_q")).alias("p"))


def marginal(f: DataFrame, keep: list[str]) -> DataFrame:
    """The factor over some of its variables."""
    return f.groupBy(*keep).agg(F.sum("p").alias("p"))


def given(f: DataFrame, **values) -> DataFrame:
    """The factor where some variables hold values, without them."""
    known = {k: v for k, v in values.items() if k in f.columns}
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), known.items(), f).drop(*known)


def normalized(f: DataFrame) -> DataFrame:
    return f.crossJoin(F.broadcast(f.agg(F.sum("p").alias("_t")))).select(*variables(f), F.try_divide("p", "_t").alias("p"))  # one row


def conditional(df: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """The table p(child | parents) of the counts in data."""
    n = df.groupBy(*parents, child).agg(F.count("*").alias("_n"))
    return n.join(n.groupBy(*parents).agg(F.sum("_n").alias("_m")), parents).select(*parents, child, (F.col("_n") / F.col("_m")).alias("p"))


def query(factors: list[DataFrame], keep: list[str], **evidence) -> DataFrame:
    """p(keep | evidence) by eliminating one variable at a time, the one in the fewest factors first."""
    left = [given(f, **evidence) for f in factors]
    while True:
        hidden = sorted({v for f in left for v in variables(f)} - set(keep))
        if not hidden:
            break
        var = min(hidden, key=lambda v: (sum(v in f.columns for f in left), v))
        used = [f for f in left if var in f.columns]
        joined = reduce(product, used)
        left = [f for f in left if var not in f.columns] + [marginal(joined, [v for v in variables(joined) if v != var])]
    return normalized(marginal(reduce(product, left), keep))


def _network(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    x = o.join(table(s, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag")), F.col("o_orderkey") == F.col("l_orderkey"))
    first = o.groupBy("priority").agg(F.count("*").cast("double").alias("p"))
    return query([normalized(first), conditional(o, "status", ["priority"]), conditional(x, "flag", ["status"])], ["priority"], flag="R").select("priority", F.round("p", 6).alias("p"))


QUERIES = {"bayes_query": _network}
ORACLES = {
    "bayes_query": """WITH a AS (SELECT o_orderpriority AS priority, count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS p FROM orders GROUP BY 1, 2),
c AS (SELECT o_orderstatus AS status, l_returnflag AS flag, count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
j AS (SELECT priority, sum(a.p * b.p * c.p) AS p FROM a JOIN b USING (priority) JOIN c USING (status) WHERE flag = 'R' GROUP BY 1)
SELECT priority, round(p / sum(p) OVER (), 6) AS p FROM j"""
}
