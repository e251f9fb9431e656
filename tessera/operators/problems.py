"""Whether tables state a learning problem of a kind, cliques of a graph, and losses of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import log1pexp
from tessera.operators.graphs import _UND, _trade, both_ways, undirected, without_shortest
from tessera.plans.session import table


def _all(condition: Column) -> Column:
    """True for at least one row and where every row meets the condition; an unknown answer is a no."""
    return F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(False)).alias("holds")


def binary_problem(df: DataFrame, label: Column) -> DataFrame:
    """More than one row, labels -1 and 1 only, and both of them."""
    found = df.agg(_all(label.isin(-1, 1)), F.min(label).alias("low"), F.max(label).alias("high"))
    return found.select((F.col("holds") & F.coalesce(F.col("low") < F.col("high"), F.lit(False))).alias("holds"))


def ranking_problem(df: DataFrame, by: str, relevant: Column) -> DataFrame:
    """Every query has relevant and other items."""
    sides = df.groupBy(by).agg(F.bool_or(relevant).alias("some"), F.bool_or(~relevant).alias("rest"))
    return sides.agg(_all(F.col("some") & F.col("rest")))


def labelling_problem(df: DataFrame, size: Column, labels: Column) -> DataFrame:
    """Every sequence has a label for each of its places."""
    return df.agg(_all(F.size(labels) == size))


def segmentation_problem(df: DataFrame, size: Column, segments: Column) -> DataFrame:
    """Segments (begin, end), the end not included, are not empty, lie inside their sequence and do not overlap."""
    s = F.array_sort(segments)
    inside = F.forall(s, lambda e: (e["begin"] >= 0) & (e["begin"] < e["end"]) & (e["end"] <= size))
    apart = F.forall(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.struct(a["end"].alias("end"), b["begin"].alias("next"))), lambda e: e["next"].isNull() | (e["end"] <= e["next"]))
    return df.agg(_all(inside & apart))


def assignment_problem(df: DataFrame, left: Column, right: Column, labels: Column, forced: bool = False) -> DataFrame:
    """Every left item has a label: a right item, each once, or -1 for none; forced problems assign as many as can be."""
    real = F.filter(labels, lambda x: x != -1)
    fits = (F.size(labels) == left) & F.forall(labels, lambda x: (x >= -1) & (x < right)) & (F.size(F.array_distinct(real)) == F.size(real))
    return df.agg(_all(fits & (F.size(real) == F.least(left, right)) if forced else fits))


def track_problem(df: DataFrame, step: str, label: str) -> DataFrame:
    """At least two time steps, and no label twice in one of them. Rows are counted a step and label, so a hot step combines first."""
    steps = df.groupBy(step, label).agg(F.count("*").alias("n")).groupBy(step).agg(F.max("n").alias("most"))
    found = steps.agg(F.count("*").alias("steps"), _all(F.col("most") == 1))
    return found.select((F.col("holds") & (F.col("steps") >= 2)).alias("holds"))


def clique_report(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(clique, n, is_clique, is_maximal) of node sets (clique, node) in a graph (i1, i2) without double edges.

    A set is a clique if each member has an edge to each other; it is maximal if moreover no other node has edges to
    all members. Neighbours are counted a set, so a node of high degree costs rows, never a group in one task.
    """
    sets = members.select("clique", "node").distinct()
    size = sets.groupBy("clique").agg(F.count("*").alias("n"))
    linked = both_ways(edges.filter("i1 <> i2")).select(F.col("i1").alias("node"), F.col("i2").alias("near"))
    met = sets.join(linked, "node").groupBy("clique", "near").agg(F.count("*").alias("c"))
    marked = met.join(sets.select("clique", F.col("node").alias("near"), F.lit(True).alias("own")), ["clique", "near"], "left")
    seen = marked.join(size, "clique").groupBy("clique").agg(
        F.sum(F.when(F.col("own"), F.col("c")).otherwise(0)).alias("inner"), F.bool_or(F.col("own").isNull() & (F.col("c") == F.col("n"))).alias("more")
    )
    whole = F.coalesce(F.col("inner"), F.lit(0)) == F.col("n") * (F.col("n") - 1)
    return size.join(seen, "clique", "left").select("clique", "n", whole.alias("is_clique"), (whole & ~F.coalesce(F.col("more"), F.lit(False))).alias("is_maximal"))


# losses of one row; a mean over rows is the loss of a table


def hinge(truth: Column, score: Column) -> Column:
    """Truth is -1 or 1."""
    return F.greatest(F.lit(0.0), 1 - truth * score)


def log_loss(truth: Column, score: Column) -> Column:
    """-log of the chance 1 / (1 + e ** -score) of the true side, -1 or 1."""
    return log1pexp(-truth * score)


def class_log_loss(label: Column, scores: Column, ignore: int | None = None) -> Column:
    """-log of the label's share in the soft-max of scores; null (left out of means) for an ignored label or one without score."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    loss = F.ln(total) + top - F.get(scores, label)
    return loss if ignore is None else F.when(label != ignore, loss)


def squared(truth: Column, guess: Column) -> Column:
    return (truth - guess) * (truth - guess)


def insensitive(truth: Column, guess: Column, slack: float) -> Column:
    """Absolute error beyond a slack."""
    return F.greatest(F.lit(0.0), F.abs(truth - guess) - slack)


def losses(df: DataFrame, by: list[str], kinds: dict[str, Column], digits: int = 6) -> DataFrame:
    """The mean of each loss a group; one mergeable aggregation."""
    return df.groupBy(*by).agg(*[F.round(F.avg(c), digits).alias(n) for n, c in kinds.items()])


def _orders(s, d):
    x = table(s, d, "lineitem").groupBy("l_orderkey")
    return x.agg(F.count("*").alias("n"), F.max("l_linenumber").cast("long").alias("m"), F.array_sort(F.collect_list((F.col("l_linenumber") - 1).cast("long"))).alias("labels"))


def _checks(s, d):
    orders, events = _orders(s, d), table(s, d, "events")
    spans = F.transform("labels", lambda x: F.struct(x.alias("begin"), (x + 1).alias("end")))
    made = {
        "binary": binary_problem(table(s, d, "labels"), F.col("quality") * 2 - 1),
        "ranking": ranking_problem(events, "user_id", F.col("event_type") == "error"),
        "labelling": labelling_problem(orders, F.col("m"), F.col("labels")),
        "segmentation": segmentation_problem(orders, F.col("m"), spans),
        "assignment": assignment_problem(orders, F.col("n"), F.col("m"), F.col("labels")),
        "forced": assignment_problem(orders, F.col("n"), F.col("m"), F.col("labels"), True),
        "track": track_problem(events, "user_id", "event_type"),
    }
    out = None
    for name, found in made.items():
        one = found.select(F.lit(name).alias("problem"), "holds")
        out = one if out is None else out.unionByName(one)
    return out


def _cliques(s, d):
    members = table(s, d, "nation").select(F.col("n_regionkey").alias("clique"), F.col("n_nationkey").alias("node"))
    return clique_report(without_shortest(undirected(_trade(s, d), "a", "b", "w"), 0.25), members)


def _losses(s, d):
    e = table(s, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") % 2 * 2 - 1).alias("y"), "label")
    a, b, y = F.col("x")[0], F.col("x")[1], F.col("y")
    kinds = {
        "hinge": hinge(y, a), "log_loss": log_loss(y, a), "class_log": class_log_loss(F.col("label"), F.col("x")), "token_log": class_log_loss(F.col("label"), F.col("x"), 0),
        "weighted_log": (F.col("label") + 1) * class_log_loss(F.col("label"), F.col("x")), "squared": squared(b, a), "insensitive": insensitive(b, a, 0.05), "dot": -(a * b),
    }
    return losses(e.withColumn("side", y), ["side"], kinds)


QUERIES = {"problem_checks": _checks, "clique_report": _cliques, "loss_report": _losses}

_ORDERS = "o AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber)::BIGINT AS m, list(l_linenumber::BIGINT - 1) AS l FROM lineitem GROUP BY 1)"
ORACLES = {
    "problem_checks": f"""WITH {_ORDERS}, u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY 1)
SELECT 'binary' AS problem, count(*) > 1 AND bool_and(quality IN (0, 1)) AND count(DISTINCT quality) = 2 AS holds FROM labels
UNION ALL SELECT 'ranking', bool_and(e > 0 AND e < n) FROM u
UNION ALL SELECT 'labelling', bool_and(n = m) FROM o
UNION ALL SELECT 'segmentation', bool_and(list_unique(l) = n AND list_min(l) >= 0) FROM o
UNION ALL SELECT 'assignment', bool_and(len(list_distinct(list_filter(l, lambda x: x <> -1))) = len(list_filter(l, lambda x: x <> -1)) AND list_min(l) >= -1) FROM o
UNION ALL SELECT 'forced', bool_and(len(list_distinct(list_filter(l, lambda x: x <> -1))) = len(list_filter(l, lambda x: x <> -1)) AND list_min(l) >= -1 AND len(list_filter(l, lambda x: x <> -1)) = least(n, m)) FROM o
UNION ALL SELECT 'track', bool_and(n = k) AND count(*) >= 2 FROM u""",
    "clique_report": f"""WITH {_UND}, k AS (SELECT i1, i2 FROM (SELECT i1, i2, row_number() OVER (ORDER BY w, i1, i2) AS rn FROM u) WHERE rn > floor((SELECT count(*) FROM u) * 0.25)),
y AS (SELECT i1, i2 FROM k WHERE i1 <> i2 UNION ALL SELECT i2, i1 FROM k WHERE i1 <> i2), s AS (SELECT n_regionkey AS clique, n_nationkey AS node FROM nation),
i AS (SELECT clique, count(*) AS n, (SELECT count(*) FROM y WHERE i1 IN (SELECT node FROM s q WHERE q.clique = s.clique) AND i2 IN (SELECT node FROM s q WHERE q.clique = s.clique)) AS e FROM s GROUP BY 1),
m AS (SELECT clique, i2, count(*) AS c FROM s JOIN y ON node = i1 WHERE i2 NOT IN (SELECT node FROM s q WHERE q.clique = s.clique) GROUP BY 1, 2)
SELECT i.clique, n, e = n * (n - 1) AS is_clique, e = n * (n - 1) AND NOT EXISTS (SELECT 1 FROM m WHERE m.clique = i.clique AND m.c = i.n) AS is_maximal FROM i""",
    "loss_report": """WITH e AS (SELECT list_transform(embedding, lambda v: v::DOUBLE) AS x, label % 2 * 2 - 1 AS y, label FROM embeddings),
r AS (SELECT y, label, x[1] AS a, x[2] AS b, ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[label + 1] AS c FROM e)
SELECT y AS side, round(avg(greatest(0, 1 - y * a)), 6) AS hinge, round(avg(ln(1 + exp(-y * a))), 6) AS log_loss, round(avg(c), 6) AS class_log, round(avg(c) FILTER (label <> 0), 6) AS token_log,
  round(avg((label + 1) * c), 6) AS weighted_log, round(avg((b - a) * (b - a)), 6) AS squared, round(avg(greatest(0, abs(b - a) - 0.05)), 6) AS insensitive, round(avg(-a * b), 6) AS dot FROM r GROUP BY 1""",
}
