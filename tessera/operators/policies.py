"""Policies from recorded transitions by least-squares policy iteration.

A row is one step that was taken: the features of its state and action, the reward, and the features of every action
that the next state offers (none where the walk ended). The value of a state and action is the product of
weights and features; an iteration lets the present weights choose the next action of every row and solves the
normal equations of the values under that policy, which are one aggregation. The driver holds a square of the number of
features. No order of rows, no window and no group is needed, so any walk may be of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.landmarks import summed, usable, vectors
from tessera.plans.session import table
from tessera.plans.shared import discard, materialize


@dataclass(frozen=True)
class Policy:
    """Weights of the features, and the iterations after which they stayed."""

    weights: np.ndarray
    iterations: int

    def best(self, offered: np.ndarray) -> int:
        """The place of the best of the offered actions' features, the first of equal ones."""
        return int((offered @ self.weights).argmax())


def _chosen(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Features of the action that the weights choose in each next state; zeros where none is offered."""
    out = np.zeros((len(column), len(weights)))
    for i, offered in enumerate(column.to_pylist()):
        if offered:
            options = np.array(offered, dtype=np.float64)
            out[i] = options[int((options @ weights).argmax())]
    return out


def learn(df: DataFrame, taken: str, reward: str, offered: str, discount: float = 0.8, ridge: float = 0.01, close: float = 0.01, most: int = 100) -> Policy:
    """Least-squares policy iteration until weights move less than close, or most times.

    taken is an array, offered an array of arrays; rows whose taken features or reward are null or not finite don't take
    part, a null or empty offer ends a walk. Repeated rows count as often as they occur: those with equal features and offers are one row with
    their number and rewards, so an iteration passes over what differs. An empty table is an error.
    """
    rows = usable(df, taken).filter(F.col(reward).isNotNull() & ~F.isnan(F.col(reward).cast("double")) & (F.abs(reward) < float("inf")))
    rows = rows.select(F.col(taken).cast("array<double>").alias("x"), F.col(reward).cast("double").alias("r"), F.col(offered).cast("array<array<double>>").alias("o"))
    rows = materialize(rows.groupBy("x", "o").agg(F.sum("r").alias("r"), F.count("*").cast("double").alias("n")), "steps")
    size = rows.agg(F.max(F.size("x"))).first()[0]
    if not size:
        raise ValueError("no step to learn from")
    weights, step = np.zeros(size), 0
    for step in range(1, most + 1):

        def make(columns: list[pa.Array], w: np.ndarray = weights) -> np.ndarray:
            x = vectors(columns[0]).reshape(-1, size)
            own = x.T * columns[3].to_numpy()
            return np.concatenate([(own @ (x - discount * _chosen(columns[2], w))).ravel(), x.T @ columns[1].to_numpy()])

        total = summed(rows, ["x", "r", "o", "n"], make, size * size + size)
        new = np.linalg.solve(total[: size * size].reshape(size, size) + ridge * np.eye(size), total[size * size :])
        moved, weights = float(np.abs(new - weights).max()), new
        if moved < close:
            break
    discard(rows)
    return Policy(weights, step)


#: States and actions of the query: return flags and line statuses.
FLAGS, STATUSES = ("A", "N", "R"), ("F", "O")


def _one(flag, status):
    """Features of a flag and a status: one place each pair."""
    return F.array(*[F.when((flag == f) & (status == t), 1.0).otherwise(0.0) for f in FLAGS for t in STATUSES])


def _lines(s, d):
    """Best status by return flag, where a line leads to the next of its order and its quantity is the reward."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", (F.col("l_quantity").cast("double") / 50.0).alias("reward"))
    after = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_returnflag").alias("next"))
    steps = li.join(after, ["l_orderkey", "l_linenumber"], "left")
    offer = F.when(F.col("next").isNotNull(), F.array(*[_one(F.col("next"), F.lit(t)) for t in STATUSES]))
    found = learn(steps.select(_one(F.col("l_returnflag"), F.col("l_linestatus")).alias("taken"), "reward", offer.alias("offered")), "taken", "reward", "offered")
    values = found.weights.reshape(len(FLAGS), len(STATUSES))
    return s.createDataFrame([(f, STATUSES[int(v.argmax())], float(round(v.max(), 3))) for f, v in zip(FLAGS, values, strict=True)], "flag string, best string, value double")


QUERIES = {"line_policy": _lines}
ORACLES: dict[str, str] = {}
