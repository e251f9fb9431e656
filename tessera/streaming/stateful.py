"""Stateful per-key operators for streams, with the same fold over a table for checks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATS = "key long, n long, mean double, variance double"
_STATE = "n long, mean double, m2 double"
FILTERED = "key long, seq long, position double, velocity double"


def merge(n: int, mean: float, m2: float, values: np.ndarray) -> tuple[int, float, float]:
    """Running count, mean and squared deviations after more values (the parallel form)."""
    k = len(values)
    if not k:
        return n, mean, m2
    own = float(values.mean())
    delta, total = own - mean, n + k
    return total, mean + delta * k / total, m2 + float(((values - own) ** 2).sum()) + delta * delta * n * k / total


def running_stats(stream: DataFrame, key: str, value: str) -> DataFrame:
    """After every batch, the count, mean and sample variance of each key so far."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for f in frames:
            n, mean, m2 = merge(n, mean, m2, f["v"].to_numpy(dtype=float))
        state.update((n, mean, m2))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "mean": [mean], "variance": [m2 / (n - 1) if n > 1 else 0.0]})

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    return rows.groupBy("key").applyInPandasWithState(step, STATS, _STATE, "update", GroupStateTimeout.NoTimeout)


class Momentum:
    """Constant-velocity Kalman filter of one measured coordinate."""

    def __init__(self, noise: float, acceleration: float):
        self.a, self.h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]])
        self.q = acceleration**2 * np.array([[0.25, 0.5], [0.5, 1.0]])
        self.r, self.x, self.p = noise**2, None, None

    def update(self, z: float) -> tuple[float, float]:
        """The estimate of position and velocity after one more measurement; the first is taken as it is."""
        if self.x is None:
            self.x, self.p = np.array([z, 0.0]), np.eye(2) * self.r
        else:
            x, p = self.a @ self.x, self.a @ self.p @ self.a.T + self.q
            k = p @ self.h.T / (self.h @ p @ self.h.T + self.r)
            self.x = x + (k * (z - self.h @ x)).ravel()
            self.p = (np.eye(2) - k @ self.h) @ p
        return float(self.x[0]), float(self.x[1])


def filtered(stream: DataFrame, key: str, order: str, value: str, noise: float = 2.0, acceleration: float = 0.1) -> DataFrame:
    """Each measurement's filtered position and velocity, state kept a key between batches; rows of a batch are taken in order."""
    schema = "x0 double, x1 double, p00 double, p01 double, p10 double, p11 double"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        f = Momentum(noise, acceleration)
        if state.exists:
            s = state.get
            f.x, f.p = np.array(s[:2]), np.array(s[2:]).reshape(2, 2)
        rows = pd.concat(list(frames)).sort_values("seq")
        found = [f.update(v) for v in rows["v"]]
        state.update((*f.x.tolist(), *f.p.ravel().tolist()))
        yield pd.DataFrame({"key": k[0], "seq": rows["seq"].to_numpy(), "position": [a for a, _ in found], "velocity": [b for _, b in found]})

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("seq"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(step, FILTERED, schema, "append", GroupStateTimeout.NoTimeout)
