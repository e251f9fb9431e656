"""Policy iteration on a small chain against the exact optimum."""

import numpy as np
import pytest
from tessera.operators import policies

SCHEMA = "taken array<double>, reward double, offered array<array<double>>"
STATES, GOAL, DISCOUNT = 6, 5, 0.8


def features(state, action):
    out = [0.0] * (2 * STATES)
    out[2 * state + action] = 1.0
    return out


def steps(repeats):
    """Every step of a walk on a line, left or right, the last place ends it and pays 1."""
    rows = []
    for state in range(GOAL):
        for action in (0, 1):
            to = max(0, state - 1) if action == 0 else state + 1
            offered = None if to == GOAL else [features(to, a) for a in (0, 1)]
            rows += [(features(state, action), 1.0 if to == GOAL else 0.0, offered)] * repeats
    return rows


def test_chain_reaches_the_optimum(spark):
    odd = [(None, 1.0, None), (features(0, 0), None, None), (features(0, 0), float("nan"), None), ([float("inf")] * 12, 1.0, [])]
    found = policies.learn(spark.createDataFrame(steps(50) + odd, SCHEMA).repartition(3), "taken", "reward", "offered", DISCOUNT, 1e-6, 1e-6)
    values = found.weights.reshape(STATES, 2)
    for state in range(GOAL):
        right = DISCOUNT ** (GOAL - 1 - state)
        left = DISCOUNT * (DISCOUNT ** (GOAL - 1 - max(0, state - 1)))
        assert values[state] == pytest.approx([left, right], abs=1e-4)
        assert found.best(np.array([features(state, a) for a in (0, 1)])) == 1
    assert found.iterations < 12


def test_iterations_equal_dense_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.normal(0, 1, 3).tolist(), float(rng.normal()), rng.normal(0, 1, (int(rng.integers(1, 4)), 3)).tolist() if rng.random() < 0.8 else []) for _ in range(80)]
    got = policies.learn(spark.createDataFrame(rows, SCHEMA), "taken", "reward", "offered", 0.5, 0.1, 0.0, most=3)
    w = np.zeros(3)
    for _ in range(3):
        a, b = 0.1 * np.eye(3), np.zeros(3)
        for x, r, offered in rows:
            after = max((np.array(o) for o in offered), key=lambda o: o @ w) if offered else np.zeros(3)
            a += np.outer(x, np.array(x) - 0.5 * after)
            b += np.array(x) * r
        w = np.linalg.solve(a, b)
    assert got.weights == pytest.approx(w) and got.iterations == 3
    with pytest.raises(ValueError):
        policies.learn(spark.createDataFrame([], SCHEMA), "taken", "reward", "offered")


def test_repeated_steps_are_one_row(spark, monkeypatch):
    seen = []
    summed = policies.summed
    monkeypatch.setattr(policies, "summed", lambda rows, *a: seen.append(rows.count()) or summed(rows, *a))
    once, often = (policies.learn(spark.createDataFrame(steps(n), SCHEMA).repartition(3), "taken", "reward", "offered", DISCOUNT, 1e-6 * n, 1e-6) for n in (1, 40))
    assert set(seen) == {2 * GOAL} and often.weights == pytest.approx(once.weights)
