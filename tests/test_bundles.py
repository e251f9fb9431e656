"""Cutting planes, classifiers, rankers and sequence labellers against brute force and planted models."""

import itertools

import numpy as np
import pytest
from tessera.operators import bundles


def optimal(fit, objective, seed=0):
    """No nearby weights are better by more than the stated gap."""
    rng = np.random.default_rng(seed)
    for scale in (1.0, 0.1, 0.01):
        for _ in range(100):
            assert objective(fit.weights + rng.normal(0, scale, len(fit.weights))) >= fit.objective - fit.gap - 1e-9


def test_planes_are_solved_to_the_bound():
    rng = np.random.default_rng(1)
    for positive in (0, 2):
        planes, heights = rng.normal(0, 1, (12, 4)), rng.normal(0, 1, 12)
        free = np.arange(4) >= positive
        w, low = bundles.lowest(planes, heights, 2.0, free, 1e-9)
        assert (w[:positive] >= 0).all()
        assert 0.5 * w @ w + 2.0 * (heights + planes @ w).max() == pytest.approx(low, abs=1e-6)


def test_minimum_of_a_known_risk():
    """Half the square plus c times the sum of distances to a point has a closed form."""
    goal = np.array([3.0, -0.2, 0.5])

    def risk(w):
        return float(np.abs(w - goal).sum()), np.sign(w - goal)

    fit = bundles.minimise(risk, 3, 1.0, close=1e-6)
    assert fit.gap <= 1e-6 and fit.weights == pytest.approx([1.0, -0.2, 0.5], abs=1e-2)
    assert bundles.minimise(risk, 3, 1.0, close=1e-6, positive=2).weights == pytest.approx([1.0, 0.0, 0.5], abs=1e-2)
    assert bundles.minimise(risk, 3, 1.0, close=1e-6, prior=np.array([2.5, 1.0, 0.0])).weights == pytest.approx([3.0, 0.0, 0.5], abs=1e-2)
    with pytest.raises(ValueError):
        bundles.minimise(risk, 3, 1.0, prior=goal, positive=1)


def test_classifier(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(0, 1, (200, 2)), np.ones(200)])
    y = np.where(x @ [1.0, -2.0, 0.3] + rng.normal(0, 0.3, 200) > 0, 1, -1)
    rows = [(list(map(float, a)), int(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([*rows, ([1.0, 2.0, 3.0], None), (None, 1), ([float("nan"), 0.0, 0.0], 1), ([1.0, 1.0, 1.0], 5)], "v array<double>, y int")

    def objective(w, c=5.0):
        return 0.5 * w @ w + c * np.maximum(1 - y * (x @ w), 0).mean()

    risk, size = bundles.hinge(df, "v", "y")
    value, slope = risk(np.array([0.5, -0.5, 0.1]))
    short = 1 - y * (x @ [0.5, -0.5, 0.1])
    assert size == 3 and value == pytest.approx(np.maximum(short, 0).mean())
    assert slope == pytest.approx(-(x * (y * (short > 0))[:, None]).mean(0))
    fit = bundles.linear_machine(df, "v", "y", 5.0, close=2e-3)
    assert fit.gap <= 5 * 2e-3 and fit.objective == pytest.approx(objective(fit.weights))
    optimal(fit, objective)
    with pytest.raises(ValueError):
        bundles.hinge(df.filter("y = 7"), "v", "y")


def ranking_rows(seed, n, queries):
    """One query holds half of all rows."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, 3)).astype(float)
    q = np.where(rng.random(n) < 0.5, 0, rng.integers(0, queries, n))
    rel = (x @ [1.0, -0.5, 0.0] + rng.normal(0, 0.5, n) > 1).astype(int)
    return q, rel, x


def brute_risk(q, rel, x, w):
    s, value, slope, pairs, right = x @ w, 0.0, np.zeros(len(w)), 0, 0
    for i in np.flatnonzero(rel == 1):
        for j in np.flatnonzero((rel == 0) & (q == q[i])):
            pairs += 1
            right += s[i] > s[j]
            if 1 - s[i] + s[j] > 0:
                value += 1 - s[i] + s[j]
                slope += x[j] - x[i]
    return value / pairs, slope / pairs, right / pairs


def ranking_frame(spark, q, rel, x):
    rows = [(int(a), bool(b), list(map(float, c))) for a, b, c in zip(q, rel, x, strict=True)]
    return spark.createDataFrame([*rows, (None, True, [0.0, 0.0, 0.0]), (1, None, [0.0, 0.0, 0.0]), (1, True, None), (99, True, [1.0, 1.0, 1.0])], "q int, rel boolean, v array<double>")


def test_ranking_risk_against_all_pairs(spark):
    q, rel, x = ranking_rows(3, 120, 4)
    df = ranking_frame(spark, q, rel, x)
    risk, size = bundles.ranking(df, "q", "rel", "v")
    assert size == 3
    for w in ([0.0, 0.0, 0.0], [0.25, -0.5, 0.125]):  # scores that tie exactly
        value, slope = risk(np.array(w))
        want = brute_risk(q, rel, x, np.array(w))
        assert value == pytest.approx(want[0]) and slope == pytest.approx(want[1])
        assert bundles.right_order(df, "q", "rel", "v", np.array(w)) == pytest.approx(want[2])
    with pytest.raises(ValueError):
        bundles.ranking(df.filter("q = 99"), "q", "rel", "v")


def test_equal_rows_are_ranked_once(spark):
    q, rel, x = (np.repeat(part, 3, axis=0) for part in ranking_rows(5, 40, 2))
    df = ranking_frame(spark, q, rel, x)
    rows, _, _, _ = bundles._pairs(df, "q", "rel", "v")
    assert rows.count() == len({(a, b, tuple(c)) for a, b, c in zip(q.tolist(), rel.tolist(), x.tolist(), strict=True)}) + 1
    w = np.array([0.25, -0.5, 0.125])
    value, slope = bundles.ranking(df, "q", "rel", "v")[0](w)
    want = brute_risk(q, rel, x, w)
    assert value == pytest.approx(want[0]) and slope == pytest.approx(want[1])
    assert bundles.right_order(df, "q", "rel", "v", w) == pytest.approx(want[2])


def test_ranker_reaches_its_gap(spark):
    q, rel, x = ranking_rows(4, 80, 3)
    df = ranking_frame(spark, q, rel, x)
    fit = bundles.rank_machine(df, "q", "rel", "v", 4.0, close=0.02)
    assert fit.gap <= 4 * 0.02
    optimal(fit, lambda w: 0.5 * w @ w + 4 * brute_risk(q, rel, x, w)[0])
    assert bundles.right_order(df, "q", "rel", "v", fit.weights) > 0.85 and fit.weights[0] > 0 > fit.weights[1]


def test_a_prior_is_kept_where_rows_say_nothing(spark):
    def pair(a, b):
        return spark.createDataFrame([(1, True, a), (1, False, b)], "q int, rel boolean, v array<double>")

    first = bundles.rank_machine(pair([0.0, 0.0, 1.0], [0.0, 1.0, 0.0]), "q", "rel", "v", 10.0, close=0.01)
    both = bundles.rank_machine(pair([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), "q", "rel", "v", 10.0, close=0.01, prior=first.weights)
    assert both.weights[0] > 0 > both.weights[1] and both.weights[2] > 0


def test_best_labels_against_enumeration():
    rng = np.random.default_rng(5)
    shape = bundles.Labels(3, 4)
    for n in (1, 2, 5):
        w, x, y = rng.normal(0, 1, shape.size), rng.integers(0, 4, n), rng.integers(0, 3, n)
        for avoid in (None, y):
            every = [np.array(z) for z in itertools.product(range(3), repeat=n)]
            scores = [w @ shape.counts(x, z) + (0 if avoid is None else 0.7 * (z != y).sum()) for z in every]
            found, top = shape.best(w, x, avoid, 0.7)
            assert top == pytest.approx(max(scores)) and (found == every[int(np.argmax(scores))]).all()


def test_planted_chain_of_labels(spark):
    """Trained weights label about as well as the model that made the sequences."""
    rng = np.random.default_rng(6)
    follow = np.array([[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]])
    emit = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.4, 0.4]])
    shape = bundles.Labels(3, 4)

    def drawn(n):
        rows = []
        for k in range(n):
            y = [int(rng.integers(0, 3))]
            for _ in range(int(rng.integers(0, 30))):
                y.append(int(rng.choice(3, p=follow[y[-1]])))
            rows.append((k, [int(rng.choice(4, p=emit[v])) for v in y], y))
        return rows

    schema = "id int, x array<int>, y array<int>"
    train, held = drawn(120), drawn(60)
    df = spark.createDataFrame([*train, (200, None, [0]), (201, [1, 2], [0]), (202, [9], [0]), (203, [], []), (204, [1, None], [1, 1])], schema)
    risk = bundles.labelling(df, "x", "y", shape)
    w = rng.normal(0, 1, shape.size)
    value, slope = risk(w)
    parts = [(shape.best(w, np.array(x), np.array(y)), shape.counts(np.array(x), np.array(y))) for _, x, y in train]
    assert value == pytest.approx(np.mean([top - w @ own for (_, top), own in parts]))
    assert slope == pytest.approx(np.mean([shape.counts(np.array(x), z) - own for (_, x, _), ((z, _), own) in zip(train, parts, strict=True)], axis=0))
    fit = bundles.label_machine(df, "x", "y", shape, 20.0, close=0.05, most=40)
    true = np.concatenate([np.log(follow).ravel(), np.log(emit).ravel()])

    def accuracy(weights):
        rows = bundles.labelled(spark.createDataFrame(held, schema), "x", shape, weights).collect()
        return sum(a == b for r in rows for a, b in zip(r.y, r.labelled, strict=True)) / sum(len(r.y) for r in rows)

    assert accuracy(fit.weights) > accuracy(true) - 0.03 > 0.7
    odd = spark.createDataFrame([(1, None, None), (2, [], None), (3, [7], None), (4, [0], None)], schema)
    assert {r.id: r.labelled is None for r in bundles.labelled(odd, "x", shape, fit.weights).collect()} == {1: True, 2: True, 3: True, 4: False}
