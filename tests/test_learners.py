"""Learners and group kernels against brute force and golden shapes."""

import itertools
import random
import time

import numpy as np
from pyspark.sql import functions as F
from tessera.operators import kernels, learners


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (4, 6), (5, 5)]:
        cost = rng.integers(-5, 20, (n, m))
        got = kernels.best_assignment(cost)
        best = max(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert len(set(got)) == n and sum(cost[i, got[i]] for i in range(n)) == best


def slow_linkage(points, least, most=np.inf):
    """All distances, searched anew in every step."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    label = list(range(len(points)))
    for _ in range(len(points) - max(least, 1)):
        i, j = sorted(int(k) for k in np.unravel_index(np.argmin(d), d.shape))
        if not d[i, j] < most:
            break
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        label = [i if k == j else k for k in label]
    return [sorted(set(label), key=label.index).index(k) for k in label]


def test_complete_linkage_equals_its_definition():
    rng = np.random.default_rng(6)
    for dims in (1, 2):
        for n in (1, 2, 5, 30):
            for _ in range(15):
                points = rng.integers(0, 12, (n, dims)).astype(float)  # copies and ties
                for least, most in ((1, np.inf), (2, np.inf), (4, 3.0), (n - 1, np.inf), (1, 0.0)):
                    assert kernels.complete_linkage(points, least, most).tolist() == slow_linkage(points, least, most), (points, least, most)
                points = rng.normal(0, 1, (n, dims)).round(2)
                assert kernels.complete_linkage(points, 2).tolist() == slow_linkage(points, 2)


def test_complete_linkage_of_a_long_line():
    began = time.process_time()
    x = np.random.default_rng(1).uniform(0, 1, (20_000, 1)).round(5)
    label = kernels.complete_linkage(x, 2)
    assert len(set(label)) == 2 and time.process_time() - began < 20
    sides = sorted((x[label == k].min(), x[label == k].max()) for k in (0, 1))
    assert sides[0][1] < sides[1][0]


def test_complete_linkage_golden():
    square = [(0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5)]
    points = np.array([(x + o, y + o) for o in (0, 3, 7) for x, y in square])
    assert kernels.complete_linkage(points, 3).tolist() == [0] * 4 + [1] * 4 + [2] * 4
    assert len(set(kernels.complete_linkage(points, 1, 4.0))) == 3
    assert len(set(kernels.complete_linkage(points, 1, 4.95))) == 2


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4):
        emit, move = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))

        def score(p, emit=emit, move=move):
            return sum(emit[i, x] for i, x in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))

        assert kernels.viterbi(emit, move) == list(max(itertools.product(range(3), repeat=n), key=score))
    assert kernels.viterbi(np.zeros((0, 3)), np.zeros((3, 3))) == []


def test_number_ranges_cover_and_stay_narrow():
    rng = random.Random(0)
    for _ in range(50):
        x = np.array([rng.uniform(0, 20) for _ in range(rng.randint(0, 25))])
        got = kernels.number_ranges(x, 3.0)
        assert all(b - a <= 3.0 for a, b in got) and all(any(a <= v <= b for a, b in got) for v in x)


def test_linear_learners(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = x @ [2.0, -1.0, 0.5] + 3 + 0.01 * rng.normal(size=600)
    rows = [(i, *map(float, r), float(t), float(t > 3), float(i % 3)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, label double, cls double")
    w = learners.ridge(df, ["a", "b", "c"], "y")
    assert np.allclose(w, [2, -1, 0.5, 3], atol=0.01)
    assert abs(learners.ridge(df, ["a", "b", "c"], "y", 1e6)[0]) < 0.1
    cv = learners.cross_validated(df, "id", ["a", "b", "c"], "y", 3)
    assert cv.count() == 600 and cv.agg(F.avg(F.abs(F.col("guess") - F.col("y")))).first()[0] < 0.02
    svm = learners.linear_svm(df, ["a", "b", "c"], "label").transform(df)
    assert svm.filter("prediction = label").count() > 580
    forest = learners.forest(df, ["a", "b", "c"], "y", trees=20).transform(df)
    assert forest.agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).first()[0] < 1.5
    assert learners.principal(df, ["a", "b", "c"], 2).transform(df).select("components").first()[0].size == 2
    assert learners.elastic_net(df, ["a", "b", "c"], "y", 0.01).transform(df).agg(F.corr("prediction", "y")).first()[0] > 0.99


def test_class_learners(spark):
    rng = np.random.default_rng(3)
    rows = [(float(c), *map(float, rng.normal(size=3) + np.array([4.0 * c, -3.0 * (c == 1), 0]))) for c in range(3) for _ in range(100)]
    df = spark.createDataFrame(rows, "cls double, a double, b double, c double")
    fit = learners.multiclass(df, ["a", "b", "c"], "cls").transform(df)
    assert fit.filter("prediction = cls").count() > 280
    d = learners.discriminants(df, ["a", "b", "c"], "cls", 2)
    assert d.shape == (2, 3) and abs(d[0][2]) < 0.2


def test_isotonic_and_platt(spark):
    df = spark.createDataFrame([(float(i), float(v)) for i, v in enumerate([1, 3, 2, 4, 3.5, 6])], "x double, y double")
    got = [r.prediction for r in learners.isotonic(df, "x", "y").transform(df).orderBy("x").collect()]
    assert got == [1, 2.5, 2.5, 3.75, 3.75, 6]
    rng = np.random.default_rng(4)
    s = rng.normal(size=3000)
    hit = rng.random(3000) < 1 / (1 + np.exp(-(2 * s + 0.5)))
    a, b = learners.platt(spark.createDataFrame([(float(v), bool(h)) for v, h in zip(s, hit, strict=True)], "s double, h boolean"), "s", "h")
    assert abs(a + 2) < 0.25 and abs(b + 0.5) < 0.2


def test_cut_labels_and_parse_against_brute_force():
    rng = random.Random(6)
    for _ in range(30):
        n = rng.randint(2, 6)
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 5)) for _ in range(8)]
        value, side = kernels.min_cut(n, edges, 0, n - 1)
        cuts = [{0, *c} for r in range(n - 1) for c in itertools.combinations(range(1, n - 1), r)]
        best = min(sum(w for a, b, w in edges if a in c and b not in c) for c in cuts)
        assert value == best and sum(w for a, b, w in edges if a in side and b not in side) == best
        node = np.array([rng.randint(-4, 4) for _ in range(n)])

        def score(y, node=node, edges=edges):
            return sum(node[i] * y[i] for i in range(len(node))) - sum(w for a, b, w in edges if y[a] != y[b])

        assert score(kernels.binary_labels(node, edges)) == max(score(y) for y in itertools.product((0, 1), repeat=n))
    lexical = np.array([[0.0, -np.inf], [0.0, -1.0], [-1.0, 0.0]])
    assert kernels.best_parse(3, lexical, [(0, 0, 1, 1.0), (1, 0, 1, 0.5)], 0) == (1.5, (0, (0, 0), (1, (0, 1), (1, 2))))
    assert kernels.best_parse(2, lexical, [], 0) is None


def test_canonical_correlation(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(500, 1))
    x, y = np.hstack([z + 0.1 * rng.normal(size=(500, 1)), rng.normal(size=(500, 1))]), np.hstack([rng.normal(size=(500, 1)), -z + 0.1 * rng.normal(size=(500, 1))])
    df = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(x, y, strict=True)], "a double, b double, c double, d double")
    left, right, s = learners.canonical(df, ["a", "b"], ["c", "d"], 2)
    assert s[0] > 0.97 and s[1] < 0.2 and abs(np.corrcoef(x @ left[0], y @ right[0])[0, 1] - s[0]) < 1e-6


def test_factors_against_enumeration(spark):
    from tessera.operators import factors

    rows = [(a, b, c) for a in "xy" for b in "pq" for c in "mn" for _ in range({"xpm": 3, "xqn": 5, "ypm": 1}.get(a + b + c, 2))]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    joint = factors.normalized(df.groupBy("a", "b", "c").agg(F.count("*").cast("double").alias("p")))
    got = {r.a: r.p for r in factors.query([joint], ["a"], c="m").collect()}
    n = {a: sum(r[0] == a and r[2] == "m" for r in rows) for a in "xy"}
    assert all(abs(got[a] - n[a] / sum(n.values())) < 1e-12 for a in "xy")
