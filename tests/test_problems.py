"""Problem checks, cliques, losses and robust trends on hand-made values."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F
from tessera.operators import datasets, problems, statistics


def holds(df):
    return df.first()[0]


def test_problems(spark):
    labels = spark.createDataFrame([(1,), (-1,), (1,)], "y int")
    assert holds(problems.binary_problem(labels, F.col("y")))
    assert not holds(problems.binary_problem(labels.filter("y > 0"), F.col("y"))) and not holds(problems.binary_problem(labels.limit(0), F.col("y")))
    assert not holds(problems.binary_problem(labels.unionByName(spark.createDataFrame([(None,)], "y int")), F.col("y")))
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "k string, r boolean")
    assert not holds(problems.ranking_problem(rows, "k", F.col("r"))) and holds(problems.ranking_problem(rows.filter("k = 'a'"), "k", F.col("r")))
    assert not holds(problems.track_problem(rows, "r", "k")) or rows.count() == 3
    assert holds(problems.track_problem(rows, "k", "r")) and not holds(problems.track_problem(rows.filter("k = 'a'"), "k", "r"))
    assert not holds(problems.track_problem(rows.unionByName(rows), "k", "r"))


def test_segments_and_assignments(spark):
    def segments(*pairs):
        df = spark.createDataFrame([(5, [{"begin": a, "end": b} for a, b in pairs])], "n int, s array<struct<begin:int,end:int>>")
        return holds(problems.segmentation_problem(df, F.col("n"), F.col("s")))

    assert segments() and segments((3, 5), (0, 3)) and not segments((0, 6)) and not segments((2, 2)) and not segments((0, 3), (2, 4))

    def assigned(left, right, labels, forced=False):
        df = spark.createDataFrame([(left, right, labels)], "a int, b int, l array<int>")
        return holds(problems.assignment_problem(df, F.col("a"), F.col("b"), F.col("l"), forced))

    assert assigned(2, 3, [2, -1]) and assigned(2, 3, [-1, -1]) and not assigned(2, 3, [1, 1]) and not assigned(2, 3, [3, 0]) and not assigned(2, 3, [0])
    assert assigned(2, 3, [2, 0], True) and not assigned(2, 3, [2, -1], True) and assigned(0, 3, [], True)


def test_cliques_by_brute_force(spark):
    rng = random.Random(3)
    pairs = [(a, b) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.6]
    sets = {k: sorted(c) for k, c in enumerate(c for n in (1, 2, 3, 4) for c in itertools.combinations(range(9), n))}
    e = {frozenset(p) for p in pairs}
    got = {r.clique: (r.n, r.is_clique, r.is_maximal) for r in problems.clique_report(spark.createDataFrame(pairs, "i1 long, i2 long").withColumn("w", F.lit(1.0)), spark.createDataFrame([(k, v) for k, c in sets.items() for v in c], "clique long, node long")).collect()}
    for k, c in sets.items():
        whole = all(frozenset(p) in e for p in itertools.combinations(c, 2))
        more = any(all(frozenset((v, x)) in e for x in c) for v in range(9) if v not in c)
        assert got[k] == (len(c), whole, whole and not more), c


def test_class_log_loss_leaves_out_what_has_no_score(spark):
    df = spark.createDataFrame([([1000.0, 0.0], 0), ([0.0, 0.0], 1), ([1.0, 2.0], 7), ([1.0, 2.0], None)], "x array<double>, y int")
    got = [r[0] for r in df.select(problems.class_log_loss(F.col("y"), F.col("x"))).collect()]
    assert got == [0.0, math.log(2), None, None]


def test_shares(spark):
    def gain(*v):
        return spark.range(1).select(statistics.share_difference(*map(F.lit, v))).first()[0]

    assert gain(3, 6, 5, 10) == 0.0 and gain(0, 0, 0, 0) == 0.0 and gain(9, 10, 1, 10) > 0 > gain(1, 10, 9, 10)
    assert abs(gain(10, 10, 0, 10) - 20 * math.log(2)) < 1e-12


def test_robust_suffix_by_brute_force():
    rng = np.random.default_rng(5)
    for trial in range(60):
        v = np.round(rng.normal(size=rng.integers(0, 25)) + np.linspace(0, rng.normal() * 3, 1), 1)
        if len(v) > 4 and trial % 2:
            v[rng.integers(len(v))] += 50
        edge = np.sort(v)[math.floor((len(v) - 1) * 0.9 + 0.5)] if len(v) else 0
        want = 0
        for j in range(1, len(v) + 1):
            y = [x for x in v[::-1][:j] if x <= edge]
            if len(y) > 2:
                k = np.arange(len(y))
                slope, base = np.polyfit(k, y, 1)
                err = math.sqrt(((y - slope * k - base) ** 2).sum() / (len(y) - 2) * 12 / (len(y) ** 3 - len(y)))
                chance = 0.5 * (1 + math.erf(slope / err / math.sqrt(2))) if err > 1e-9 else 0.5 + 0.5 * np.sign(round(slope, 9))
                if chance < 0.51:
                    want = j
        assert datasets.steps_without(v, discard=0.1) == want


def test_without_largest(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([3, 100, 4, 5, 4, 6, 2, 9, 1, 0, 7])] + [(2, 0, 8.0)], "k int, i int, v double")
    left = statistics.without_largest(df, "k", "v", ["i"]).collect()
    assert sorted(r.v for r in left if r.k == 1) == [0, 1, 2, 3, 4, 4, 5, 6, 7, 9] and [r.v for r in left if r.k == 2] == [8.0]
