"""Join trees against full enumeration."""

import itertools

import pytest
from tessera.operators import join_trees

#: A public example: visits, smoking, three illnesses, their union, an image and short breath; chances of 1 by parents.
NET = {
    "visit": ((), {(): 0.01}), "smoke": ((), {(): 0.5}), "tub": (("visit",), {(0,): 0.01, (1,): 0.05}), "lung": (("smoke",), {(0,): 0.01, (1,): 0.1}),
    "bron": (("smoke",), {(0,): 0.3, (1,): 0.6}), "either": (("tub", "lung"), {(0, 0): 0.0, (0, 1): 1.0, (1, 0): 1.0, (1, 1): 1.0}),
    "image": (("either",), {(0,): 0.05, (1,): 0.98}), "breath": (("either", "bron"), {(0, 0): 0.1, (0, 1): 0.8, (1, 0): 0.7, (1, 1): 0.9}),
}


def factors(spark, net=NET):
    out = []
    for name, (parents, chances) in net.items():
        rows = [(*key, v, p if v else 1 - p) for key, p in chances.items() for v in (0, 1)]
        out.append(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in (*parents, name)) + ", p double"))
    return out


def enumerated(evidence, net=NET):
    names = list(net)
    total, sums = 0.0, {}
    for values in itertools.product((0, 1), repeat=len(names)):
        at = dict(zip(names, values, strict=True))
        if any(at[k] != v for k, v in evidence.items()):
            continue
        p = 1.0
        for name, (parents, chances) in net.items():
            one = chances[tuple(at[x] for x in parents)]
            p *= one if at[name] else 1 - one
        total += p
        for name in names:
            sums[name, str(at[name])] = sums.get((name, str(at[name])), 0.0) + p
    return {k: v / total for k, v in sums.items() if k[0] not in evidence}


def test_cliques_are_maximal_and_cover_the_scopes():
    scopes = [{"a", "b"}, {"b", "c"}, {"c", "d"}, {"d", "a"}, {"e"}]
    found = join_trees.cliques(scopes)
    assert all(any(s <= c for c in found) for s in scopes)
    assert not any(a < b for a in found for b in found)
    assert sorted(map(len, found)) == [1, 3, 3]


def test_trees_keep_each_variable_connected():
    scopes = [{"a", "b", "c"}, {"c", "d"}, {"d", "e", "f"}, {"f", "g"}, {"b", "h"}, {"x", "y"}]
    of = join_trees.cliques(scopes)
    edges = join_trees.tree(of)
    assert len(edges) == len(of) - 2  # two parts
    for v in {v for c in of for v in c}:
        holding = {i for i, c in enumerate(of) if v in c}
        assert sum(a in holding and b in holding for a, b in edges) == len(holding) - 1


@pytest.mark.parametrize("evidence", [{}, {"image": 1, "visit": 1}])
def test_all_marginals_equal_enumeration(spark, evidence):
    got = {(r.variable, r.value): r.p for r in join_trees.calibrated(factors(spark), **evidence).marginals().collect()}
    want = enumerated(evidence)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    if not evidence:
        assert got["either", "1"] == pytest.approx(0.064828) and got["image", "1"] == pytest.approx(0.11029004)


def test_edge_cases(spark):
    apart = factors(spark, {"a": ((), {(): 0.25}), "b": ((), {(): 0.5})})
    got = {(r.variable, r.value): r.p for r in join_trees.calibrated(apart).marginals().collect()}
    assert got == {("a", "0"): 0.75, ("a", "1"): 0.25, ("b", "0"): 0.5, ("b", "1"): 0.5}
    assert {r.value for r in join_trees.calibrated(apart, a=7).marginals().collect()} == {"0", "1"}
    with pytest.raises(ValueError):
        join_trees.calibrated(apart, a=1, b=0)
    with pytest.raises(ValueError):
        join_trees.calibrated(apart).marginal("a", "b")
