"""Communities and spectral clusters against dense matrices and planted blocks."""

import random

import numpy as np
import pytest
from tessera.operators import communities, graphs

SCHEMA = "i1 long, i2 long, w double"


def planted(blocks, size, inside, across, seed):
    """Edges of blocks with this many edges a node inside and across, and every node's block."""
    rng = random.Random(seed)
    nodes = range(blocks * size)
    found = {}
    for i in nodes:
        for _ in range(inside):
            j = rng.choice([x for x in nodes if x % blocks == i % blocks and x != i])
            found[min(i, j), max(i, j)] = rng.choice([1.0, 2.0])
        for _ in range(across):
            j = rng.choice([x for x in nodes if x % blocks != i % blocks])
            if rng.random() < 0.3:
                found[min(i, j), max(i, j)] = 1.0
    return [(i, j, w) for (i, j), w in found.items()]


def dense(edges, n):
    a = np.zeros((n, n))
    for i, j, w in edges:
        a[i, j] = a[j, i] = w
    return a


def quality(a, labels):
    k = a.sum(1)
    b = a - np.outer(k, k) / k.sum()
    same = np.array(labels)[:, None] == np.array(labels)[None, :]
    return (b * same).sum() / k.sum()


def test_products_against_dense(spark):
    edges = planted(2, 6, 2, 1, 3)
    a = dense(edges, 12)
    links = graphs.both_ways(spark.createDataFrame(edges, SCHEMA))
    x = np.arange(12) - 4.5
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "node long, x double")
    got = {r.node: r.ax for r in communities.products(links, values, "x").collect()}
    assert [got[i] for i in range(12)] == pytest.approx(list(a @ x))


def test_split_against_dense(spark):
    """Sides and gain of one split are those of the dense matrix."""
    edges = planted(2, 8, 3, 1, 5)
    a = dense(edges, 16)
    k, two_m = a.sum(1), a.sum()
    links = graphs.both_ways(spark.createDataFrame(edges, SCHEMA))
    nodes = spark.createDataFrame([(i, 0, float(k[i])) for i in range(16)], "node long, g long, k double")
    rows = communities.split(links, nodes, float(two_m), steps=8, moves=1).collect()
    s = np.array([r.s for r in sorted(rows, key=lambda r: r.node)])
    b = a - np.outer(k, k) / two_m
    assert rows[0].gain == pytest.approx(s @ b @ s / (2 * two_m))
    best = np.linalg.eigh(b)[1][:, -1]
    assert abs(np.sign(best) @ s) >= 14
    assert len({(i % 2, v) for i, v in enumerate(s)}) == 2


def test_planted_communities(spark):
    edges = planted(3, 10, 4, 1, 7)
    got = communities.newman_communities(spark.createDataFrame(edges, SCHEMA), levels=3, steps=6, moves=1).collect()
    labels = [r.community for r in sorted(got, key=lambda r: r.node)]
    assert len(labels) == 30 and {(i % 3, c) for i, c in enumerate(labels)} == {(0, 0), (1, 1), (2, 2)}


def test_nations_part_better_than_by_votes(spark):
    edges = communities._edges(spark, "/root/testdata/sf0.001")
    rows = [(r.i1, r.i2, r.w) for r in edges.collect()]
    a = dense(rows, 25)
    found = dict((r.node, r.community) for r in communities.QUERIES["newman_communities"](spark, "/root/testdata/sf0.001").collect())
    voted = dict((r.node, r.label) for r in graphs.propagate(edges, 3).collect())
    assert quality(a, [found[i] for i in range(25)]) > max(0.015, quality(a, [voted[i] for i in range(25)]))


def test_edge_cases(spark):
    def run(rows):
        return {(r.node, r.community) for r in communities.newman_communities(spark.createDataFrame(rows, SCHEMA), levels=1, steps=5, moves=1).collect()}

    assert run([]) == set()
    assert run([(1, 2, 0.0)]) == {(1, 1), (2, 1)}
    assert run([(5, 5, 1.0)]) == {(5, 5)}
    assert run([(1, 2, 1.0), (3, 4, 1.0)]) == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_spectral_blocks(spark):
    edges = planted(3, 10, 4, 1, 11)
    frame = spark.createDataFrame(edges, SCHEMA)
    a = dense(edges, 30)
    d = 1 / np.sqrt(a.sum(1))
    want = np.sort(np.linalg.eigvalsh(d[:, None] * a * d[None, :]))[::-1][:3]
    values, vectors, away = communities.spectral_vectors(frame, 3, 12)
    assert values == pytest.approx(want, abs=0.01) and max(away) < 0.1
    x = np.array([r.x for r in sorted(vectors.collect(), key=lambda r: r.node)])
    assert x.T @ x == pytest.approx(np.eye(3), abs=1e-9)
    got = {r.node: r.cluster for r in communities.spectral_clusters(frame, 3, 6, 4).collect()}
    assert {(i % 3, got[i]) for i in range(30)} == {(0, 0), (1, 1), (2, 2)}


def test_spectral_edge_cases(spark):
    frame = spark.createDataFrame([(1, 2, 1.0), (3, 3, 5.0)], SCHEMA)
    assert {(r.node, r.cluster) for r in communities.spectral_clusters(frame, 1).collect()} == {(1, 1), (2, 1), (3, 1)}
    with pytest.raises(ValueError):
        communities.spectral_vectors(frame, 3)
