"""The neighbour index against full scans."""

import numpy as np
import pytest
from tessera.operators import graphs, neighbours

SCHEMA = "vec_id long, embedding array<double>"


def rows_of(x, first=0):
    return [(first + i, list(map(float, v))) for i, v in enumerate(x)]


def brute(x, asked, k):
    d = np.round(neighbours.distances(x[asked], x), 9)
    d[np.arange(len(asked)), asked] = np.inf
    return {(int(q), int(j)) for q, row in zip(asked, d, strict=True) for j in np.lexsort((np.arange(len(x)), row))[:k]}


def test_all_cells_asked_find_all(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 7)
    monkeypatch.setattr(neighbours, "QUERIES_A_BLOCK", 3)
    x = np.random.default_rng(1).normal(0, 1, (150, 6))
    df = spark.createDataFrame(rows_of(x), SCHEMA)
    index = neighbours.build(df, cells=5)
    assert index.rows.count() == 150 and index.rows.select("cell", "block").distinct().count() > 15
    asked = np.arange(0, 150, 10)
    got = neighbours.search(index, df.filter("vec_id % 10 = 0"), 4, probes=5).collect()
    assert {(r.src, r.dst) for r in got} == brute(x, asked, 4) and len(got) == 4 * len(asked)
    assert all(r.dist == pytest.approx(((x[r.src] - x[r.dst]) ** 2).sum(), abs=1e-5) for r in got)


def test_recall_on_the_given_vectors(spark):
    """At least nine of ten neighbours of a full scan are found, for all ids divisible by 50."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    got = {(r.src, r.dst) for r in neighbours.search(neighbours.build(e), e.filter("vec_id % 50 = 0"), 5).collect()}
    want = {(r.src, r.dst) for r in graphs.nearest(e.filter("vec_id % 50 = 0"), e, 5).collect()}
    assert len(want) >= 50 and len(got & want) / len(want) >= 0.9


def test_fewer_cells_are_asked_where_rows_cluster():
    rng = np.random.default_rng(3)
    spots = rng.normal(0, 10, (20, 8))
    near = spots[rng.integers(0, 20, 4000)] + rng.normal(0, 0.5, (4000, 8))
    loose = rng.normal(0, 1, (4000, 8))
    counts = [neighbours.needed(x, neighbours.fitted(x, 60)) for x in (near, loose)]
    assert counts[0] < counts[1] < 60


def test_a_crowded_cell_is_split(spark, monkeypatch):
    """A third of all rows are one vector: their cell has several blocks, and ties go to the smaller ids."""
    monkeypatch.setattr(neighbours, "ROWS", 10)
    x = np.random.default_rng(2).normal(0, 1, (90, 4))
    x[::3] = x[0]
    df = spark.createDataFrame(rows_of(x), SCHEMA)
    index = neighbours.build(df, cells=4)
    assert max(r.blocks for r in index.sizes.collect()) >= 3
    got = neighbours.search(index, df.filter("vec_id = 3"), 3, probes=1).collect()
    assert sorted((r.dst, r.dist) for r in got) == [(0, 0.0), (6, 0.0), (9, 0.0)]


def test_edge_cases(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, None), (4, []), (5, [float("nan"), 0.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.search(neighbours.build(df), df, 3).collect()
    assert sorted((r.src, r.dst, r.dist) for r in got) == [(1, 2, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    empty = df.filter("vec_id > 9")
    assert neighbours.search(neighbours.build(empty), df, 3).count() == 0
    assert neighbours.search(neighbours.build(df), empty, 3).count() == 0
