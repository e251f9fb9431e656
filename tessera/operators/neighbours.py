"""An index for nearest-neighbour search: rows in cells, queries in a few cells each.

Cells are the centres of k-means on a sample of at most SAMPLE rows (by hash of the key, so the same for the same
table); every row of the table is in the index, in its nearest cell. A query asks its nearest cells, and
meets their rows by a join: cells are cut into blocks of rows, a cell's queries into blocks of queries, and each
pair of blocks is one group of bounded size, however many rows or queries fall into one cell. Groups return the k best
of each of their queries, by true distance, and an aggregation merges them. Rows are read once, whatever the number of queries.

A neighbour is missed only if it lies in a cell that its query does not ask; asking more cells finds more, asking all finds all. How
many to ask is measured on the sample: as many as hold the target share of the nearest sampled rows of some of them, which lie
farther away than the nearest of all rows, so the estimate errs on the safe side.

Edge cases: null and empty vectors, and vectors with null or non-finite components, are left out on either side; a query finds
every row but those with its own key; of queries with one key the least vector asks; ties go to the smaller key; repeated rows are
repeated neighbours;
an empty table or no query gives no row; vectors have one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.landmarks import usable, vectors
from tessera.plans.session import table
from tessera.plans.shared import materialize

#: Rows that cells are fitted on, cells at most, and rows and queries of a block.
SAMPLE, CELLS, ROWS, QUERIES_A_BLOCK = 20_000, 2048, 4096, 1024
#: Sampled rows that the number of cells to ask is measured with, their neighbours, and the share of these to find.
ASKED, NEAREST, FOUND = 200, 10, 0.97


@dataclass(frozen=True)
class Index:
    """Centres, the rows (id, v, cell, block), the number of blocks of each cell (cell, blocks; a row a cell) and how many cells a query asks."""

    centres: np.ndarray
    rows: DataFrame
    sizes: DataFrame
    probes: int


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the nearest centre of each row, some rows at a time."""
    return np.concatenate([distances(x[i : i + 1024], centres).argmin(1) for i in range(0, len(x), 1024)])


def fitted(x: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """k-means centres of a sample; the starts are spread over the order of its rows, a cell that loses all rows keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def needed(x: np.ndarray, centres: np.ndarray, found: float = FOUND) -> int:
    """Cells to ask so that this share of the nearest sampled rows of ASKED rows of a sample is found."""
    asked = x[:: max(1, len(x) // ASKED)][:ASKED]
    order = np.argsort(distances(asked, centres), axis=1, kind="stable")
    places = np.argsort(order, axis=1)
    cells, ranks = nearest_centre(x, centres), []
    for place, own in zip(places, asked, strict=True):
        d = distances(own[None, :], x)[0]
        ranks.append(place[cells[np.argsort(d, kind="stable")[1 : NEAREST + 1]]])
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(found * len(ranks))))]) + 1 if len(ranks) else 1


def _in_cells(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """(id, v) with each of the n nearest cells, a row each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), 1024):
                part = b.slice(start, 1024)
                near = np.argsort(distances(vectors(part.column(1)), centres), axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(len(part)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(near.ravel().astype(np.int32))], names=["id", "v", "cell"])

    return df.mapInArrow(run, "id long, v array<double>, cell int")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(cell, blocks): how many blocks of about size rows each cell has; at most a row a cell."""
    return rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))


def build(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> Index:
    """The index of a table, written; cells default to the square root of the rows, at most CELLS."""
    rows = usable(df, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()  # a bounded sample
    sample = taken.flatten().to_numpy(zero_copy_only=False).reshape(len(taken), -1) if len(taken) else np.empty((0, 0))
    centres = fitted(sample, cells or min(CELLS, max(1, math.isqrt(n)))) if len(taken) else sample
    placed = materialize(_in_cells(rows, centres, 1), "cells")
    sizes = materialize(_blocks(placed, ROWS), "sizes")
    cut = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    return Index(centres, cut, sizes, needed(sample, centres) if len(taken) else 1)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(src, dst, dist): the k nearest rows to each query among the cells it asks, by squared distance; the index knows how many to ask."""
    asked = usable(queries, vector).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))
    if not len(index.centres):
        asked = asked.limit(0)
    asked = materialize(_in_cells(asked, index.centres, probes or index.probes), "asked")
    groups = F.broadcast(_blocks(asked, QUERIES_A_BLOCK).withColumnRenamed("blocks", "parts"))
    left = asked.join(groups, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(F.broadcast(index.sizes), "cell")
    left = left.select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")
    right = index.rows.join(groups, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "id", "v")

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"src": [], "dst": [], "dist": []})
        src, dst = q["id"].to_numpy(), r["id"].to_numpy()
        d = np.round(distances(np.stack(q["v"].to_list()), np.stack(r["v"].to_list())), 9)
        d[src[:, None] == dst[None, :]] = np.inf
        names = np.broadcast_to(dst, d.shape)
        order = np.lexsort((names, d), axis=1)[:, :k]
        d, names = np.take_along_axis(d, order, 1), np.take_along_axis(names, order, 1)
        on = np.isfinite(d)
        return pd.DataFrame({"src": np.broadcast_to(src[:, None], d.shape)[on], "dst": names[on], "dist": d[on]})

    by = ["cell", "part", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, "src long, dst long, dist double")
    best = found.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "dst"))), 1, k).alias("c"))  # at most k rows a group
    return best.select("src", F.explode("c").alias("e")).select("src", "e.dst", F.round("e.dist", 5).alias("dist"))


def _nearest(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return search(build(e), e.filter("vec_id % 50 = 0"), 5)


QUERIES = {"nearest_by_index": _nearest}
ORACLES: dict[str, str] = {}
