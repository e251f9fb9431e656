"""Bounded pairwise work: large groups become pairs of blocks, each a small task of its own.

A group of c rows is cut by a hash of the row's id into ceil(c / size) blocks.
Every pair of blocks, a block with itself included, is compared on its own, so
each pair of rows meets exactly once, no task holds more than two blocks, and a
row is copied as often as its group has blocks: once in all but large groups.
Block pairs are dealt by ranges of equal row counts, as hashing would put several
large ones into one task. A range never cuts a block pair.
Kernels return counts and a spanning forest, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What kernels return: row id and number of links found (other null), or a forest edge (n 0).
FOUND = "id long, other long, n long"
_FOUND = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])


def deal(rows: DataFrame, key: str, row_id: str, count: str, size: int) -> DataFrame:
    """rows by block pair, sorted so that each pair's rows follow each other: key, _i, _j, _block and the other columns; count is dropped."""
    n = F.ceil(F.col(count) / size).cast("int")
    cut = rows.withColumn("_n", n).withColumn("_block", F.pmod(F.xxhash64(F.lit(7), row_id), "_n").cast("int"))
    pairs = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pairs = pairs.withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other")).drop("_n", "_other", count)
    keys = [key, "_i", "_j"]
    return pairs.repartitionByRange(*keys).sortWithinPartitions(*keys)


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted stream, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        values = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(b), dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), len(b)]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            now = tuple(v[s] for v in values)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def pair_mask(block: np.ndarray, same: bool) -> np.ndarray:
    """Which ordered pairs of rows this task compares: all but a row with itself, or those across the two blocks."""
    if same:
        return ~np.eye(len(block), dtype=bool)
    return block[:, None] != block[None, :]


def forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric link matrix, as (row, smallest id of its part found here)."""
    out: list[tuple[int, int]] = []
    todo = linked.any(1)
    order = np.argsort(ids, kind="stable")
    for i in order[todo[order]]:
        if not todo[i]:
            continue
        todo[i] = False
        front = linked[i]
        seen = np.zeros(len(ids), dtype=bool)
        seen[i] = True
        while (new := front & ~seen).any():
            seen |= new
            front = linked[new].any(0)
        todo &= ~seen
        root = int(ids[i])
        out += [(int(x), root) for x in ids[seen] if x != root]
    return out


class Out:
    """Collects kernel rows and hands them on in batches."""

    def __init__(self, size: int = 50_000):
        self.size, self.parts, self.n = size, [], 0

    def add(self, ids: np.ndarray, counts: np.ndarray, edges: list[tuple[int, int]]) -> None:
        on = counts > 0
        e = np.array(edges, dtype=np.int64).reshape(-1, 2)
        k = int(on.sum())
        if k + len(e):
            self.parts.append((np.concatenate([ids[on], e[:, 0]]), np.concatenate([np.zeros(k, np.int64), e[:, 1]]), np.concatenate([counts[on], np.zeros(len(e), np.int64)]), np.arange(k + len(e)) < k))
            self.n += k + len(e)

    def full(self) -> bool:
        return self.n >= self.size

    def batch(self) -> pa.RecordBatch:
        a, b, n, null = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=null), pa.array(n)], schema=_FOUND)


def stream(batches: Iterable[pa.RecordBatch], keys: list[str], kernel) -> Iterator[pa.RecordBatch]:
    """kernel(table) -> (ids, counts, edges) over every run of equal keys."""
    out = Out()
    for table in grouped(batches, keys):
        out.add(*kernel(table))
        if out.full():
            yield out.batch()
    yield out.batch()
