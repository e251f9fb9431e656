"""Shaping of training sets: order, noise, reports, pretrained tokenizers and suffix trends."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import table


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """df in the order of a seeded hash of its key: every reader with the seed sees the same order."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def augmented(df: DataFrame, key: str, seq: str, ratio: float, unknown: int, pad: int = 0, seed: int = 0, most_noise: float = 0.3) -> DataFrame:
    """df and noisy copies of a share `ratio` of its rows (0 to 2), picked by hash; a copy has 1 to most_noise of its tokens replaced.

    Rows of padding only give no copy. The column _copy is 0 for originals, else the number of the copy.
    """
    if not 0 <= ratio <= 2:
        raise ValueError("the ratio lies between 0 and 2")

    def unit(*parts) -> Column:
        return (F.xxhash64(F.lit(seed), *parts).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)

    whole = int(ratio)
    copies = F.lit(whole) + F.when(unit(key, F.lit("copy")) < ratio - whole, 1).otherwise(0)
    real = F.filter(seq, lambda t: t != pad)
    made = df.filter(F.size(real) > 0).withColumn("_copy", F.explode(F.filter(F.sequence(F.lit(0), copies), lambda i: i > 0)))
    n = F.size(F.filter(seq, lambda t: t != pad))
    share = F.greatest(F.lit(1), F.floor(n * most_noise)) / n

    def noise(t: Column, i: Column) -> Column:
        return F.when((t != pad) & (unit(key, F.col("_copy"), i) < share), F.lit(unknown)).otherwise(t)

    return df.withColumn("_copy", F.lit(0)).unionByName(made.withColumn(seq, F.transform(seq, noise)))


def report(windows: DataFrame, labels: str, ignore: int = -100) -> DataFrame:
    """Windows, and supervised and ignored positions of a label column."""
    used = F.size(F.filter(labels, lambda t: t != ignore))
    return windows.agg(F.count("*").alias("windows"), F.coalesce(F.sum(used), F.lit(0)).alias("supervised"), F.coalesce(F.sum(F.size(labels) - used), F.lit(0)).alias("ignored"))


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = None, rows: int = 500) -> DataFrame:
    """(key, ids) under a pretrained tokenizer file, an end id after each; empty documents drop."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            for s in range(0, len(b), rows):
                part = b.slice(s, rows)
                pairs = [(k, x) for k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if x]
                found = t.encode_batch([x for _, x in pairs], add_special_tokens=False)
                ids = [e.ids + ([end] if end is not None else []) for e in found]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], b.schema.field(0).type), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def steps_without(values: np.ndarray, chance: float = 0.51, falling: bool = True, discard: float | None = None) -> int:
    """Length of the longest suffix whose least-squares slope falls (or rises) with less than the given chance.

    With a share to discard, values above that at place round((n - 1)(1 - discard)) in ascending order don't count for
    the slope, though they lengthen the suffix.
    """
    y = np.asarray(values, dtype=float)[::-1]
    size, kept = len(y), np.arange(len(y))
    if discard is not None and size:
        edge = np.sort(y)[math.floor((size - 1) * (1 - discard) + 0.5)]
        kept = np.flatnonzero(y <= edge)
        y = y[kept]
    best = 0
    n = np.arange(1, len(y) + 1)
    # suffix of m values: place t counted from its start, so the reversed index runs down
    k = np.arange(len(y))
    sy, sky, syy = np.cumsum(y), np.cumsum(k * y), np.cumsum(y * y)
    for m in n[2:]:
        i = m - 1
        sxy = (i * sy[i] - sky[i]) - (m - 1) / 2 * sy[i]
        sxx = (m**3 - m) / 12
        slope = sxy / sxx
        rss = max(syy[i] - sy[i] ** 2 / m - slope * sxy, 0.0)
        err = math.sqrt(rss / (m - 2) / sxx)
        below = (1.0 if slope < 0 else 0.5 if slope == 0 else 0.0) if err == 0 else 0.5 * (1 + math.erf(-slope / err / math.sqrt(2)))
        if (below if falling else 1 - below) < chance:
            best = int(m)
    return best if best == 0 else int(kept[best]) if best < len(kept) else size


def steadiness(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """(by, no_fall, no_rise, no_fall_robust): how far back each series shows no fall and no rise, and no fall without its largest tenth. Series are ordered in their group."""
    kinds = dict(df.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        v = f.sort_values(order)[value].to_numpy()
        return pd.DataFrame({by: [f[by].iloc[0]], "no_fall": [steps_without(v)], "no_rise": [steps_without(v, falling=False)], "no_fall_robust": [steps_without(v, discard=0.1)]})

    return df.select(by, *order, value).groupBy(by).applyInPandas(run, f"`{by}` {kinds[by]}, no_fall long, no_rise long, no_fall_robust long")


def _ids(s, d):
    from tessera.operators.sequences import ids

    return table(s, d, "benchmark").select("item_id", ids(F.col("text")).alias("seq"))


def _windows(s, d):
    from tessera.operators.sequences import causal_windows, ids

    return causal_windows(table(s, d, "documents"), "doc_id", ids(F.col("text")), 64, 64)


QUERIES = {
    "augmented_rows": lambda s, d: augmented(_ids(s, d), "item_id", "seq", 0.5, 1).groupBy("_copy").agg(F.count("*").alias("n")),
    "dataset_report": lambda s, d: report(_windows(s, d), "labels"),
    "steadiness": lambda s, d: steadiness(table(s, d, "events"), "user_id", ["ts", "event_id"], "value"),
}
ORACLES = {
    "dataset_report": """WITH d AS (SELECT len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> '')) AS n FROM documents),
w AS (SELECT n, unnest(range(0, ceil(greatest(n - 64, 0) / 64)::BIGINT + 1)) * 64 AS b FROM d WHERE n >= 2), x AS (SELECT least(64, n - 1 - b) AS u FROM w WHERE b + 1 < n)
SELECT count(*) AS windows, sum(u)::BIGINT AS supervised, sum(64 - u)::BIGINT AS ignored FROM x"""
}
