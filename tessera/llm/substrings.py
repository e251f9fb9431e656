"""Substring de-duplication by seed and extend.

Seeds: winnowing picks one anchor (a run of length // 2 + 1 words with the least
hash) in every window of `length` words, so equal windows pick equal anchors at
equal places. A run of windows with one anchor and the words that they cover are a
context, hashed whole. Documents meet on anchors. Where whole contexts agree, the
match extends over all of the context at once, and every document but the smallest
in the class drops it; only the smallest of each class, and only where an anchor has
several classes, extends window by window against the others. Each step groups and
counts, so a passage that a third of all documents share costs one row a document,
never a pair. Covered words are then joined into maximal spans.

A word sequence is compared by its 64-bit hash.

Edge cases: words are runs of non-space code points, unchanged; null and short
texts have no window; rows with a null doc_id are left whole and take nothing from
others; rows that repeat a doc_id are judged by it, none against its like; an empty
table gives no row; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import small
from tessera.plans.bits import failing, passing
from tessera.plans.shared import discard, materialize

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SEGMENT, PLACE = 1 << 22, (1 << 24) - 1
CACHE_ENTRIES = 300_000


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Words:
    """Word hashes with range hashes in constant time."""

    _up = np.ones(1, dtype=np.uint64)
    _down = np.ones(1, dtype=np.uint64)

    def __init__(self, words: list[bytes], cache: dict[bytes, int]):
        n = len(words)
        h = np.empty(n, dtype=np.uint64)
        for i, w in enumerate(words):
            x = cache.get(w)
            if x is None:
                x = xxhash.xxh3_64_intdigest(w)
                if len(cache) < CACHE_ENTRIES and len(w) <= 64:
                    cache[w] = x
            h[i] = x
        if len(Words._up) <= n:
            Words._up, Words._down = _powers(BASE, max(2 * n, 4096)), _powers(BASE_INVERSE, max(2 * n, 4096))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * Words._up[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of words[start : start + length]."""
        x = (self.sums[start + length] - self.sums[start]) * Words._down[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width keys, by doubling."""
    out, span = keys, 1
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    return np.minimum(out[: len(keys) - width + 1], out[width - span : len(keys) - span + 1])


def anchors(w: Words, n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, context hash, first window, windows) of every run of windows with one anchor."""
    k = length // 2 + 1
    width = length - k + 1
    found = []
    for low in range(0, n - length + 1, SEGMENT):
        high = min(low + SEGMENT, n - length + 1)
        grams = w.ranges(np.arange(low, high + width - 1), k)
        keys = (grams & ~np.uint64(PLACE)) | np.arange(len(grams), dtype=np.uint64)
        at = (least(keys, width) & np.uint64(PLACE)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        many = np.diff(np.concatenate([first, [len(at)]]))
        place = at[first]
        context = w.ranges(low + first, many + length - 1) ^ ((place - first).astype(np.uint64) * np.uint64(BASE))
        found.append((grams[place], context, low + first, many))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in small(batches):
            made, held = [], 0
            for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                ws = text.split() if text else []
                if len(ws) < length:
                    continue
                a, c, first, many = anchors(Words(ws, cache), len(ws), length)
                made.append((a, c, np.full(len(a), doc), np.full(len(a), key), first, many))
                held += len(a)
                if held > 200_000:
                    yield _anchor_batch(made)
                    made, held = [], 0
            if made:
                yield _anchor_batch(made)

    return docs.mapInArrow(run, "ah long, ch long, doc_id long, key long, start int, n int")


def _anchor_batch(made: list) -> pa.RecordBatch:
    a, c, doc, key, first, many = (np.concatenate(x) for x in zip(*made, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(key), pa.array(first.astype(np.int32)), pa.array(many.astype(np.int32))], names=["ah", "ch", "doc_id", "key", "start", "n"])


def _window_rows(heads: DataFrame, length: int) -> DataFrame:
    """(wh, doc_id, key, start) of every window of the listed runs. heads: doc_id, key, text, runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in small(batches):
            for doc, key, text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                w = Words(text.split(), cache)
                starts = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in runs]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.ranges(starts, length).view(np.int64)), pa.array(np.full(len(starts), doc)), pa.array(np.full(len(starts), key)), pa.array(starts.astype(np.int32))], names=["wh", "doc_id", "key", "start"]
                )

    return heads.mapInArrow(_coalesced(run), "wh long, doc_id long, key long, start int")


def _coalesced(run, rows: int = 100_000):
    """run with its many small batches put together."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += len(b)
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return whole


def repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, key, spans): covered stretches of words, start to end, not yet merged, of documents that have any.

    docs holds doc_id, key (a hash of the text) and text.
    """
    found = materialize(_anchor_rows(docs.filter("doc_id IS NOT NULL").select("doc_id", "key", "text"), length), "anchors")
    classes = found.groupBy("ah", "ch").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    classes = materialize(classes, "contexts")
    # an anchor with several contexts in more than one document; its contexts' first documents extend window by window
    several = classes.groupBy("ah").agg(F.count("*").alias("k"), F.min("first_id").alias("a"), F.max("last_id").alias("z")).filter("k > 1 AND a < z").select("ah", F.lit(True).alias("several"))
    told = classes.join(several, "ah", "left").filter("several OR first_id < last_id").select("ah", "ch", "first_id", F.coalesce("several", F.lit(False)).alias("several"))
    rows = found.join(told, ["ah", "ch"])
    rows = materialize(rows.filter("doc_id > first_id OR several").select("doc_id", "key", "start", "n", (F.col("doc_id") > F.col("first_id")).alias("later")), "matches")
    discard(found, classes)

    heads = materialize(rows.filter("NOT later").groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "heads")
    texts = passing(docs, heads, "doc_id", "key").join(heads, ["doc_id", "key"])
    windows = materialize(_window_rows(texts.select("doc_id", "key", "text", "runs"), length), "windows")
    discard(heads)
    firsts = windows.groupBy("wh").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").select("wh", "first_id")
    firsts = materialize(firsts, "firsts")  # a written side lets AQE split a hot window of the other
    single = windows.join(firsts, "wh").filter("doc_id > first_id").select("doc_id", "key", "start", F.lit(1).alias("n"))
    covered = rows.filter("later").select("doc_id", "key", "start", "n").unionByName(single)
    spans = covered.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + (length - 1)).alias("end"))).alias("spans"))
    spans = materialize(spans, "spans")
    discard(rows, windows, firsts)
    return spans


def maximal(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The stretches merged into maximal ones."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed and text, the words that stay, joined by one space."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    spans = repeats(keyed, length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            n, gone, kept = [], [], []
            for text, found in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                ws = text.split() if text else []
                left, at = [], 0
                for s, e in maximal(found):
                    left += ws[at:s]
                    at = e
                left += ws[at:]
                n.append(len(ws))
                gone.append(len(ws) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    some = passing(keyed, spans, "doc_id", "key").join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    none = failing(keyed, spans, "doc_id", "key").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    joined = some.unionByName(none)  # texts without a repeat are not exchanged
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without passages of 50 words that a smaller doc_id has."""
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS k FROM s),
m AS (SELECT k, min(doc_id) AS first_id FROM h GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN m USING (k) WHERE doc_id > first_id),
g AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id),
x AS (SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN g USING (doc_id)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.p = r.p WHERE r.p IS NULL GROUP BY 1)
SELECT x.doc_id, len(w)::BIGINT AS n_words, len(ps)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM x LEFT JOIN k USING (doc_id)"""
