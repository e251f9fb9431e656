"""Chosen-path similarity join on word shingles.

Documents with equal shingle sets form a class. A class is a fixed-size set of
tokens (i, value of its i-th minimum hash), 64 of them. In every run a node samples
one or two token positions, 1 / threshold on average, by a hash of its path; a
class follows each sampled token to a child node, so a pair above the threshold
stays together with a chance that falls slowly with depth. Nodes with one class
end; small ones are compared by brute force; a node that keeps most of its parent
is dense (its classes are alike) and is compared too, however large, in block
pairs; all others split again. Runs repeat until a pair at the threshold is found
with the target recall; a single run finds it with a known chance, computed below for
the depth that nodes reach: runs are added when they split more often than planned.
Rows and sketches pass a bit filter before they are exchanged, so a depth moves what
its nodes need, not every sketch again.

Brute force on tokens joins classes into clusters with a margin that a true pair
passes; within clusters (again in block pairs) exact shingle sets decide every
pair once, so no link is false and a pair that a run missed is mostly found too.
Work in a group of near copies with different texts is quadratic in their number,
as their links are; equal sets cost nothing.

Edge cases: words are runs of non-space code points, unchanged; a text of one to
four words has one shingle, all of it; null and empty texts have none and link
with nothing; every row is a document of its own, repeated ids and rows included;
null doc_ids take part and never name a class unless alone; an empty table gives
no row; extra columns are carried only for the deduplicated form.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import blocks
from tessera.llm.batches import small
from tessera.llm.embeddings import label
from tessera.operators.components import components
from tessera.plans.bits import passing
from tessera.plans.shared import discard, materialize

TOKENS, LEAF, BLOCK, SET_BLOCK, MAX_DEPTH, DENSE = 64, 128, 512, 192, 12, 0.8
#: Standard deviations below the threshold at which token agreement still joins a cluster.
MARGIN = 4.5
_RID, _CID, _SKETCH = "_cps_rid", "cid", "_cps_sketch"
_U64 = (1 << 64) - 1
_MULT = np.random.default_rng(5).integers(1, 1 << 63, size=(2, TOKENS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, n: int = 5, cache: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words (fewer words: of all of them)."""
    ws = text.split() if text else []
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    cache = {} if cache is None else cache
    h = np.empty(len(ws), dtype=np.uint64)
    for i, w in enumerate(ws):
        x = cache.get(w)
        if x is None:
            x = xxhash.xxh3_64_intdigest(w)
            if len(cache) < 300_000 and len(w) <= 64:
                cache[w] = x
        h[i] = x
    k = min(n, len(h))
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        out ^= out >> np.uint64(29)
    if k < n:
        out += np.uint64(k)
    return np.unique(out)


def sketch(s: np.ndarray) -> bytes:
    """Minimum of each hash function over a set, 32 bits each."""
    low = np.full(TOKENS, _U64, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        x = s[at : at + 4096, None] * _MULT[0] + _MULT[1]
        low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(0))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def runs_for(threshold: float, recall: float, depth: int = 6) -> int:
    """Runs that find a pair at the threshold with the recall asked for, if its nodes split depth times."""
    one, two = 2 - 1 / threshold, 1 / threshold - 1
    q = 1.0
    for _ in range(depth):
        q = one * threshold * q + two * (1 - (1 - threshold * q) ** 2)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - q)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def children(node: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for every token that its node samples: a second one with a chance that makes 1 / threshold on average."""
    h = _mix(node)
    first = (h % np.uint64(TOKENS)).astype(np.int64)
    step = (h >> np.uint64(8)) % np.uint64(TOKENS - 1)
    second = (first + 1 + step.astype(np.int64)) % TOKENS
    more = (h >> np.uint64(24)) / 2.0**40 < 1 / threshold - 1
    rows, at = np.arange(len(node)), np.concatenate([first, second[more]])
    rows = np.concatenate([rows, rows[more]])
    child = _mix(node[rows] * np.uint64(3) + at.astype(np.uint64) + (tokens[rows, at].astype(np.uint64) << np.uint64(32)))
    return rows, child


def _read(docs: DataFrame) -> DataFrame:
    """docs and a row number, class and sketch of each (null where there is no word)."""
    schema = T.StructType([*docs.schema.fields, T.StructField(_RID, T.LongType()), T.StructField(_CID, T.LongType()), T.StructField(_SKETCH, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, cache = TaskContext.get().partitionId() << 40, {}
        for b in small(batches):
            sets = [shingle_set(t, cache=cache) for t in b.column("text").cast(pa.binary()).to_pylist()]
            cid = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            made = [pa.array(np.arange(rid, rid + len(b))), pa.array(cid, pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())]
            rid += len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, _RID, _CID, _SKETCH])

    return docs.mapInArrow(run, schema)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, TOKENS)


def _split(rows: DataFrame, threshold: float, runs: range | None) -> DataFrame:
    """(node, cid, parent_n) of the children. rows: cid, sketch and, below the roots, node and _c."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            cid, tokens = b.column("cid").to_numpy(), _tokens(b.column(_SKETCH))
            if runs is None:
                nodes, parents = [b.column("node").to_numpy().view(np.uint64)], b.column("_c").to_numpy()
            else:
                nodes, parents = [np.full(len(b), r + 1, dtype=np.uint64) for r in runs], np.full(len(b), 1 << 62)
            for node in nodes:
                at, child = children(node, tokens, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(cid[at]), pa.array(parents[at])], names=["node", "cid", "parent_n"])

    return rows.mapInArrow(run, "node long, cid long, parent_n long")


def _of(rows: DataFrame, size: DataFrame) -> DataFrame:
    """(node, cid, _c) of the nodes in size; rows of most others stay where they lie."""
    return passing(rows.select("node", "cid"), size, "node").join(size.select("node", "_c"), "node")


def _sketched(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (a written table, as it is read twice) and their classes' sketches; sketches of most other classes stay where they lie."""
    return rows.join(passing(classes.select("cid", _SKETCH), rows, "cid"), "cid")


def _leaves(classes: DataFrame, threshold: float, runs: range) -> tuple[list[DataFrame], int]:
    """(node, cid, _c) of all nodes to compare, a written table a depth: small, dense or at the last depth; and how often the deepest split."""
    out: list[DataFrame] = []
    rows = _split(classes.select("cid", _SKETCH), threshold, runs)
    last: list[DataFrame] = []
    for depth in range(MAX_DEPTH):
        rows = materialize(rows, "nodes")
        size = rows.groupBy("node").agg(F.count("*").alias("_c"), F.first("parent_n").alias("parent_n")).filter("_c > 1")
        dense = F.lit(depth == MAX_DEPTH - 1) | (F.col("_c") >= DENSE * F.col("parent_n"))
        size = materialize(size.withColumn("leaf", (F.col("_c") <= LEAF) | dense), "sizes")
        discard(*last)  # the depth above, now that its children are written
        last = [rows, size]
        out.append(materialize(_of(rows, size.filter("leaf")), "leaves"))
        if size.filter("NOT leaf").isEmpty():
            break
        big = materialize(_of(rows, size.filter("NOT leaf")), "big")
        last.append(big)
        rows = _split(_sketched(big, classes), threshold, None)
    discard(*last)
    return out, depth + 1


def _all_leaves(classes: DataFrame, threshold: float, recall: float) -> list[DataFrame]:
    """Nodes to compare of as many runs as the recall takes at the depth that nodes really reach."""
    done, runs = 0, runs_for(threshold, recall)
    out: list[DataFrame] = []
    while done < runs:
        part, depth = _leaves(classes, threshold, range(done, runs))
        out += part
        done, runs = runs, max(runs, runs_for(threshold, recall, depth))
    return out


def _candidates(dealt: DataFrame, least: int) -> DataFrame:
    """Forest edges over classes whose tokens agree at least so often."""

    def kernel(t: pa.Table):
        ids, tokens = t["cid"].to_numpy(), _tokens(t[_SKETCH])
        agree = np.zeros((len(ids), len(ids)), dtype=np.uint8)
        for k in range(TOKENS):
            agree += tokens[:, k, None] == tokens[None, :, k]
        linked = (agree >= least) & blocks.pair_mask(t["_block"].to_numpy(), t["_i"][0].as_py() == t["_j"][0].as_py())
        return ids, np.zeros(len(ids), dtype=np.int64), blocks.forest(ids, linked)

    return dealt.mapInArrow(lambda batches: blocks.stream(batches, ["node", "_i", "_j"], kernel), blocks.FOUND)


def jaccard_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets are at the threshold or above, exactly."""
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        inter = np.array([[n[0], both], [both, n[1]]])
    else:
        owner = np.repeat(np.arange(len(sets)), n)
        values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        inter = np.zeros((len(sets), len(sets)), dtype=np.float32)
        shared = times > 1
        number = np.cumsum(shared) - 1
        on = shared[at]
        owner, at = owner[on], number[at[on]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        for low in range(0, int(shared.sum()), 8192):
            s, e = np.searchsorted(at, [low, low + 8192])
            grid = np.zeros((len(sets), 8192), dtype=np.float32)
            grid[owner[s:e], at[s:e] - low] = 1
            inter += grid @ grid.T
    inter = np.rint(inter).astype(np.int64)
    union = n[:, None] + n[None, :] - inter
    return inter >= np.ceil(threshold * union - 1e-9)


def _exact(dealt: DataFrame, threshold: float) -> DataFrame:
    def kernel(t: pa.Table):
        ids, m = t["cid"].to_numpy(), t["m"].to_numpy()
        linked = jaccard_links([np.frombuffer(x, dtype=np.uint64) for x in t["set"].to_pylist()], threshold)
        linked &= blocks.pair_mask(t["_block"].to_numpy(), t["_i"][0].as_py() == t["_j"][0].as_py())
        return ids, linked @ m, blocks.forest(ids, linked)

    return dealt.mapInArrow(lambda batches: blocks.stream(batches, ["root", "_i", "_j"], kernel), blocks.FOUND)


def _sets(rows: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in small(batches):
            sets = pa.array([shingle_set(t, cache=cache).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("_c"), b.column("cid"), b.column("m"), sets], names=["root", "_c", "cid", "m", "set"])

    return rows.mapInArrow(run, "root long, _c long, cid long, m long, set binary")


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, carry: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, the carried columns, n_links, class_id (smallest doc_id reachable) and keep (one true a class)."""
    carry = ["doc_id"] if carry is None else carry
    rows = materialize(_read(docs.select(*[f"`{c}`" for c in dict.fromkeys([*carry, "doc_id", "text"])])), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", _RID)
    classes = rows.filter("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("m"), F.min("doc_id").alias("least"), F.min(order).alias("head"), F.first(_SKETCH).alias(_SKETCH))
    classes = materialize(classes, "classes")

    leaves = _all_leaves(classes, threshold, recall)
    met = _sketched(functools.reduce(DataFrame.unionByName, leaves), classes)
    least = int(np.floor(TOKENS * threshold - MARGIN * np.sqrt(TOKENS * threshold * (1 - threshold))))
    edges = materialize(_candidates(blocks.deal(met, "node", "cid", "_c", BLOCK), least), "candidates")
    discard(*leaves)
    clusters = components(edges.select("id", "other"))
    clusters = materialize(clusters, "clusters")
    sizes = materialize(clusters.groupBy("root").agg(F.count("*").alias("_c")), "sizes")
    members = clusters.join(sizes, "root").withColumnRenamed("node", "cid").join(classes.select("cid", "m", F.col(f"head.{_RID}").alias(_RID)), "cid")
    members = materialize(members, "members")
    sets = materialize(_sets(passing(rows.select(_RID, "text"), members, _RID).join(members.hint("merge"), _RID)), "sets")
    found = materialize(_exact(blocks.deal(sets, "root", "cid", "_c", SET_BLOCK), threshold), "links")
    discard(edges, clusters, sizes, members, sets)
    links = found.filter("other IS NULL").groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other IS NOT NULL"))

    heads = classes.select("cid", "head").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    firsts = heads.groupBy("root").agg(F.min("head").alias("head")).select(F.col(f"head.{_RID}").alias("_cps_first"))
    slim = rows.drop(_SKETCH) if "text" in carry else rows.drop(_SKETCH, "text")
    done = label(slim, classes, links, roots, "doc_id").withColumnRenamed("component_id", "class_id")
    done = done.join(firsts, done[_RID] == firsts["_cps_first"], "left")
    keep = F.col("cid").isNull() | F.col("_cps_first").isNotNull()
    return done.select(*[f"`{c}`" for c in carry], "n_links", "class_id", keep.alias("keep"))


def deduplicate(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each class: that with the smallest doc_id; documents without words stay."""
    names = docs.columns
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"_in_{i}" for i, c in enumerate(names)])
    kept = join(inner, threshold, carry=inner.columns).filter("keep")
    return kept.select(*[F.col(a).alias(b) for a, b in zip(inner.columns, names, strict=True)])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents at Jaccard 0.8 on five-word shingles."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
