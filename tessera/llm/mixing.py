"""Weighted fair queueing of sources to target weights.

Each source's documents are shuffled by a keyed hash; a document's virtual finish
time is its source's running word count, repeats included, over the source's
target. Documents of all sources are range-sorted by that time and the order is
cut at the total budget. Running sums are taken per range partition and shifted
by the sums of the partitions before, so a source that holds most rows is spread
over many tasks. Sources may be many: their sizes, places and targets stay distributed
too; the driver sees one row a partition.

Edge cases: null text has size 0; a null source is a source of its own, last in
order; null doc_ids hash as the word null; repeated rows are separate documents;
an empty table gives no row; a source without words has target 0 and is not
taken; extra columns are carried as they are when asked for.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import text as words
from tessera.llm.batches import small
from tessera.plans.prefix import numbered, running
from tessera.plans.shared import materialize

_SIZE, _KEY, _PART, _CUM, _SOURCE = "_mix_size", "_mix_key", "_mix_part", "_mix_cum", "_mix_source"


def _goals(parts: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """A row a source: its place (code points, null last), size and target by water-filling.

    share times all sizes is dealt by weight, none above most times its size. Sources stop at their caps in the order of
    cap over weight; the first whose part of the rest is within its cap sets the level (words a weight) for all after it.
    Sources may be many: places and running sums come from distributed ranges; only totals and the level reach the driver.
    """
    sizes = numbered(parts.groupBy(_SOURCE).agg(F.sum("n").alias("source_size")), [F.col(_SOURCE).asc_nulls_last()], "_mix_rank").withColumn("_mix_rank", F.col("_mix_rank") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_mix_rank") % len(weights) + 1).cast("int"))
    sizes = materialize(sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))), "sources")
    used = sizes.filter("source_size > 0")
    total = used.agg(F.sum("source_size").alias("n"), F.sum("_w").alias("w")).first()
    if total.n is None:
        return sizes.select(_SOURCE, "_mix_rank", "source_size", F.lit(0.0).alias("target"))
    order = [F.asc("_ratio"), F.asc("_mix_rank")]
    queue = running(used.select("_mix_rank", "_w", "_cap", (F.col("_cap") / F.col("_w")).alias("_ratio")), order, {"_caps": F.col("_cap"), "_ws": F.col("_w")})
    rest = (F.lit(float(share * total.n)) - (F.col("_caps") - F.col("_cap"))) / (F.lit(float(total.w)) - (F.col("_ws") - F.col("_w")))
    level = queue.withColumn("_rest", rest).filter(F.col("_rest") * F.col("_w") <= F.col("_cap")).agg(F.min(F.struct("_ratio", "_mix_rank", "_rest")).alias("x")).first().x
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.lit(level["_rest"]) * F.col("_w"))
    return sizes.select(_SOURCE, "_mix_rank", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def _sized(docs: DataFrame, text: str) -> DataFrame:
    """docs with the number of words of a text column in place of it (kept if carried)."""
    schema = T.StructType([*docs.schema.fields, T.StructField(_SIZE, T.LongType())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            n = pa.array([words.n_words(x) for x in words.utf8(b.column(text))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], names=[*b.schema.names, _SIZE])

    return docs.mapInArrow(count, schema)


def _running(df: DataFrame, group: str | None) -> DataFrame:
    """df, already sorted in its partitions, with its partition's number and the running sum of sizes (by group, whose rows are together)."""
    schema = T.StructType([*df.schema.fields, T.StructField(_PART, T.LongType()), T.StructField(_CUM, T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, last = TaskContext.get().partitionId(), 0, object()
        for b in batches:
            sizes = b.column(_SIZE)
            if group is None:
                cum = pc.add(pc.cumulative_sum(sizes), total)
                total = cum[-1].as_py() if len(cum) else total
            else:
                out = []
                for key, rows in itertools.groupby(zip(b.column(group).to_pylist(), sizes.to_pylist(), strict=True), key=lambda x: x[0]):
                    total = total if key == last else 0
                    last = key
                    for _, n in rows:
                        total += n
                        out.append(total)
                cum = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int64()), cum], names=[*b.schema.names, _PART, _CUM])

    return df.mapInArrow(run, schema)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2, seed: str = "mix", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row a document: its carried columns and size, source_size, target, taken (words), copies, finish (of its first copy).

    docs holds doc_id, source and text. Sources in code point order, null last, take the weights in turn.
    """
    spark = docs.sparkSession
    kept = list(dict.fromkeys(["doc_id", *carry, "text"]))
    sized = _sized(docs.select(*kept, F.col("source").alias(_SOURCE)), "text")
    if "text" not in carry:
        sized = sized.drop("text")
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10)
    keys = [F.col(_SOURCE).asc_nulls_last(), _KEY, "doc_id", _SIZE]
    ranged = sized.withColumn(_KEY, number.cast("long")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialize(_running(ranged, _SOURCE), "mix")

    parts = materialize(rows.groupBy(_PART, _SOURCE).agg(F.max(_CUM).alias("n")), "parts")  # one row a partition and source
    goals = _goals(parts, weights, share, max_repeats)
    before = Window.partitionBy(_SOURCE).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    about = parts.withColumn("_mix_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumnsRenamed({_PART: "_mix_p", _SOURCE: "_mix_s"})
    about = about.join(goals, F.col("_mix_s").eqNullSafe(F.col(_SOURCE))).select("_mix_p", "_mix_s", "_mix_rank", "_mix_before", "source_size", "target")
    about = materialize(about, "about")  # a written side lets AQE split a hot partition of the other
    placed = rows.join(about, (rows[_PART] == about["_mix_p"]) & rows[_SOURCE].eqNullSafe(about["_mix_s"])).drop("_mix_p", "_mix_s")
    total = goals.agg(F.sum("source_size")).first()[0] or 0

    def finish(copy) -> F.Column:
        return F.when(F.col("target") > 0, (copy * F.col("source_size") + F.col("_mix_before") + F.col(_CUM)) / F.col("target"))

    queue = placed.select(_SIZE, "_mix_rank", F.explode(F.array(*[finish(F.lit(e)) for e in range(max_repeats)])).alias("_mix_finish")).filter(f"_mix_finish IS NOT NULL AND {_SIZE} > 0")
    cut = _cut(queue, share * total)
    within = [(finish(F.lit(e)) < F.lit(cut[0])) | ((finish(F.lit(e)) == F.lit(cut[0])) & (F.col("_mix_rank") <= F.lit(cut[1]))) for e in range(max_repeats)]
    copies = sum((F.when(w & (F.col(_SIZE) > 0), 1).otherwise(0) for w in within[1:]), F.when(within[0] & (F.col(_SIZE) > 0), 1).otherwise(0))
    return placed.select(
        *carry, F.col(_SIZE).alias("size"), "source_size", "target", (copies * F.col(_SIZE)).cast("long").alias("taken"), copies.cast("int").alias("copies"), finish(F.lit(0)).alias("finish")
    )


def _cut(queue: DataFrame, budget: float) -> tuple[float, int]:
    """(finish, rank) of the last row that the budget holds in the global order; a pair is unique, as sizes are above 0."""
    keys = ["_mix_finish", "_mix_rank"]
    ordered = materialize(_running(queue.repartitionByRange(*keys).sortWithinPartitions(*keys), None), "queue")
    last = (-1.0, -1)
    for p in sorted(ordered.groupBy(_PART).agg(F.max(_CUM).alias("n"), F.max(F.struct(*keys)).alias("k")).collect(), key=lambda p: p[_PART]):
        if p.n <= budget:
            budget, last = budget - p.n, tuple(p.k)
            continue
        row = ordered.filter((F.col(_PART) == p[_PART]) & (F.col(_CUM) <= F.lit(budget))).agg(F.max(F.struct(*keys)).alias("k")).first()
        return tuple(row.k) if row.k else last
    return last


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """docs as the mix takes them: a row for each copy taken, with the columns of docs."""
    names = docs.columns
    inner = docs.toDF(*[c if c in ("doc_id", "source", "text") else f"_in_{i}" for i, c in enumerate(names)])
    taken = mix(inner, weights, share, max_repeats, carry=inner.columns).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return taken.select(*[F.col(a).alias(b) for a, b in zip(inner.columns, names, strict=True)])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to weights 5, 2, 1 at 150 % of their words."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER o, 0) AS rest, (SELECT sum(weight) FROM w WHERE source_size > 0) - coalesce(sum(weight) OVER o, 0) AS wsum
  FROM w WHERE source_size > 0 WINDOW o AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT min_by(rest / wsum, cap / weight) AS level FROM r WHERE rest / wsum * weight <= cap),
t AS (SELECT source, rk, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE coalesce(least(cap, level * weight), cap) END::DOUBLE AS target FROM w, lv),
c AS (SELECT d.*, t.rk, t.source_size, t.target, sum(size) OVER (PARTITION BY t.rk ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT doc_id, rk, size, e, (e * source_size + cum)::DOUBLE / target AS finish FROM c, (VALUES (0), (1)) x(e) WHERE size > 0 AND target > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, rk ROWS UNBOUNDED PRECEDING) AS total FROM q),
n AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM g WHERE total <= 1.5::DOUBLE * (SELECT sum(source_size) FROM s) GROUP BY doc_id)
SELECT c.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN n USING (doc_id)"""
