"""Text corpora with sentinel lines, JSON-lines records, libsvm rows and their writers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.batches import small
from tessera.plans.shared import materialize

#: Lines that open a document, a record and its fields.
DOC, RECORD, SYSTEM, USER, ASSISTANT = "<<<doc>>>", "<<<record>>>", "<<<system>>>", "<<<user>>>", "<<<assistant>>>"


def _parts(spark: SparkSession, path: str, sentinel: str) -> DataFrame:
    """(path, pos, t): the lines after each line that is just the sentinel, by file; line ends are made plain and what comes before the first is left out.

    Files are read by lines in splits, so a task holds one part at a time, however large a file is. The first and last parts of a split go on in
    others; these few are put together again.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, held, out, size = None, 0, [], [], 0  # n: parts opened in this split, 0 for the rest of an earlier one

        def batch() -> pa.RecordBatch:
            paths, blocks, places, edges, texts = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(blocks, pa.int64()), pa.array(places, pa.int64()), pa.array(edges), pa.array(texts, pa.string())], names=["path", "block", "k", "edge", "t"])

        for b in small(batches):
            for where, line in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2).to_pylist(), strict=True):
                line = line[:-1] if line.endswith("\r") else line
                opens = line == sentinel
                if where != at or opens:
                    if at is not None:
                        out.append((*at, n, where != at or n == 0, "".join(held)))
                        size += len(out[-1][-1])
                    at, n, held = where, (n if where == at else 0) + opens, []
                if not opens:
                    held.append(line + "\n")
                if len(out) >= 500 or size >= 1 << 22:
                    yield batch()
                    out, size = [], 0
        if at is not None:
            out.append((*at, n, True, "".join(held)))
            yield batch()

    parts = lines.mapInArrow(run, "path string, block long, k long, edge boolean, t string")
    edges = materialize(parts.filter("edge"), "edges")  # two at most a split
    before = Window.partitionBy("path").orderBy("block")
    blocks = edges.groupBy("path", "block").agg(F.max("k").alias("n"))
    blocks = blocks.select("path", "block", (F.sum("n").over(before) - F.col("n")).alias("first"))
    upto = Window.partitionBy("path").orderBy("block", "k").rowsBetween(Window.unboundedPreceding, 0)
    opener = F.max(F.when(F.col("k") > 0, F.struct("block", "k"))).over(upto)
    pieces = F.array_sort(F.collect_list(F.struct("block", "k", "t")))
    grown = edges.withColumn("o", opener).filter("o IS NOT NULL").groupBy("path", "o").agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("t"))
    all_parts = parts.filter("NOT edge").select("path", "block", "k", "t").unionByName(grown.select("path", "o.block", "o.k", "t"))
    return all_parts.join(F.broadcast(blocks), ["path", "block"]).select("path", (F.col("first") + F.col("k") - 1).cast("int").alias("pos"), "t")  # one row a split


def _tail_trimmed(s: Column) -> Column:
    return F.regexp_replace(s, "[ \t\r\n]+$", "")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, text): documents of sentinel files; text before the first sentinel is a header, empty documents drop."""
    return _parts(spark, path, DOC).select("path", "pos", _tail_trimmed(F.col("t")).alias("text")).filter("text <> ''")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, system, user, assistant) of sentinel record files; those without a user or assistant text drop."""
    x = _parts(spark, path, RECORD).select("path", "pos", F.concat(F.lit("\n"), "t").alias("p"))

    def field(sentinel: str) -> Column:
        return _tail_trimmed(F.regexp_extract("p", rf"(?s)\n{sentinel}\n(.*?)(?=\n<<<(?:system|user|assistant)>>>\n|$)", 1))

    return x.select("path", "pos", field(SYSTEM).alias("system"), field(USER).alias("user"), field(ASSISTANT).alias("assistant")).filter("user <> '' AND assistant <> ''")


def write_documents(df: DataFrame, path: str, text: str = "text") -> None:
    """Sentinel files of a text column, one document after another."""
    df.select(F.concat(F.lit(DOC + "\n"), F.coalesce(text, F.lit(""))).alias("value")).write.text(path)


def write_records(df: DataFrame, path: str) -> None:
    """Sentinel record files of system, user and assistant columns."""
    parts = [F.lit(RECORD)] + [x for tag, c in ((SYSTEM, "system"), (USER, "user"), (ASSISTANT, "assistant")) for x in (F.lit(tag), F.coalesce(c, F.lit("")))]
    df.select(F.concat_ws("\n", *parts).alias("value")).write.text(path)


def messages(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): the first assistant message of JSON lines with messages[]; none or empty gives null."""
    schema = "messages array<struct<role: string, content: string>>"
    first = F.filter("messages", lambda m: m["role"] == "assistant")
    return spark.read.schema(schema).json(path).select(F.nullif(F.try_element_at(first, F.lit(1))["content"], F.lit("")).alias("text"))


def libsvm(spark: SparkSession, path: str) -> DataFrame:
    """(label, features map<int, double>) of 'label index:value ...' lines, indices as written; comments after # drop. A malformed line fails."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    parts = F.split(line, r"\s+")
    pairs = F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("k"), F.split(p, ":")[1].cast("double").alias("v")))
    return spark.read.text(path).filter(line != "").select(F.element_at(parts, 1).cast("double").alias("label"), F.map_from_entries(pairs).alias("features"))


def from_zero(df: DataFrame, features: str = "features") -> DataFrame:
    """Sparse vectors with their smallest index moved to 0 if all start above it."""
    low = df.agg(F.min(F.array_min(F.map_keys(features))).alias("_low"))
    return df.crossJoin(F.broadcast(low)).withColumn(features, F.transform_keys(features, lambda k, v: k - F.greatest(F.coalesce("_low", F.lit(0)), F.lit(0)))).drop("_low")  # one row


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    """'label index:value ...' lines in index order."""
    pairs = F.transform(F.array_sort(F.map_entries(features)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(pairs, " ")).alias("value")).write.text(path)
