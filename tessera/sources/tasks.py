"""Grid tasks in JSON files: {"train": [{"input": [[...]], "output": [[...]]}], "test": [...]}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PAIR = "array<struct<input: array<array<int>>, output: array<array<int>>>>"
#: Colours are 0 to 9; these ids mark a row's end, an input's and an output's start, and the end.
ROW_END, INPUT, OUTPUT, END = 10, 11, 12, 13


def grid_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(task, split, pos, input, output) of every pair of every file."""
    raw = spark.read.schema(f"train {_PAIR}, test {_PAIR}").option("multiLine", True).json(path)
    named = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("task"), "train", "test")
    both = F.concat(F.transform("train", lambda p, i: F.struct(F.lit("train").alias("split"), i.alias("pos"), p.alias("p"))), F.transform("test", lambda p, i: F.struct(F.lit("test").alias("split"), i.alias("pos"), p.alias("p"))))
    return named.select("task", F.explode(both).alias("e")).select("task", "e.split", "e.pos", F.col("e.p.input").alias("input"), F.col("e.p.output").alias("output"))


def grid_tokens(grid: Column) -> Column:
    """A grid's cells row by row, each row closed."""
    return F.flatten(F.transform(grid, lambda r: F.concat(r, F.array(F.lit(ROW_END)))))


def task_context(pairs: DataFrame) -> DataFrame:
    """(task, tokens): the training pairs of each task in order, each as input and output."""
    t = F.concat(F.array(F.lit(INPUT)), grid_tokens(F.col("input")), F.array(F.lit(OUTPUT)), grid_tokens(F.col("output")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", t.alias("t"))))
    return pairs.filter("split = 'train'").groupBy("task").agg(F.concat(F.flatten(F.transform(ordered, lambda s: s["t"])), F.array(F.lit(END))).alias("tokens"))
