"""Small helpers over spark.sql: parameter markers and single values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def statement(spark: SparkSession, query: str, **args) -> DataFrame:
    """A query with named parameter markers."""
    return spark.sql(query, args=args) if args else spark.sql(query)


def scalar(spark: SparkSession, query: str, kind: type | None = None, **args):
    """The only value of a query that gives one row of one column, as kind; anything else is an error."""
    df = statement(spark, query, **args)
    if len(df.columns) != 1:
        raise ValueError(f"the query gives {len(df.columns)} columns, not one")
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError(f"the query gives {'no row' if not rows else 'several rows'}, not one")
    value = rows[0][0]
    return value if kind is None or value is None else kind(value)


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Tables of a data folder as temporary views."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
