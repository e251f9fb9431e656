"""Running sums over a global order without one giant partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.shared import materialize

_PART = "_part"


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the running sum of an expression over the total order, the row itself included.

    Rows are range-partitioned; sums run inside a partition and are shifted by the totals of the partitions before,
    of which there is one row each. order must be total for a repeatable result.
    """
    values = {f"_v_{k}": v for k, v in sums.items()}
    ranged = df.withColumns(values).repartitionByRange(*order).withColumn(_PART, F.spark_partition_id())
    held = materialize(ranged, "ranged")
    totals = held.groupBy(_PART).agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(F.col(_PART), *[F.coalesce(F.sum(f"_t{v}").over(before), F.lit(0)).alias(f"_s{v}") for v in values])
    inside = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.join(shifts, _PART).select(*[F.col(c) for c in df.columns], *[(F.sum(f"_v_{k}").over(inside) + F.col(f"_s_v_{k}")).alias(k) for k in sums])
    return out


def numbered(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """df with its 1-based place in a total order."""
    return running(df, order, {name: F.lit(1).cast("long")})
