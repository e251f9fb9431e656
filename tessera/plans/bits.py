"""A bounded filter in front of a join: wide rows that can't match stay where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter; its table has at most this over 64 rows, so the broadcast is bounded whatever the tables hold.
BITS = 1 << 24


def _slot(keys: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def _flagged(rows: DataFrame, members: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _slot(keys).bitwiseAND(63).cast("int"))
    words = members.select(F.shiftright(_slot(keys), 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.withColumn("_word", F.shiftright(_slot(keys), 6)).join(F.broadcast(words), "_word", how)


def _on(keys: tuple[str, ...]) -> Column:
    return F.coalesce(F.getbit("_bits", _slot(keys).bitwiseAND(63).cast("int")) == 1, F.lit(False))


def passing(rows: DataFrame, members: DataFrame, *keys: str) -> DataFrame:
    """rows whose keys may be among those of members: all that are, and few others while the filter is not full.

    Both sides have the keys with equal types. The rows still go through the exact join; a full filter only saves nothing.
    """
    return _flagged(rows, members, keys, "inner").filter(_on(keys)).drop("_word", "_bits")


def failing(rows: DataFrame, members: DataFrame, *keys: str) -> DataFrame:
    """The other rows: their keys are surely not among those of members."""
    return _flagged(rows, members, keys, "left").filter(~_on(keys)).drop("_word", "_bits")
