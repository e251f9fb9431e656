"""Lineage cuts and scratch tables in the folder that all executors share.

``spark.checkpoint.dir`` names the folder. Where it is unset, as in tests, a
folder below the warehouse is set once for the session. Written tables survive
the loss of any executor, which cached or locally checkpointed blocks do not.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared scratch folder, as a URI without a slash at its end; a path without a scheme lies in Hadoop's default file system.

    Without a setting a local session gets a folder below the warehouse; on a cluster that is an error, as no folder is known to be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", whole).rstrip("/")


_WRITTEN: list[str] = []  # scratch tables of this process, in order


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path for one written table or set of files, below a folder of this application."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all that this application has written there; results that still read it must be stored first."""
    _delete(spark, f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to a new scratch table and read it back: lineage ends here and nothing upstream runs twice."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._scratch = path
    _WRITTEN.append(path)
    return held


def staged(build: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The table that build() gives, written; scratch tables that were written on the way are deleted."""
    before = len(_WRITTEN)
    held = materialize(build(), tag)
    for path in [p for p in _WRITTEN[before:] if p != held._scratch]:
        _drop(held.sparkSession, path)
    return held


def _drop(spark: SparkSession, path: str) -> None:
    _delete(spark, path)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads; anything but a result of materialize() is left alone."""
    for held in tables:
        if path := getattr(held, "_scratch", None):
            _drop(held.sparkSession, path)
            held._scratch = None
