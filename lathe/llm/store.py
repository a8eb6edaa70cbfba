"""Intermediate tables in the session's shared folder."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, shared_path


def folder(spark: SparkSession, name: str) -> str:
    """A new path (not created) under the shared checkpoint folder."""
    return shared_path(spark, f"llm-{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` as Parquet in the shared folder and return the table read back.

    Cuts lineage: a lost executor re-reads the stored files instead of recomputing them."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once all that was computed from them is stored itself."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def mounted(spark: SparkSession, name: str) -> str:
    """A new local path in the shared folder, created, for files that workers memory-map.

    The shared folder has to be a mounted file system (no scheme, or file:)."""
    ensure_checkpoint_dir(spark)
    path = folder(spark, name)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a mounted spark.checkpoint.dir, not {path}")
    os.makedirs(path, exist_ok=True)
    return path


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished stages now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
