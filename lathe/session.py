"""Session construction for tests and the benchmark, plus shared-storage helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lathe") -> SparkSession:
    """A local session for tests and benchmarks (a cluster passes its own session)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder, setting a local one only when unset.

    On a cluster `spark.checkpoint.dir` names shared storage and is used as is.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="lathe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name


@contextmanager
def small_methods(spark: SparkSession):
    """Within, a step whose generated code would be one method of over 8,000 bytes runs by operators, whose code is split.

    HotSpot interprets longer methods and never compiles them: a projection of 40 columns took ten times as long."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame, name: str | None = None) -> DataFrame:
    """Materialise `df` on shared storage and return a DataFrame reading it back.

    It is written as compressed parquet, under a name of its own without `name`: smaller than a
    `checkpoint()` of rows, and read by column.
    """
    spark = df.sparkSession
    path = shared_path(spark, name or f"stage_{uuid.uuid4().hex[:12]}")
    with small_methods(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_statistics(df: DataFrame) -> DataFrame:
    """Statistics by key (a row for each machine, part, ...), stored before they are joined to jobs.

    Plans then know their size from the start: small ones are broadcast, and the jobs are not shuffled
    by a key of a few values first, which puts a machine's jobs into one task. Large ones join as usual.
    """
    return cut_lineage(df, f"statistics_{uuid.uuid4().hex[:12]}")


def stage(df: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Store `df` whole between two steps that each shuffle all rows, and read it back.

    The shuffle files of the steps before are no longer needed then, and Spark is made to delete them
    now; `done`, the stage that `df` was computed from, is deleted too. Disk holds one step at a time.
    """
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex[:12]}"
    out = cut_lineage(df, name)
    out.stored_at = shared_path(spark, name)
    gc.collect()
    spark._jvm.System.gc()
    if done is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(done.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out
