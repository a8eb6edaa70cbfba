"""Job-log view derived from the TPC-H-like test tables (lineitem joined to orders).

The projection is deterministic, so the same rows come out of Spark and of the
DuckDB oracle (see `lathe.plans.oracle.JOBLOG_SQL`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _s(c):
    return F.col(c).cast("string")


def joblog_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    j = li.join(o, li.l_orderkey == o.o_orderkey)

    disc = F.round(F.col("l_discount") * 100)
    big = F.when(F.col("l_orderkey") % 1009 == 0, F.lit(4000.0)).otherwise(F.lit(0.0))
    start_off = (
        F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31 + F.col("l_suppkey")
    ) % 86400
    a = j.select(
        F.concat(_s("l_orderkey"), F.lit("-"), _s("l_linenumber"), F.lit("-"), _s("l_partkey"), F.lit("-"),
                 _s("l_suppkey")).alias("JobNumber"),
        F.col("l_orderkey").alias("okey"),
        F.concat(F.lit("M"), (F.col("l_suppkey") % 12).cast("string")).alias("machine"),
        F.when(F.col("o_custkey") % 24 == 23, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("OP"), (F.col("o_custkey") % 24).cast("string"))).alias("OperatorName"),
        F.when(F.col("l_partkey") % 157 == 156, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("P"), (F.col("l_partkey") % 157).cast("string"))).alias("PartNumber"),
        F.concat(F.lit("E"), (F.col("o_custkey") % 24).cast("string")).alias("EmpID"),
        F.when(F.col("l_orderkey") % 613 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")).alias("State"),
        F.col("l_linenumber").cast("int").alias("OpNumber"),
        F.when(F.col("l_orderkey") % 997 == 0, F.lit("1969-12-31 18:00:00").cast("timestamp_ntz"))
        .otherwise(F.timestamp_add("SECOND", start_off, F.col("l_shipdate").cast("timestamp_ntz"))).alias("StartTime"),
        (F.col("l_quantity") * 120.0).alias("RunningTime"),
        F.when(F.col("l_orderkey") % 211 == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("PartsProduced"),
        (((F.col("l_partkey") % 157) * 6).cast("double") + disc * 60.0 + big).alias("SetupTime"),
        (F.round(F.col("l_tax") * 100) * 30.0).alias("WaitingSetupTime"),
        ((F.col("l_linenumber") - 3) * 20).cast("double").alias("NotFeedingTime"),
        (disc * 40.0 + big).alias("AdjustmentTime"),
        F.when(F.col("l_returnflag") == "R", F.lit(180.0)).otherwise(F.lit(0.0)).alias("DressingTime"),
        (((F.col("l_suppkey") % 7) * 30).cast("double") + big).alias("ToolingTime"),
        F.when(F.col("l_linestatus") == "F", F.lit(90.0)).otherwise(F.lit(0.0)).alias("EngineeringTime"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 50 == 0, F.lit(5400.0)).otherwise(F.lit(0.0)).alias("MaintenanceTime"),
        F.lit(0.0).alias("BuyInTime"),
        ((F.col("l_linenumber") % 2) * 300).cast("double").alias("BreakShiftChangeTime"),
        F.when(F.col("l_orderkey") % 499 == 0, F.lit(90000.0))
        .otherwise(((F.col("l_orderkey") * 13 + F.col("l_partkey")) % 1800).cast("double")).alias("IdleTime"),
    )
    dur = (
        F.col("RunningTime") + F.col("SetupTime") + F.col("WaitingSetupTime") + F.greatest(F.col("NotFeedingTime"), F.lit(0.0))
        + F.col("AdjustmentTime") + F.col("DressingTime") + F.col("ToolingTime") + F.col("EngineeringTime")
        + F.col("MaintenanceTime") + F.col("BreakShiftChangeTime") + F.least(F.col("IdleTime"), F.lit(1800.0))
    )
    b = a.withColumn(
        "JobDuration",
        F.when(F.col("okey") % 811 == 0, F.lit(30.0)).when(F.col("okey") % 701 == 0, F.lit(80000.0)).otherwise(dur),
    )
    b = b.withColumn("EndTime", F.timestamp_add("SECOND", F.col("JobDuration").cast("bigint"), F.col("StartTime")))
    return b.drop("okey")


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")
