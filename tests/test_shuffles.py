"""Steps shared by the job-log queries do not shuffle jobs by a key of few values, and shuffle them no more often than needed."""

import os
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from lathe.functions.quantiles import exact_quantiles
from lathe.operators import anomalies, derive, summaries, windows
from lathe.operators.sequence import over_sequence, rolling_mean, with_position
from lathe.schema import DEFAULT
from lathe.session import cut_lineage, stage

COLUMNS = "JobNumber string, machine string, OperatorName string, PartNumber string, StartTime timestamp_ntz, JobDuration double, SetupTime double, efficiency double, total_downtime double"


def jobs(spark, n=300):
    d = spark.range(n).selectExpr("concat('J', id) JobNumber", "concat('M', id % 2) machine", "if(id % 5 = 0, null, concat('O', id % 3)) OperatorName", "concat('P', id % 4) PartNumber",
                                  "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 % 40 as int)) StartTime",
                                  "cast(id as double) JobDuration", "cast(id % 11 as double) SetupTime", "cast(id % 7 as double) efficiency", "cast(id % 13 as double) total_downtime")
    return cut_lineage(d)


def initial_plan(df):
    """The physical plan before a stage has run."""
    return df._jdf.queryExecution().sparkPlan().toString()


def shuffles(df):
    return re.findall(r"Exchange (hash\w+\([^)]*\))", df._jdf.queryExecution().executedPlan().toString())


def test_statistics_by_key_are_broadcast(spark):
    d = jobs(spark)
    for out in (derive.group_features(d), anomalies.machine_deviation(d), anomalies.operator_deviation(d)):
        plan = initial_plan(out)
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, plan


def test_stacked_rows_are_not_shuffled_by_feature(spark):
    plan = initial_plan(summaries.binned_mutual_information(jobs(spark), "efficiency", ["SetupTime", "JobDuration"]))
    assert "SortMergeJoin" not in plan, plan


def test_a_sequence_shuffles_its_rows_twice(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        d = jobs(spark)
        out = over_sequence(d, ["machine", "OperatorName"], lambda w: {"m": rolling_mean("efficiency", 3, w)}, before=2)
        wide = [s for s in shuffles(out) if "_g#" in s or "_chunk#" in s]
        assert len(wide) == 2 and len(shuffles(with_position(d, ["machine"]))) == 4, shuffles(out)  # rows, counts, their sums, offsets
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_chunk_is_a_small_part_of_a_key():
    assert DEFAULT.chunk_rows <= 50_000


def test_quantiles_count_few_values(spark, monkeypatch):
    d = spark.range(20_000).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") < 7, float("inf")).otherwise(F.col("id") % 3).alias("y"), F.lit(None).cast("double").alias("z"))
    seen = []
    explode = F.explode
    monkeypatch.setattr(F, "explode", lambda c: seen.append(d.select(F.col("id") if "id" in d.columns else F.col("x").alias("v0"), F.col("y").alias("v1"), F.col("z").alias("v2")).select(explode(c)).count()) or explode(c))
    ps = [0.0, 0.25, 0.5, 0.999, 1.0]
    found = exact_quantiles(d, {"x": ps, "y": [0.5], "z": [0.5]})
    want = d.agg(*[F.percentile("x", p) for p in ps], F.percentile("y", 0.5)).first()
    assert found == {"x": list(want[:5]), "y": [want[5]], "z": [None]}
    assert seen and seen[0] < 20_000 * 0.5, seen  # y has three values, a third of its rows each; x a hundredth by percentile


def test_steps_of_counters_are_stored_one_by_one(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = jobs(spark)
        out = windows.sequence_counters(d, {"a": ["machine"], "b": ["OperatorName"], "c": ["machine", "PartNumber"]})
        assert len(shuffles(out)) == 4, shuffles(out)  # those of the last step
        rows = {r["JobNumber"]: r for r in out.collect()}
        for name, keys in {"a": ["machine"], "b": ["OperatorName"], "c": ["machine", "PartNumber"]}.items():
            w = Window.partitionBy(*keys).orderBy("StartTime", "JobNumber")
            assert all(rows[r["JobNumber"]][name] == r["n"] for r in d.select("JobNumber", F.row_number().over(w).alias("n")).collect())
        assert len(shuffles(windows.efficiency_history(d))) == 5 and len(shuffles(derive.rolling_features(d.withColumn("parts_per_hour", F.lit(1.0))))) == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_stage_replaces_the_one_before(spark):
    first = stage(jobs(spark))
    second = stage(first.where("machine = 'M1'"), first)
    assert not os.path.exists(first.stored_at) and second.count() == 150
