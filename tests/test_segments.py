"""Key sets over one shared cut of the time line equal plain windows, and shuffle the whole rows once."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lathe.operators.sequence import Sequence, over_sequences, rolling_mean
from lathe.session import cut_lineage

ORDER = ("StartTime", "JobNumber")


def jobs(spark, n=900):
    # a key with a third of the rows, null and rare keys, equal times, rows without a time
    d = spark.range(n).selectExpr("concat('J', lpad(id * 37 % 900, 4, '0')) JobNumber", "if(id % 3 = 0, 'hot', concat('M', id % 5)) machine",
                                  "if(id % 7 = 0, null, if(id % 101 = 0, concat('R', id % 4), concat('O', id % 3))) OperatorName",
                                  "if(id % 97 = 0, null, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, cast(id * id % 977 * 13 as int))) StartTime",
                                  "if(id % 11 = 0, null, cast(id % 17 as double)) x", "id as passed")
    return cut_lineage(d)


def sequences():
    def machine(w):
        return {"m5": rolling_mean("x", 5, w), "prev": F.lag("StartTime").over(w())}

    def pair(w):
        return {"nxt": F.lead("x").over(w()), "p3": rolling_mean("x", 3, w)}

    return [Sequence(["machine"], ["x"], (machine,), before=4), Sequence(["machine", "OperatorName"], ["x"], (pair,), before=2, after=1),
            Sequence(["OperatorName"], ["x"], (lambda w: {"_d": F.col("x") - F.lag("x").over(w())}, lambda w: {"d3": rolling_mean("_d", 3, w)}), before=3),
            Sequence(["OperatorName"], ["x"], counter="n", since={"since0": F.col("x") == 0, "since20": F.col("x") > 20, "since3": F.col("x") % 3 == 0}),
            Sequence(["OperatorName"], ["x"], (lambda w: {"o2": rolling_mean("x", 2, w)},), before=1), Sequence(["machine"], counter="nm")]


@pytest.mark.parametrize("segment_rows", [1, 3, 40, 10_000])
def test_equal_to_plain_windows(spark, segment_rows):
    d = jobs(spark)
    got = over_sequences(d, sequences(), segment_rows=segment_rows)
    m, o, p = (Window.partitionBy(*k).orderBy(*ORDER) for k in (["machine"], ["OperatorName"], ["machine", "OperatorName"]))
    want = d.withColumn("_d", F.col("x") - F.lag("x").over(o)).select(
        "*", F.avg("x").over(m.rowsBetween(-4, 0)).alias("m5"), F.lag("StartTime").over(m).alias("prev"), F.lead("x").over(p).alias("nxt"),
        F.avg("x").over(p.rowsBetween(-2, 0)).alias("p3"), F.avg("_d").over(o.rowsBetween(-2, 0)).alias("d3"), F.row_number().over(o).cast("long").alias("n"), F.row_number().over(m).cast("long").alias("nm"),
        F.avg("x").over(o.rowsBetween(-1, 0)).alias("o2")).withColumns({name: F.col("n") - F.max(F.when(on, F.col("n"))).over(o.rowsBetween(Window.unboundedPreceding, 0)) for name, on in sequences()[3].since.items()})
    columns = ["since0", "since20", "since3", "o2", "JobNumber", "passed", "machine", "OperatorName", "StartTime", "m5", "prev", "nxt", "p3", "d3", "n", "nm"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_whole_rows_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = over_sequences(jobs(spark), sequences(), segment_rows=40)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hash", plan)) == 1 and "Join" not in plan, plan


def test_no_rows(spark):
    assert over_sequences(jobs(spark).where("false"), sequences()).collect() == []


def test_derived_columns_are_made_again_and_not_shuffled(spark, sf_dir):
    from lathe.operators.derive import rolling_features, rolling_on_derived
    from lathe.plans.tables import F as derived

    f = derived(spark, sf_dir)
    out, want = rolling_on_derived(f), rolling_features(f)
    assert out.columns == want.columns and out.dtypes == want.dtypes
    assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line and "/derived_" in line]
    assert scan and not any("hour_sin" in line or "IdleTime_ratio" in line for line in scan), scan
