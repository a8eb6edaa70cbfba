"""Chunked sequence windows equal plain windows, including across chunk borders and a hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lathe.operators.sequence import cumulative_last, over_sequence, rolling_mean, with_position


def frame(spark):
    # key 'hot' holds most rows; timestamps collide so JobNumber breaks ties
    rows = []
    for i in range(400):
        key = "hot" if i % 5 else f"k{i % 3}"
        rows.append((key, f"J{i:04d}", f"2024-01-{1 + (i // 40):02d} {(i * 7) % 24:02d}:00:00", float(i % 17)))
    df = spark.createDataFrame(rows, "k string, JobNumber string, ts string, x double")
    return df.select("k", "JobNumber", F.col("ts").cast("timestamp_ntz").alias("StartTime"), "x")


def test_position_is_row_number(spark):
    df = frame(spark)
    got = with_position(df, ["k"]).select("JobNumber", "_pos")
    w = Window.partitionBy("k").orderBy("StartTime", "JobNumber")
    exp = df.select("JobNumber", (F.row_number().over(w) - 1).alias("_pos"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_rolling_and_lag_across_chunks(spark):
    df = frame(spark)
    got = over_sequence(df, ["k"], lambda w: {"m5": rolling_mean("x", 5, w), "prev": F.lag("x").over(w()),
                                              "nxt": F.lead("x").over(w())},
                        before=4, after=1, chunk_rows=7)
    w = Window.partitionBy("k").orderBy("StartTime", "JobNumber")
    exp = df.select("*", F.avg("x").over(w.rowsBetween(-4, 0)).alias("m5"), F.lag("x").over(w).alias("prev"),
                    F.lead("x").over(w).alias("nxt"))
    key = ["JobNumber", "m5", "prev", "nxt"]
    assert sorted(got.select(*key).collect()) == sorted(exp.select(*key).collect())


def test_cumulative_last(spark):
    df = with_position(frame(spark), ["k"])
    got = cumulative_last(df, ["k"], {"last": F.col("x") > 14}, chunk_rows=6).select("JobNumber", "last")
    w = Window.partitionBy("k").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("JobNumber", F.max(F.when(F.col("x") > 14, F.col("_pos"))).over(w).alias("last"))
    assert sorted(got.collect()) == sorted(exp.collect())
