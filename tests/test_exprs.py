"""Hand-built frames for the numeric traps (NULL caps, safe division, rounding, ranks, bins)."""

from pyspark.sql import functions as F

from lathe.functions import exprs as X


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_cap1_keeps_null(spark):
    assert one(spark, [(None,), (1.5,), (0.5,)], "x double", X.cap1("x")) == [None, 1.0, 0.5]


def test_sdiv(spark):
    got = one(spark, [(1.0, 0.0), (None, 2.0), (1.0, None), (3.0, 2.0)], "n double, d double", X.sdiv("n", "d"))
    assert got == [0.0, None, None, 1.5]


def test_round_half_even(spark):
    got = one(spark, [(0.125,), (0.375,), (2.5,)], "x double", X.rnd("x", 2))
    assert got == [0.12, 0.38, 2.5]
    assert one(spark, [(2.5,), (3.5,)], "x double", X.rnd("x", 0)) == [2.0, 4.0]


def test_average_rank(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.8), ("d", None)], "k string, v double")
    got = dict(df.select("k", X.avg_rank_desc("v").alias("r")).collect())
    assert got == {"a": 1.0, "b": 2.5, "c": 2.5, "d": None}


def test_equal_width_bins(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    s = df.agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    got = [r[0] for r in df.crossJoin(s).select(X.cut_equal3("x", "mn", "mx")).collect()]
    assert got == ["Simple", "Simple", "Medium", "Complex"]
    const = spark.createDataFrame([(5.0, 5.0, 5.0)], "x double, mn double, mx double")
    assert const.select(X.cut_equal3("x", "mn", "mx")).first()[0] == "Medium"


def test_right_closed_cut(spark):
    got = one(spark, [(0,), (10,), (11,), (500,)], "x int", X.cut("x", [0, 10, 50, 200, float("inf")],
                                                                ["N", "I", "E", "X"]))
    assert got == [None, "N", "I", "X"]


def test_consistency_null_std_gives_null_score(spark):
    e = X.perf_score(F.col("e"), F.lit(1.0), X.rel_consistency("s", "e"))
    assert one(spark, [(0.5, None)], "e double, s double", e) == [None]


def test_seconds_between_ignores_session_zone(spark):
    df = spark.createDataFrame([("2024-03-09 23:00:00", "2024-03-10 05:00:00")], "a string, b string").select(
        F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    assert df.select(X.seconds_between("a", "b")).first()[0] == 6 * 3600.0
    assert df.select(X.floor_days_between("a", "b")).first()[0] == 0


def test_shift(spark):
    assert one(spark, [(5,), (6,), (14,), (22,)], "h int", X.shift_of("h")) == ["Night", "Day", "Evening", "Night"]
