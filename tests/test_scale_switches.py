"""Answers that must not change with table size, batch size or window length."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lathe.models import isoforest
from lathe.operators import clean, summaries, windows
from lathe.plans.tables import F as derived
from lathe.streaming import ops


def test_forest_samples_are_full_on_six_million_rows(spark):
    df = spark.range(6_000_000).select("id", (F.rand(1) * 10).alias("x"))
    forest = isoforest.fit(df, ["id"], ["x"], n_trees=4, sample_size=256)
    roots = forest[forest["node"] == 0]
    assert len(roots) == 4 and (roots["size"] == 256).all()
    with pytest.raises(ValueError):
        isoforest.fit(df.limit(0), ["id"], ["x"])


def _events(spark, n=200):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=(i * 7919) % 20_000), i % 3, "view", 1.0, None) for i in range(n)]
    return spark.createDataFrame(rows, ops.EVENT_SCHEMA), rows


@pytest.mark.parametrize("window_s", [60, 3600, 7200, 10_000])
def test_limiter_windows_of_any_length(spark, window_s):
    df, rows = _events(spark)
    got = {r.event_id: r.prior_requests for r in ops.rate_limit_all(df, 5, window_s).collect()}
    for i, ts, user, *_ in rows:
        assert got[i] == sum(u == user and dt.timedelta(0) < ts - t < dt.timedelta(seconds=window_s) for _, t, u, *_ in rows)


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_accepted_limiter_in_time_order(spark, tmp_path, batch):
    df, rows = _events(spark)
    df.repartition(1).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        stream = spark.readStream.schema(ops.EVENT_SCHEMA).parquet(str(tmp_path / "events.parquet"))
        got = {r.event_id: r.allowed for r in ops.run_available(ops.rate_limit_accepted(stream, 4, 600), "accepted_test").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    accepted = defaultdict(list)
    for i, ts, user, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        allowed = sum(t >= ts - dt.timedelta(seconds=600) for t in accepted[user]) < 4
        if allowed:
            accepted[user].append(ts)
        assert got[i] == allowed
    assert len(set(got.values())) == 2


def test_sequence_plans_grow_linearly(spark, sf_dir):
    f = derived(spark, sf_dir)

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    keys = {"a": ["machine"], "b": ["OperatorName"], "c": ["PartNumber"], "d": ["machine", "PartNumber"]}
    assert scans(windows.sequence_counters(f, keys)) <= 2 * len(keys)
    assert scans(windows.efficiency_history(f)) <= 6
    assert scans(windows.gaps(f)) <= 6
    assert scans(windows.pair_means(f)) <= 8


def test_ranking_rounds_before_it_sorts(spark):
    rows = [("a", x) for x in (0.5004, 0.5004, 0.5004)] + [("b", x) for x in (0.5001, 0.5001, 0.5001)] + [("c", x) for x in (0.4, 0.4, 0.4)]
    got = summaries.top_performers(spark.createDataFrame([("b", 0.50049)] * 3 + rows[:3] + rows[6:], "machine string, efficiency double"), "machine", top_n=1).collect()
    assert got[0]["machine"] == "a" and got[0]["avg_efficiency"] == 0.5


def test_request_types(spark):
    frame = spark.createDataFrame([(t, "M1", "P1", 1.0, 1) for t in ("efficiency", "downtime", "both", "duration", "all")],
                                  "prediction_type string, machine string, part string, planned_cycle_time double, quantity int")
    assert {r.prediction_type for r in clean.validate_requests(frame).where("is_valid").collect()} == {"efficiency", "downtime", "both"}
