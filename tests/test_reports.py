"""Daily report sections and the trend from hourly counts, on hand-made logs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lathe.operators.summaries import daily_report_sections
from lathe.operators.windows import trend_label

JOBS = "JobNumber string, StartTime timestamp_ntz, OperatorName string, machine string, efficiency double, total_downtime double"


def test_report_of_a_day(spark):
    day = dt.datetime(2024, 5, 2, 8)
    rows = [(str(i), day, f"op{i % 7}", f"m{i % 2}", None if i % 7 == 6 else i % 7 / 10, 1.005) for i in range(14)]
    rows += [("x", day - dt.timedelta(days=1), "early", "m9", 1.0, 5.0), ("y", None, "op1", "m0", 1.0, 5.0)]
    log = spark.createDataFrame(rows, JOBS)
    got = daily_report_sections(log).collect()
    assert [(r.name, r["rank"], r.avg_efficiency) for r in sorted(got, key=lambda r: r["rank"]) if r.section == "operator"] == [
        (f"op{i}", 6 - i, i / 10) for i in (5, 4, 3, 2, 1)]
    assert {r.name: r.jobs for r in got if r.section == "machine"} == {"m0": 7, "m1": 7}
    assert [(r.name, r.jobs) for r in got if r.section == "total"] == [(None, 14)]
    assert daily_report_sections(log, "2024-05-01").where("section = 'total'").first().jobs == 1
    assert daily_report_sections(log, "2023-01-01").collect() == [] == daily_report_sections(log.limit(0)).collect()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 301])
def test_trend_borders_inside_an_hour(spark, n):
    """All jobs of a third of the log fall into one hour, so both borders may cut the same one."""
    r = random.Random(n)
    start = dt.datetime(2024, 3, 10)
    rows = [(f"{i:04}", start + dt.timedelta(minutes=r.choice([r.randrange(60), r.randrange(6000)])), "o", r.choice("ab"), r.choice([None, r.random()]), 0.0) for i in range(n)]
    log = spark.createDataFrame(rows, JOBS)

    def want(rows):
        e = [x[4] for x in sorted(rows, key=lambda x: (x[1], x[0]))]
        k = len(e) // 3
        mean = lambda v: sum(v) / len(v) if v else None
        return len(e), mean([x for x in e[len(e) - k:] if x is not None]), mean([x for x in e[:k] if x is not None])

    whole = trend_label(log).first()
    assert (whole.rows, whole.recent_avg, whole.older_avg) == pytest.approx(want(rows)) and whole.trend in ("improving", "declining", "stable")
    for m in trend_label(log, keys=["machine"]).collect():
        assert (m.rows, m.recent_avg, m.older_avg) == pytest.approx(want([x for x in rows if x[3] == m.machine]))
    assert n > 1 or whole.trend == "stable"
