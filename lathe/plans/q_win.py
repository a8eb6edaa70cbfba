"""Registered sequence-window queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F_

from ..operators import windows as W
from ..schema import DOWNTIME
from .oracle import r6, sql
from .registry import query
from .tables import F

ORD = "ORDER BY StartTime, JobNumber"


def over(keys: str, k: int | None = None) -> str:
    frame = f" ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW" if k else ""
    return f"OVER (PARTITION BY {keys} {ORD}{frame})"


@query("win5_downtime_history", sql(f"""
SELECT JobNumber, StartTime, {', '.join(f"{r6(f'avg({c}) ' + over('machine', 5))} AS {c}_machine_avg, {r6(f'avg({c}) ' + over('OperatorName', 5))} AS {c}_operator_avg" for c in DOWNTIME)}
FROM F"""))
def win5(spark, d):
    out = W.downtime_history(F(spark, d))
    return out.select("JobNumber", "StartTime", *[x for c in DOWNTIME for x in (f"{c}_machine_avg", f"{c}_operator_avg")])


@query("win6_jobs_since_downtime", sql(f"""
SELECT JobNumber, StartTime, machine, OperatorName,
  {', '.join(f"CAST(coalesce(pos - max(CASE WHEN {c} > 0 THEN pos END) OVER (PARTITION BY machine, OperatorName {ORD} ROWS UNBOUNDED PRECEDING), 999) AS BIGINT) AS time_since_{c}" for c in DOWNTIME)}
FROM (SELECT *, row_number() OVER (PARTITION BY machine, OperatorName {ORD}) - 1 AS pos FROM F)"""))
def win6(spark, d):
    return W.jobs_since_downtime(F(spark, d)).select(
        "JobNumber", "StartTime", "machine", "OperatorName", *[f"time_since_{c}" for c in DOWNTIME])


_DOM = "CASE WHEN " + " + ".join(DOWNTIME) + " = 0 THEN 'NoDowntime' ELSE CASE " + " ".join(
    f"WHEN {c} = greatest({', '.join(DOWNTIME)}) THEN '{c}'" for c in DOWNTIME) + " END END"


@query("win7_next_downtime", sql(f"""
SELECT JobNumber, StartTime, machine, OperatorName, dominant_downtime, next_downtime FROM (
  SELECT *, lead(dominant_downtime) OVER (PARTITION BY machine, OperatorName {ORD}) AS next_downtime
  FROM (SELECT *, {_DOM} AS dominant_downtime FROM F)) WHERE next_downtime IS NOT NULL"""))
def win7(spark, d):
    return W.next_downtime(F(spark, d)).select(
        "JobNumber", "StartTime", "machine", "OperatorName", "dominant_downtime", "next_downtime")


_FIRST = "CASE " + " ".join(f"WHEN {c} = greatest({', '.join(DOWNTIME)}) THEN '{c}'" for c in DOWNTIME) + " END"


@query("win8_downtime_sequences", sql(f"""
SELECT current_downtime, next_downtime, count(*) AS "count" FROM (
  SELECT current_downtime, lead(current_downtime) OVER (PARTITION BY machine {ORD}) AS next_downtime
  FROM (SELECT *, {_FIRST} AS current_downtime FROM F)) WHERE next_downtime IS NOT NULL
GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 10"""))
def win8(spark, d):
    return W.downtime_sequences(F(spark, d))


_COUNTERS = {
    "operator_machine_jobs": ["OperatorName", "machine"],
    "operator_job_number": ["OperatorName"],
    "operator_part_familiarity": ["OperatorName", "PartNumber"],
    "machine_job_sequence": ["machine"],
    "jobs_today": ["machine", "OperatorName", "job_date"],
}


@query("win9_sequence_counters", sql(f"""
SELECT JobNumber, StartTime, {', '.join(f"row_number() {over(', '.join(k))} AS {n}" for n, k in _COUNTERS.items())},
  CASE WHEN row_number() {over('OperatorName, machine')} <= 1 THEN 'novice'
       WHEN row_number() {over('OperatorName, machine')} <= 5 THEN 'beginner'
       WHEN row_number() {over('OperatorName, machine')} <= 15 THEN 'experienced' ELSE 'expert' END AS experience_level
FROM (SELECT *, CAST(StartTime AS DATE) AS job_date FROM F)"""))
def win9(spark, d):
    f = F(spark, d).select("JobNumber", "StartTime", "machine", "OperatorName", "PartNumber", F_.to_date("StartTime").alias("job_date"))
    out = W.sequence_counters(f, _COUNTERS, at_once=True)
    return out.select("JobNumber", "StartTime", *_COUNTERS,
                      W.experience_label("operator_machine_jobs").alias("experience_level"))


@query("win11_recent_performance", sql(f"""
SELECT JobNumber, StartTime, {r6('avg(efficiency) ' + over('machine, OperatorName', 3))} AS recent_efficiency,
  {r6('avg(total_downtime) ' + over('machine, OperatorName', 3))} AS recent_downtime_trend,
  {r6('coalesce(stddev_samp(efficiency) ' + over('machine, OperatorName', 5) + ', 0.0E0)')} AS efficiency_consistency
FROM F"""))
def win11(spark, d):
    return W.recent_performance(F(spark, d)).select(
        "JobNumber", "StartTime", "recent_efficiency", "recent_downtime_trend", "efficiency_consistency")


_W12 = ([(f"machine_JobDuration_rolling_{k}", "JobDuration", "machine", k) for k in (3, 5, 10)]
        + [(f"{v}_rolling_{k}", v, "machine", k) for v in ("RunningTime", "SetupTime", "total_downtime") for k in (3, 5)]
        + [(f"operator_JobDuration_rolling_{k}", "JobDuration", "OperatorName", k) for k in (3, 5, 10)])


@query("win12_duration_rolling", sql(
    f"SELECT JobNumber, StartTime, {', '.join(f'{r6(f'avg({v}) ' + over(k, n))} AS {o}' for o, v, k, n in _W12)} FROM F"))
def win12(spark, d):
    return W.duration_rolling(F(spark, d)).select("JobNumber", "StartTime", *[o for o, *_ in _W12])


_W13 = ([(f"machine_efficiency_rolling_{k}", "machine", k) for k in (5, 10, 20)]
        + [(f"operator_efficiency_rolling_{k}", "OperatorName", k) for k in (5, 10, 20)]
        + [(f"machine_operator_efficiency_rolling_{k}", "machine, OperatorName", k) for k in (3, 5)])


@query("win13_efficiency_history", sql(f"""
SELECT JobNumber, StartTime, {', '.join(f"{r6('avg(efficiency) ' + over(k, n))} AS {o}" for o, k, n in _W13)},
  {r6(f"CASE WHEN count(efficiency) {over('machine, OperatorName', 5)} >= 2 THEN regr_slope(efficiency, CAST(pos AS DOUBLE)) {over('machine, OperatorName', 5)} END")} AS efficiency_trend,
  {r6(f"coalesce(CASE WHEN count(efficiency) {over('machine, OperatorName', 10)} >= 2 THEN stddev_samp(efficiency) {over('machine, OperatorName', 10)} END, 0.0E0)")} AS efficiency_volatility
FROM (SELECT *, row_number() OVER (PARTITION BY machine, OperatorName {ORD}) - 1 AS pos FROM F)"""))
def win13(spark, d):
    f = F(spark, d).select("JobNumber", "StartTime", "machine", "OperatorName", "efficiency")
    return W.efficiency_history(f, at_once=True).select(
        "JobNumber", "StartTime", *[o for o, *_ in _W13], "efficiency_trend", "efficiency_volatility")


def _gap(keys: str, first: str) -> str:
    return (f"coalesce(CAST(datesub('second', lag(StartTime) OVER (PARTITION BY {keys} {ORD}), StartTime) AS DOUBLE), "
            f"{first})")


@query("win15_time_gaps", sql(f"""
SELECT JobNumber, StartTime, {_gap('machine', '0.0E0')} AS time_since_last_machine_job,
  {_gap('machine, OperatorName', '0.0E0')} AS time_since_last_job,
  {_gap('machine, PartNumber', '86400.0E0')} AS time_since_last_part_job FROM F"""))
def win15(spark, d):
    return W.gaps(F(spark, d)).select("JobNumber", "StartTime", "time_since_last_machine_job", "time_since_last_job",
                                      "time_since_last_part_job")


@query("win16_learning_rate", sql(f"""
SELECT JobNumber, StartTime, {r6(f"coalesce(CASE WHEN count(dif) {over('OperatorName, machine', 5)} >= 2 THEN avg(dif) {over('OperatorName, machine', 5)} END, 0.0E0)")} AS operator_learning_rate
FROM (SELECT *, efficiency - lag(efficiency) OVER (PARTITION BY OperatorName, machine {ORD}) AS dif FROM F)"""))
def win16(spark, d):
    return W.learning_rate(F(spark, d)).select("JobNumber", "StartTime", "operator_learning_rate")


_W17 = {
    "machine_part_avg_duration": "machine, PartNumber", "operator_machine_avg_duration": "OperatorName, machine",
    "operator_part_avg_duration": "OperatorName, PartNumber", "machine_avg_JobDuration": "machine",
    "operator_avg_JobDuration": "OperatorName", "part_avg_JobDuration": "PartNumber",
}


@query("win17_group_means", sql(f"""
SELECT JobNumber, StartTime, {', '.join(f"{r6(f'avg(JobDuration) OVER (PARTITION BY {k})')} AS {o}" for o, k in _W17.items())},
  {r6('efficiency - avg(efficiency) OVER (PARTITION BY machine)')} AS efficiency_vs_machine_avg FROM F"""))
def win17(spark, d):
    return W.pair_means(F(spark, d)).select("JobNumber", "StartTime", *_W17, "efficiency_vs_machine_avg")


_W18 = ([(f"machine_{m}_roll_{k}", m, "machine", k) for m in ("efficiency", "total_downtime") for k in (3, 5, 10)]
        + [(f"operator_{m}_roll_{k}", m, "OperatorName", k) for m in ("efficiency", "SetupTime") for k in (3, 5)])
_STD5 = (f"coalesce(CASE WHEN count(efficiency) {over('machine', 5)} >= 2 THEN stddev_samp(efficiency) "
         f"{over('machine', 5)} END, 0.0E0)")


@query("win18_notebook_rolling", sql(f"""
SELECT JobNumber, StartTime, {', '.join(f'{r6(o)} AS {o}' for o, *_ in _W18)}, {r6('s5')} AS machine_efficiency_std_5,
  {r6('efficiency - machine_efficiency_roll_5')} AS efficiency_vs_machine_roll,
  {r6('efficiency - operator_efficiency_roll_3')} AS efficiency_vs_operator_roll, {r6('1 / (1 + s5)')} AS stability_score
FROM (SELECT *, {', '.join(f'avg({v}) {over(k, n)} AS {o}' for o, v, k, n in _W18)}, {_STD5} AS s5 FROM F)"""))
def win18(spark, d):
    return W.notebook_rolling(F(spark, d)).select(
        "JobNumber", "StartTime", *[o for o, *_ in _W18], "machine_efficiency_std_5", "efficiency_vs_machine_roll",
        "efficiency_vs_operator_roll", "stability_score")


def _trend_sql(keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    sel = f"{keys}, " if keys else ""
    return sql(f"""
SELECT {sel}rows, {r6('recent_avg')} AS recent_avg, {r6('older_avg')} AS older_avg,
  CASE WHEN rows < 2 THEN 'stable' WHEN recent_avg > older_avg * 1.05 THEN 'improving'
       WHEN recent_avg < older_avg * 0.95 THEN 'declining' ELSE 'stable' END AS trend
FROM (SELECT {sel}first(n) AS rows, avg(CASE WHEN pos >= n - floor(n / 3) THEN efficiency END) AS recent_avg,
  avg(CASE WHEN pos < floor(n / 3) THEN efficiency END) AS older_avg
  FROM (SELECT *, row_number() OVER ({part}{ORD}) - 1 AS pos, count(*) OVER ({part.strip()}) AS n FROM F) {grp})""")


@query("win20_trend_overall", _trend_sql(""))
def win20(spark, d):
    return W.trend_label(F(spark, d), "efficiency")


@query("win20_trend_by_machine", _trend_sql("machine"))
def win20_m(spark, d):
    return W.trend_label(F(spark, d), "efficiency", ["machine"])


@query("win21_daily_efficiency", sql(f"""
SELECT date, {r6('efficiency')} AS efficiency,
  {r6('CASE WHEN count(*) OVER () > 30 THEN avg(efficiency) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END')} AS efficiency_ma7
FROM (SELECT CAST(StartTime AS DATE) AS date, avg(efficiency) AS efficiency FROM F GROUP BY CAST(StartTime AS DATE))"""))
def win21(spark, d):
    return W.daily_efficiency(F(spark, d))
