"""Registered feature-set queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F_

from ..operators import features as FE
from ..schema import DOWNTIME
from .oracle import r6, sql
from .registry import query
from .tables import C, F

_INTS = ("machine_part_diversity", "operator_versatility", "part_production_frequency", "daily_job_count", "machine_operator_pressure")
_OUT = ", ".join(f"{c}" if c in _INTS else f"{r6(c)} AS {c}" for c in FE.GROUP_FEATURES)


@query("fea1_group_features", sql(f"""
SELECT JobNumber, StartTime, {_OUT} FROM (
  SELECT F.JobNumber, F.StartTime, m.* EXCLUDE (k), coalesce(oe, e) AS operator_baseline_efficiency, operator_versatility,
    1 / (1 + coalesce(os, s)) AS operator_consistency, 1 / (1 + coalesce(ot, st) / 1000) AS operator_setup_expertise,
    coalesce(pt, st) AS part_complexity, part_production_frequency, coalesce(pb, pp) AS part_typical_batch_size,
    coalesce(fit, e) AS machine_part_suitability, expected_hourly_efficiency, expected_daily_efficiency, daily_job_count,
    machine_operator_pressure, coalesce(pe, 1.0) AS expected_parts, PartsProduced / nullif(coalesce(pe, 1.0), 0) AS parts_pressure
  FROM F CROSS JOIN (SELECT avg(efficiency) AS e, stddev_samp(efficiency) AS s, avg(SetupTime) AS st, avg(PartsProduced) AS pp FROM F)
  LEFT JOIN (SELECT machine AS k, avg(efficiency) AS machine_baseline_efficiency, sum(RunningTime) / (sum(RunningTime) + sum(total_downtime)) AS machine_utilization_rate,
    avg(MaintenanceTime) AS machine_maintenance_frequency, count(DISTINCT PartNumber) AS machine_part_diversity FROM F GROUP BY machine) m ON m.k = F.machine
  LEFT JOIN (SELECT OperatorName AS ko, avg(efficiency) FILTER (WHERE OperatorName <> 'Unknown') AS oe, stddev_samp(efficiency) FILTER (WHERE OperatorName <> 'Unknown') AS os,
    avg(SetupTime) FILTER (WHERE OperatorName <> 'Unknown') AS ot, count(DISTINCT machine) AS operator_versatility FROM F GROUP BY OperatorName) ON ko = F.OperatorName
  LEFT JOIN (SELECT PartNumber AS kp, avg(SetupTime) FILTER (WHERE PartNumber <> 'Unknown') AS pt, avg(PartsProduced) FILTER (WHERE PartNumber <> 'Unknown') AS pb,
    count(*) AS part_production_frequency, avg(PartsProduced) AS pe FROM F GROUP BY PartNumber) ON kp = F.PartNumber
  LEFT JOIN (SELECT machine AS fm, PartNumber AS fp, avg(efficiency) AS fit FROM F GROUP BY ALL) ON fm = F.machine AND fp = F.PartNumber
  LEFT JOIN (SELECT hour(StartTime) AS kh, avg(efficiency) AS expected_hourly_efficiency FROM F GROUP BY ALL) ON kh = hour(F.StartTime)
  LEFT JOIN (SELECT isodow(StartTime) AS kd, avg(efficiency) AS expected_daily_efficiency FROM F GROUP BY ALL) ON kd = isodow(F.StartTime)
  LEFT JOIN (SELECT machine AS lm, CAST(StartTime AS DATE) AS ld, count(*) AS daily_job_count, count(DISTINCT OperatorName) AS machine_operator_pressure FROM F GROUP BY ALL)
    ON lm = F.machine AND ld = CAST(F.StartTime AS DATE))"""))
def fea1(spark, d):
    return FE.group_efficiency_features(F(spark, d)).select("JobNumber", "StartTime", *FE.GROUP_FEATURES)


@query("drv21_day_sequence", sql("""
SELECT JobNumber, StartTime, jobs_today, CAST(jobs_today = 1 AS BIGINT) AS first_job_of_day FROM (
  SELECT *, row_number() OVER (PARTITION BY machine, OperatorName, CAST(StartTime AS DATE) ORDER BY StartTime, JobNumber) AS jobs_today FROM F)"""))
def drv21(spark, d):
    return FE.day_sequence(F(spark, d)).select("JobNumber", "StartTime", "jobs_today", "first_job_of_day")


_GIVEN = [c for c in DOWNTIME if c != "SetupTime"]


@query("drv22_column_defaults", sql(f"""
SELECT JobNumber, StartTime, {r6(' + '.join(f'coalesce({c}, 0.0E0)' for c in _GIVEN))} AS total_downtime,
  {r6('least(greatest(CASE WHEN JobDuration = 0 THEN 0.0E0 ELSE RunningTime / JobDuration END, 0.0E0), 1.0E0)')} AS efficiency,
  1.0E0 AS "PartsProduced", 600.0E0 AS "SetupTime" FROM clean""", "clean"))
def drv22(spark, d):
    """The cleaned log without parts and setup times."""
    lacking = C(spark, d).drop("PartsProduced", "SetupTime", "total_downtime", "efficiency")
    return FE.column_defaults(lacking).select("JobNumber", "StartTime", "total_downtime", "efficiency", "PartsProduced", "SetupTime")


_HIST_JOIN = """F LEFT JOIN (SELECT machine AS km, avg(efficiency) AS machine_hist_efficiency, stddev_samp(efficiency) AS machine_hist_efficiency_std, avg(JobDuration) AS machine_hist_duration,
    avg(SetupTime) AS machine_hist_setup, avg(total_downtime) AS machine_hist_downtime FROM F GROUP BY machine) ON km = machine
  LEFT JOIN (SELECT OperatorName AS ko, avg(efficiency) AS operator_hist_efficiency, stddev_samp(efficiency) AS operator_hist_efficiency_std, avg(SetupTime) AS operator_hist_setup,
    count(DISTINCT machine) AS operator_machines, count(DISTINCT PartNumber) AS operator_parts FROM F GROUP BY OperatorName) ON ko = OperatorName"""
_HIST = ", ".join(f"""{r6(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM h))")} AS {c}""" for c in FE.HISTORY)


@query("fea4_history_features", sql(f"SELECT JobNumber, StartTime, {_HIST}, operator_machines, operator_parts FROM h", "F", f"h AS MATERIALIZED (SELECT * FROM {_HIST_JOIN})"))
def fea4(spark, d):
    return FE.history_features(F(spark, d)).select("JobNumber", "StartTime", *FE.HISTORY, "operator_machines", "operator_parts")


_FILL = ["SetupTime", "JobDuration", "PartsProduced", "holes"]
_MODES = ["shift", "OperatorName", "gaps"]
_HOLES = """holed AS MATERIALIZED (SELECT JobNumber, StartTime, SetupTime, JobDuration, PartsProduced, shift, OperatorName,
  CASE WHEN hour(StartTime) % 3 = 0 THEN NULL ELSE RunningTime END AS holes, CASE WHEN hour(StartTime) % 4 = 1 THEN NULL ELSE machine END AS gaps FROM F)"""


@query("fea9_imputed", sql("SELECT JobNumber, StartTime, " + ", ".join(
    [f"""{r6(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM holed), 0.0)")} AS {c}""" for c in _FILL]
    + [f"coalesce({c}, (SELECT {c} FROM holed WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}" for c in _MODES]) + " FROM holed", "F", _HOLES))
def fea9(spark, d):
    """Medians and modes filled in on columns with holes (the hour of the job decides where)."""
    hour = F_.hour("StartTime")
    holed = F(spark, d).withColumns({"holes": F_.when(hour % 3 != 0, F_.col("RunningTime")), "gaps": F_.when(hour % 4 != 1, F_.col("machine"))})
    return FE.impute(holed, _FILL, _MODES).select("JobNumber", "StartTime", *_FILL, *_MODES)
