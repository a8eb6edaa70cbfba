"""Registered source, cleaning and derivation queries (SRC*, CLN*, DRV*, FUN1)."""

from __future__ import annotations

from pyspark.sql import functions as F_

from ..operators import clean as CL
from ..operators import derive as DV
from ..schema import DOWNTIME, DURATIONS
from ..sources import joblog as SR
from .oracle import (CLEAN_DOUBLES, F_DOUBLES, F_INTS, RAW_DOUBLES, ROLLING_DOUBLES, r6, sql, star)
from .registry import query
from .tables import C, F, J

JOB_COLS = ["JobNumber", "machine", "OperatorName", "PartNumber", "EmpID", "State", "OpNumber", "StartTime",
            "RunningTime", "PartsProduced"] + DOWNTIME + ["JobDuration", "EndTime"]

# ----------------------------------------------------------------------------------------- sources


@query("src1_full_scan", sql(star("joblog", RAW_DOUBLES), "joblog"))
def src1(spark, d):
    return SR.all_data(J(spark, d))


SRC2_COLS = ["JobNumber", "machine", "OperatorName", "StartTime", "JobDuration", "RunningTime"]


@query("src2_date_range", sql(f"""
SELECT JobNumber, machine, OperatorName, StartTime, {r6('JobDuration')} AS JobDuration, {r6('RunningTime')} AS RunningTime
FROM joblog WHERE StartTime BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-06-30 23:59:59'
  AND year(StartTime) > 1970 ORDER BY StartTime""", "joblog"))
def src2(spark, d):
    return SR.date_range(J(spark, d), "1995-01-01 00:00:00", "1996-06-30 23:59:59", SRC2_COLS)


@query("src3_machine_scan", sql(star("joblog WHERE machine = 'M3'", RAW_DOUBLES), "joblog"))
def src3(spark, d):
    return SR.machine_data(J(spark, d), "M3")


@query("src4_operator_scan", sql(star("joblog WHERE OperatorName = 'OP7'", RAW_DOUBLES), "joblog"))
def src4(spark, d):
    return SR.operator_data(J(spark, d), "OP7")


@query("src5_parameterized_sql", sql("""
SELECT machine, count(*) AS jobs, sum(RunningTime) AS running FROM joblog
WHERE JobDuration > 3600 AND State = 'F' GROUP BY machine""", "joblog"))
def src5(spark, d):
    return SR.run_sql(
        spark,
        "SELECT machine, count(*) AS jobs, sum(RunningTime) AS running FROM {joblog} "
        "WHERE JobDuration > :min_dur AND State = :state GROUP BY machine",
        {"min_dur": 3600, "state": "F"}, joblog=J(spark, d))


_NONNEG = " AND ".join(f"{c} >= 0" for c in DURATIONS)


@query("src7_clean_strict", sql(star(f"""joblog WHERE year(StartTime) > 1970 AND {_NONNEG}
  AND IdleTime <= 86400 AND JobDuration > 0""", RAW_DOUBLES), "joblog"))
def src7(spark, d):
    return SR.clean_data(J(spark, d))


@query("src8_dict_filters", sql(star("joblog WHERE machine IN ('M1', 'M2', 'M5') AND State = 'F'", RAW_DOUBLES),
                                "joblog"))
def src8(spark, d):
    return SR.apply_filters(J(spark, d), {"machine": ["M1", "M2", "M5"], "State": "F", "no_such_column": 1})


@query("fun1_performance_projection", sql(f"""
SELECT machine, OperatorName, PartNumber, StartTime, EndTime, JobDuration, RunningTime, PartsProduced,
  {', '.join(DOWNTIME)},
  {r6('CASE WHEN JobDuration > 0 THEN RunningTime / JobDuration ELSE 0.0E0 END')} AS efficiency,
  {r6('CASE WHEN RunningTime > 0 AND PartsProduced > 0 THEN PartsProduced / (RunningTime / 3600.0) ELSE 0.0E0 END')} AS parts_per_hour
FROM joblog WHERE JobDuration > 0 AND year(StartTime) > 1970 ORDER BY StartTime DESC""", "joblog"))
def fun1(spark, d):
    return DV.performance_projection(J(spark, d))


# ----------------------------------------------------------------------------------------- cleaning


@query("cln8_clean", sql(star("clean", CLEAN_DOUBLES), "clean"))
def cln8(spark, d):
    return C(spark, d)


@query("cln2_duration_mismatch", sql("""
SELECT count(CASE WHEN abs(datesub('second', StartTime, EndTime) - JobDuration) > 300 THEN 1 END) AS mismatched_rows,
  count(*) AS checked_rows
FROM joblog WHERE StartTime IS NOT NULL AND EndTime IS NOT NULL AND year(StartTime) <> 1969 AND year(EndTime) <> 1969""",
                                     "joblog"))
def cln2(spark, d):
    return CL.duration_mismatch_count(J(spark, d))


@query("cln9_valid_datetime", sql("""
SELECT JobNumber, StartTime, coalesce(year(StartTime) > 1970, false) AS is_valid FROM joblog""", "joblog"))
def cln9(spark, d):
    j = J(spark, d)
    return j.select("JobNumber", "StartTime", CL.valid_datetime("StartTime").alias("is_valid"))


_J_COLS = ["JobNumber", "machine", "OperatorName", "PartNumber", "EmpID", "State", "OpNumber", "StartTime",
           "RunningTime", "PartsProduced"] + DOWNTIME + ["JobDuration", "EndTime"]
_IQR = ["JobDuration", "RunningTime", "PartsProduced"]


def _quality_sql() -> str:
    parts = ["SELECT 'total_records' AS \"check\", '' AS \"column\", count(*) AS value FROM joblog"]
    parts += [f"SELECT 'missing', '{c}', count(*) FILTER (WHERE {c} IS NULL) FROM joblog" for c in _J_COLS]
    parts += [f"SELECT 'negative', '{c}', count(*) FILTER (WHERE {c} < 0) FROM joblog" for c in DURATIONS]
    parts.append("SELECT 'invalid_dates', '', count(*) FILTER (WHERE year(StartTime) = 1969) FROM joblog")
    for c in _IQR:
        parts.append(f"""SELECT 'outliers', '{c}', count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))
FROM joblog, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM joblog)""")
    parts.append("SELECT 'duplicate_records', '', (SELECT count(*) FROM joblog) - (SELECT count(*) FROM (SELECT DISTINCT * FROM joblog))")
    body = "\nUNION ALL ".join(parts)
    return sql(f"SELECT * FROM ({body}) WHERE NOT (\"check\" = 'negative' AND value = 0)", "joblog")


@query("cln10_quality_report", _quality_sql())
def cln10(spark, d):
    return CL.quality_report(J(spark, d))


@query("cln11_outlier_iqr", sql("""
SELECT JobNumber, StartTime, JobDuration,
  coalesce(JobDuration < q1 - 1.5 * (q3 - q1) OR JobDuration > q3 + 1.5 * (q3 - q1), false) AS JobDuration_outlier
FROM clean, (SELECT quantile_cont(JobDuration, 0.25) AS q1, quantile_cont(JobDuration, 0.75) AS q3 FROM clean)""",
                                "clean"))
def cln11_iqr(spark, d):
    return CL.outlier_flag(C(spark, d), "JobDuration", "iqr").select(
        "JobNumber", "StartTime", "JobDuration", "JobDuration_outlier")


@query("cln11_outlier_zscore", sql("""
SELECT JobNumber, StartTime, SetupTime,
  coalesce(abs((SetupTime - m) / s) > 3, false) AS SetupTime_outlier
FROM clean, (SELECT avg(SetupTime) AS m, stddev_samp(SetupTime) AS s FROM clean)""", "clean"))
def cln11_z(spark, d):
    return CL.outlier_flag(C(spark, d), "SetupTime", "zscore", 3.0).select(
        "JobNumber", "StartTime", "SetupTime", "SetupTime_outlier")


def _missing_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_count, count(*) AS n FROM joblog"
             for c in _J_COLS]
    return sql(f"""SELECT "column", missing_count, {r6('missing_count * 100.0 / n')} AS missing_percent
FROM ({' UNION ALL '.join(parts)}) WHERE missing_count > 0""", "joblog")


@query("cln12_missing_profile", _missing_sql())
def cln12(spark, d):
    return CL.missing_profile(J(spark, d))


def job_requests(spark, d):
    """A table of job requests derived from the log (one per job), for validation and scoring."""
    j = J(spark, d)
    return j.select(
        F_.col("JobNumber").alias("job_id"),
        F_.concat(F_.lit(" "), F_.lower("machine"), F_.lit(" ")).alias("machine"),
        F_.col("PartNumber").alias("part"),
        F_.col("OperatorName").alias("operator"),
        (F_.col("RunningTime") / 60.0 - 10.0).alias("planned_cycle_time"),
        F_.col("PartsProduced").cast("int").alias("quantity"),
        (F_.col("NotFeedingTime") / 60.0).alias("setup_time"),
        (F_.col("OpNumber") * 2).cast("double").alias("complexity_score"),
        F_.when(F_.col("OpNumber") == 7, "cost").when(F_.col("OpNumber") == 6, "duration").when(F_.col("OpNumber") == 5, "all")
        .when(F_.col("OpNumber") == 4, "both").otherwise("efficiency").alias("prediction_type"),
    )


_REQ_SQL = """requests AS (
SELECT JobNumber AS job_id, concat(' ', lower(machine), ' ') AS machine, PartNumber AS part, OperatorName AS operator,
  RunningTime / 60.0 - 10.0 AS planned_cycle_time, CAST(PartsProduced AS INTEGER) AS quantity,
  NotFeedingTime / 60.0 AS setup_time, CAST(OpNumber * 2 AS DOUBLE) AS complexity_score,
  CASE WHEN OpNumber = 7 THEN 'cost' WHEN OpNumber = 6 THEN 'duration' WHEN OpNumber = 5 THEN 'all' WHEN OpNumber = 4 THEN 'both' ELSE 'efficiency' END AS prediction_type
FROM joblog)"""


@query("cln13_request_validation", sql("""
SELECT job_id, upper(trim(machine)) AS machine, upper(trim(part)) AS part, errors = '' AS is_valid, errors FROM (
SELECT *, array_to_string(list_filter([
    CASE WHEN coalesce(length(upper(trim(machine))), 0) = 0 THEN 'machine must not be empty' END,
    CASE WHEN coalesce(length(upper(trim(part))), 0) = 0 THEN 'part must not be empty' END,
    CASE WHEN NOT coalesce(planned_cycle_time > 0, false) THEN 'planned_cycle_time must be > 0' END,
    CASE WHEN NOT coalesce(quantity > 0, false) THEN 'quantity must be > 0' END,
    CASE WHEN setup_time < 0 THEN 'setup_time must be >= 0' END,
    CASE WHEN complexity_score < 1 OR complexity_score > 10 THEN 'complexity_score must be in 1..10' END,
    CASE WHEN NOT prediction_type IN ('efficiency', 'downtime', 'both') THEN 'unknown prediction_type' END
  ], lambda x: x IS NOT NULL), '; ') AS errors
FROM requests) r""", "joblog", _REQ_SQL))
def cln13(spark, d):
    v = CL.validate_requests(job_requests(spark, d))
    return v.select("job_id", "machine", "part", "is_valid", F_.array_join("errors", "; ").alias("errors"))


# ----------------------------------------------------------------------------------------- derivation


@query("drv12_derived_table", sql(star("derived", F_DOUBLES + ROLLING_DOUBLES, F_INTS), "derived"))
def drv12(spark, d):
    return F(spark, d, rolling=True)


@query("drv13_efficiency_scalar", sql(f"""
SELECT JobNumber, StartTime, {r6('CASE WHEN JobDuration <= 0 THEN 0.0E0 WHEN RunningTime / JobDuration > 1 THEN 1.0E0 ELSE RunningTime / JobDuration END')} AS efficiency
FROM joblog""", "joblog"))
def drv13(spark, d):
    return J(spark, d).select("JobNumber", "StartTime", DV.efficiency_scalar("RunningTime", "JobDuration").alias("efficiency"))


@query("drv15_notebook_features", sql(f"""
SELECT JobNumber, StartTime, {r6('RunningTime / (RunningTime + SetupTime + 1)')} AS productive_time_ratio,
  {r6('total_downtime / (JobDuration + 1)')} AS downtime_intensity, {r6('1 / (SetupTime / 1000 + 1)')} AS setup_efficiency,
  {r6('PartsProduced * 60 / (RunningTime + 1)')} AS parts_per_minute,
  CAST(CASE WHEN hour IN (8, 9, 10, 14, 15, 16) THEN 1 ELSE 0 END AS BIGINT) AS is_rush_hour,
  CAST(CASE WHEN hour IN (6, 14, 22) THEN 1 ELSE 0 END AS BIGINT) AS shift_start,
  CAST(CASE WHEN hour IN (13, 21, 5) THEN 1 ELSE 0 END AS BIGINT) AS shift_end,
  CASE WHEN day_of_week <= 1 THEN 'start' WHEN day_of_week <= 3 THEN 'middle' ELSE 'end' END AS week_position,
  CAST(CASE WHEN day_of_week < 5 THEN 1 ELSE 0 END AS BIGINT) AS production_day
FROM F"""))
def drv15(spark, d):
    f = F(spark, d).transform(DV.notebook_ratios).transform(DV.notebook_time_flags)
    return f.select("JobNumber", "StartTime", "productive_time_ratio", "downtime_intensity", "setup_efficiency",
                    "parts_per_minute", "is_rush_hour", "shift_start", "shift_end", "week_position", "production_day")


@query("drv17_regression_time_features", sql("""
SELECT JobNumber, StartTime, CAST((hour(StartTime) - 6 + 24) % 24 AS BIGINT) AS hour_in_shift,
  CAST(minute(StartTime) AS BIGINT) AS minutes_in_hour,
  CAST(CASE WHEN isodow(StartTime) = 1 THEN 1 ELSE 0 END AS BIGINT) AS is_monday,
  CAST(CASE WHEN isodow(StartTime) = 5 THEN 1 ELSE 0 END AS BIGINT) AS is_friday,
  CAST(day(last_day(StartTime)) - day(StartTime) AS BIGINT) AS days_until_month_end,
  CAST(CASE WHEN day(last_day(StartTime)) - day(StartTime) <= 3 THEN 1 ELSE 0 END AS BIGINT) AS is_month_end
FROM clean""", "clean"))
def drv17(spark, d):
    return DV.regression_time_features(C(spark, d)).select(
        "JobNumber", "StartTime", "hour_in_shift", "minutes_in_hour", "is_monday", "is_friday",
        "days_until_month_end", "is_month_end")


@query("drv18_anomaly_ratios", sql(f"""
SELECT JobNumber, StartTime, {', '.join(f"{r6(f'{c} / JobDuration')} AS {c}_ratio" for c in DOWNTIME)},
  {r6('CASE WHEN RunningTime = 0 AND PartsProduced <> 0 THEN 0.0E0 WHEN RunningTime = 0 THEN NULL ELSE PartsProduced / (RunningTime / 3600.0) END')} AS parts_per_hour
FROM clean""", "clean"))
def drv18(spark, d):
    return DV.anomaly_ratios(C(spark, d)).select(
        "JobNumber", "StartTime", *[f"{c}_ratio" for c in DOWNTIME], "parts_per_hour")


def _argmax_sql(no_downtime: bool) -> str:
    g = "greatest(" + ", ".join(DOWNTIME) + ")"
    e = "CASE " + " ".join(f"WHEN {c} = {g} THEN '{c}'" for c in DOWNTIME) + " END"
    if no_downtime:
        e = f"CASE WHEN {' + '.join(DOWNTIME)} = 0 THEN 'NoDowntime' ELSE {e} END"
    return e


@query("drv23_dominant_downtime", sql(f"""
SELECT JobNumber, StartTime, {_argmax_sql(True)} AS dominant_downtime, {_argmax_sql(False)} AS dominant_category
FROM clean""", "clean"))
def drv23(spark, d):
    c = DV.dominant_downtime(C(spark, d), "dominant_downtime", True)
    c = DV.dominant_downtime(c, "dominant_category", False)
    return c.select("JobNumber", "StartTime", "dominant_downtime", "dominant_category")


@query("drv24_readable_duration", sql("""
SELECT JobNumber, StartTime, CASE WHEN d < 60 THEN format('{}s', d)
  WHEN d < 3600 THEN format('{}m {}s', d // 60, d % 60)
  ELSE format('{}h {}m', d // 3600, (d % 3600) // 60) END AS JobDuration_readable
FROM (SELECT JobNumber, StartTime, CAST(JobDuration AS BIGINT) AS d FROM clean)""", "clean"))
def drv24(spark, d):
    return DV.readable_seconds(C(spark, d), "JobDuration").select("JobNumber", "StartTime", "JobDuration_readable")


@query("drv25_risk_buckets", sql(f"""
SELECT JobNumber, StartTime, CASE WHEN 1 - efficiency > 0.7 THEN 'HIGH' WHEN 1 - efficiency > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  (1 - efficiency) > 0.5 AS maintenance_recommended,
  {r6('CASE WHEN efficiency = 0 THEN NULL ELSE (RunningTime / 60.0) / efficiency END')} AS expected_completion_minutes
FROM F"""))
def drv25(spark, d):
    f = F(spark, d)
    risk = 1 - F_.col("efficiency")
    return f.select("JobNumber", "StartTime", DV.risk_bucket(risk).alias("risk_level"),
                    (risk > 0.5).alias("maintenance_recommended"),
                    F_.try_divide(F_.col("RunningTime") / 60.0, F_.col("efficiency")).alias("expected_completion_minutes"))


@query("drv19_extreme_flags", sql("""
SELECT JobNumber, StartTime,
  CAST(efficiency > e95 AS BIGINT) AS efficiency_extreme_high, CAST(efficiency < e05 AS BIGINT) AS efficiency_extreme_low,
  CAST(JobDuration > d95 * 2 AS BIGINT) AS duration_extreme_long, CAST(JobDuration < d05 / 2 AS BIGINT) AS duration_extreme_short,
  CAST(total_downtime > t95 * 2 AS BIGINT) AS downtime_extreme_high
FROM F, (SELECT quantile_cont(efficiency, 0.95) AS e95, quantile_cont(efficiency, 0.05) AS e05,
  quantile_cont(JobDuration, 0.95) AS d95, quantile_cont(JobDuration, 0.05) AS d05,
  quantile_cont(total_downtime, 0.95) AS t95 FROM F)"""))
def drv19(spark, d):
    return DV.extreme_flags(F(spark, d)).select(
        "JobNumber", "StartTime", "efficiency_extreme_high", "efficiency_extreme_low", "duration_extreme_long",
        "duration_extreme_short", "downtime_extreme_high")


_W5 = "OVER (PARTITION BY machine ORDER BY StartTime, JobNumber ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("drv20_quality_indicators", sql(f"""
SELECT JobNumber, StartTime, {r6('c')} AS efficiency_consistency, {r6('1 / (1 + c)')} AS stability_score,
  {r6('abs(efficiency - mm) / (ms + 0.01)')} AS performance_deviation,
  CAST(coalesce(CAST(datesub('second', prev, StartTime) AS DOUBLE), 0.0) < 300 AS BIGINT) AS rush_job
FROM (SELECT F.*, coalesce(CASE WHEN count(efficiency) {_W5} >= 2 THEN stddev_samp(efficiency) {_W5} END, 0.0E0) AS c,
  lag(StartTime) OVER (PARTITION BY machine ORDER BY StartTime, JobNumber) AS prev, m.mm, m.ms
  FROM F LEFT JOIN (SELECT machine AS k, avg(efficiency) AS mm, stddev_samp(efficiency) AS ms FROM F GROUP BY machine) m
  ON F.machine = m.k)"""))
def drv20(spark, d):
    return DV.quality_indicators(F(spark, d)).select(
        "JobNumber", "StartTime", "efficiency_consistency", "stability_score", "performance_deviation", "rush_job")
