"""Registered aggregate queries (AGG*) with their DuckDB oracles."""

from __future__ import annotations

from ..operators import summaries as S
from ..schema import DOWNTIME
from .oracle import avg_rank_desc, cap1, perf, r6, rel_cons, rn, sql
from .registry import query
from .tables import F, J


def _r(expr: str, d: int) -> str:
    return rn(expr, d)


AGG3_SQL = sql(f"""
SELECT machine, total_jobs, avg_job_duration, job_duration_std, avg_running_time, total_running_time,
  avg_efficiency, efficiency_std, min_efficiency, max_efficiency, total_parts, avg_parts_per_job,
  avg_parts_per_hour, parts_per_hour_std, avg_downtime_per_job, total_downtime, avg_setup_time,
  total_setup_time, avg_maintenance_time, total_maintenance_time, avg_idle_time, total_idle_time,
  {r6('utilization_rate')} AS utilization_rate,
  {avg_rank_desc('avg_efficiency')} AS efficiency_rank,
  {avg_rank_desc('avg_parts_per_hour')} AS productivity_rank,
  {r6(perf('avg_efficiency', cap1('utilization_rate'), rel_cons('efficiency_std', 'avg_efficiency')))} AS performance_score
FROM (
  SELECT *, CASE WHEN total_running_time + total_downtime = 0 THEN 0.0E0
                 ELSE total_running_time / (total_running_time + total_downtime) END AS utilization_rate
  FROM (
    SELECT machine, count(JobDuration) AS total_jobs,
      {_r('avg(JobDuration)', 2)} AS avg_job_duration, {_r('stddev_samp(JobDuration)', 2)} AS job_duration_std,
      {_r('avg(RunningTime)', 2)} AS avg_running_time, {_r('sum(RunningTime)', 2)} AS total_running_time,
      {_r('avg(efficiency)', 2)} AS avg_efficiency, {_r('stddev_samp(efficiency)', 2)} AS efficiency_std,
      {_r('min(efficiency)', 2)} AS min_efficiency, {_r('max(efficiency)', 2)} AS max_efficiency,
      {_r('sum(PartsProduced)', 2)} AS total_parts, {_r('avg(PartsProduced)', 2)} AS avg_parts_per_job,
      {_r('avg(parts_per_hour)', 2)} AS avg_parts_per_hour, {_r('stddev_samp(parts_per_hour)', 2)} AS parts_per_hour_std,
      {_r('avg(total_downtime)', 2)} AS avg_downtime_per_job, {_r('sum(total_downtime)', 2)} AS total_downtime,
      {_r('avg(SetupTime)', 2)} AS avg_setup_time, {_r('sum(SetupTime)', 2)} AS total_setup_time,
      {_r('avg(MaintenanceTime)', 2)} AS avg_maintenance_time, {_r('sum(MaintenanceTime)', 2)} AS total_maintenance_time,
      {_r('avg(IdleTime)', 2)} AS avg_idle_time, {_r('sum(IdleTime)', 2)} AS total_idle_time
    FROM F GROUP BY machine
  ) a
) b""")


@query("agg3_machine_summary", AGG3_SQL)
def agg3(spark, d):
    return S.machine_summary(F(spark, d))


@query("agg1_summary_stats", sql("""
SELECT count(*) AS total_records, count(DISTINCT machine) AS unique_machines,
  count(DISTINCT OperatorName) AS unique_operators, count(DISTINCT PartNumber) AS unique_parts,
  min(CASE WHEN year(StartTime) > 1970 THEN StartTime END) AS min_date,
  max(CASE WHEN year(StartTime) > 1970 THEN StartTime END) AS max_date
FROM joblog""", "joblog"))
def agg1(spark, d):
    return S.summary_stats(J(spark, d))


@query("agg1_job_states", sql('SELECT State, count(*) AS "count" FROM joblog GROUP BY State', "joblog"))
def agg1_states(spark, d):
    return S.job_states(J(spark, d))


_DT_SUM = " + ".join(["SetupTime", "WaitingSetupTime", "NotFeedingTime", "AdjustmentTime", "DressingTime",
                      "ToolingTime", "EngineeringTime", "MaintenanceTime", "BuyInTime", "BreakShiftChangeTime",
                      "IdleTime"])


@query("agg2_downtime_analysis", sql(f"""
SELECT * FROM (
SELECT machine, OperatorName, PartNumber, CAST(StartTime AS DATE) AS job_date, count(*) AS job_count,
  {r6('avg(JobDuration)')} AS avg_job_duration, {r6('avg(RunningTime)')} AS avg_running_time,
  {r6('avg(SetupTime)')} AS avg_setup_time, {r6('avg(MaintenanceTime)')} AS avg_maintenance_time,
  {r6('avg(IdleTime)')} AS avg_idle_time, sum({_DT_SUM}) AS total_downtime
FROM joblog WHERE year(StartTime) > 1970
GROUP BY machine, OperatorName, PartNumber, CAST(StartTime AS DATE)
) WHERE total_downtime > 0
ORDER BY job_date DESC, total_downtime DESC""", "joblog"))
def agg2(spark, d):
    return S.downtime_analysis(J(spark, d))


def _aggs(spec: list[tuple[str, str]], d: int | None) -> str:
    return ", ".join(f"{rn(e, d) if d is not None else e} AS {n}" for n, e in spec)


def _sd(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN 0.0E0 ELSE ({n}) / ({d}) END)"


AGG4_SQL = sql(f"""
SELECT OperatorName, total_jobs, machines_operated, unique_parts, avg_job_duration, avg_efficiency, efficiency_std,
  min_efficiency, max_efficiency, total_parts, avg_parts_per_job, avg_parts_per_hour, parts_per_hour_std,
  avg_setup_time, total_setup_time, avg_downtime_per_job, total_downtime, first_job_date, last_job_date,
  experience_days, {r6('jobs_per_day')} AS jobs_per_day, versatility_score, {r6('consistency_score')} AS consistency_score,
  {avg_rank_desc('avg_efficiency')} AS efficiency_rank,
  {avg_rank_desc('avg_parts_per_hour')} AS productivity_rank,
  {avg_rank_desc('versatility_score')} AS versatility_rank,
  {r6(perf('avg_efficiency', cap1('consistency_score'), 'consistency_score'))} AS performance_score
FROM (
  SELECT *, {_sd('total_jobs', 'experience_days + 1')} AS jobs_per_day,
    machines_operated * unique_parts AS versatility_score,
    {rel_cons('efficiency_std', 'avg_efficiency')} AS consistency_score
  FROM (
    SELECT OperatorName, count(JobDuration) AS total_jobs, count(DISTINCT machine) AS machines_operated,
      count(DISTINCT PartNumber) AS unique_parts,
      {_aggs([('avg_job_duration', 'avg(JobDuration)'), ('avg_efficiency', 'avg(efficiency)'),
              ('efficiency_std', 'stddev_samp(efficiency)'), ('min_efficiency', 'min(efficiency)'),
              ('max_efficiency', 'max(efficiency)'), ('total_parts', 'sum(PartsProduced)'),
              ('avg_parts_per_job', 'avg(PartsProduced)'), ('avg_parts_per_hour', 'avg(parts_per_hour)'),
              ('parts_per_hour_std', 'stddev_samp(parts_per_hour)'), ('avg_setup_time', 'avg(SetupTime)'),
              ('total_setup_time', 'sum(SetupTime)'), ('avg_downtime_per_job', 'avg(total_downtime)'),
              ('total_downtime', 'sum(total_downtime)')], 2)},
      min(StartTime) AS first_job_date, max(StartTime) AS last_job_date,
      datesub('day', min(StartTime), max(StartTime)) AS experience_days
    FROM F WHERE OperatorName <> 'Unknown' GROUP BY OperatorName
  ) a
) b""")


@query("agg4_operator_summary", AGG4_SQL)
def agg4(spark, d):
    return S.operator_summary(F(spark, d))


AGG5_SQL = sql(f"""
SELECT *, {r6(perf('avg_efficiency', '1.0E0', rel_cons('efficiency_std', 'avg_efficiency')))} AS proficiency_score,
  CASE WHEN job_count > 0 AND job_count <= 5 THEN 'Low' WHEN job_count > 5 AND job_count <= 15 THEN 'Medium'
       WHEN job_count > 15 AND job_count <= 50 THEN 'High' WHEN job_count > 50 THEN 'Very High' END AS confidence_level
FROM (
  SELECT OperatorName, machine, count(JobDuration) AS job_count,
    {_aggs([('avg_efficiency', 'avg(efficiency)'), ('efficiency_std', 'stddev_samp(efficiency)'),
            ('avg_parts_per_hour', 'avg(parts_per_hour)'), ('avg_setup_time', 'avg(SetupTime)'),
            ('avg_downtime', 'avg(total_downtime)')], 3)}
  FROM F WHERE OperatorName <> 'Unknown' GROUP BY OperatorName, machine
) a""")


@query("agg5_operator_machine_summary", AGG5_SQL)
def agg5(spark, d):
    return S.operator_machine_summary(F(spark, d))


AGG6_SQL = sql(f"""
SELECT *, {r6(perf('avg_efficiency', cap1('avg_parts_per_hour / 10'), rel_cons('efficiency_std', 'avg_efficiency')))} AS specialization_score
FROM (
  SELECT OperatorName, PartNumber, count(JobDuration) AS job_count,
    {_aggs([('avg_efficiency', 'avg(efficiency)'), ('efficiency_std', 'stddev_samp(efficiency)'),
            ('avg_parts_per_hour', 'avg(parts_per_hour)'), ('avg_setup_time', 'avg(SetupTime)'),
            ('avg_parts_per_job', 'avg(PartsProduced)')], 3)}
  FROM F WHERE OperatorName <> 'Unknown' AND PartNumber <> 'Unknown' GROUP BY OperatorName, PartNumber
) a""")


@query("agg6_operator_part_summary", AGG6_SQL)
def agg6(spark, d):
    return S.operator_part_summary(F(spark, d))


AGG7_SQL = sql(f"""
SELECT d.*, {r6('m.machine_avg_efficiency')} AS machine_avg_efficiency,
  {r6(_sd('total_running_time', 'total_running_time + total_downtime'))} AS utilization_rate,
  {r6('avg_efficiency / m.machine_avg_efficiency')} AS efficiency_vs_avg
FROM (
  SELECT CAST(StartTime AS DATE) AS job_date, machine, count(JobDuration) AS job_count,
    {_aggs([('total_job_duration', 'sum(JobDuration)'), ('total_running_time', 'sum(RunningTime)'),
            ('total_downtime', 'sum(total_downtime)'), ('total_parts', 'sum(PartsProduced)'),
            ('avg_efficiency', 'avg(efficiency)')], 2)}
  FROM F GROUP BY CAST(StartTime AS DATE), machine
) d LEFT JOIN (SELECT machine AS m_machine, avg(efficiency) AS machine_avg_efficiency FROM F GROUP BY machine) m
  ON d.machine = m.m_machine""")


@query("agg7_daily_utilization", AGG7_SQL)
def agg7(spark, d):
    return S.daily_utilization(F(spark, d))


def _trend_sql(key: str, metrics: list[str], where: str = "") -> str:
    avgs = ", ".join(f"avg({m}) AS {m}" for m in metrics)
    outs = ", ".join(
        f"{r6(m)} AS {m}, {r6(f'avg({m}) OVER (PARTITION BY {key} ORDER BY job_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS {m}_trend"
        for m in metrics)
    return sql(f"""
SELECT {key}, job_date, {outs}
FROM (SELECT {key}, CAST(StartTime AS DATE) AS job_date, {avgs} FROM F {where} GROUP BY {key}, CAST(StartTime AS DATE)) a""")


@query("win3_machine_trends", _trend_sql("machine", ["efficiency", "parts_per_hour", "total_downtime"]))
def win3(spark, d):
    return S.machine_trends(F(spark, d))


@query("win4_operator_trends", _trend_sql("OperatorName", ["efficiency", "parts_per_hour", "SetupTime"],
                                          "WHERE OperatorName <> 'Unknown'"))
def win4(spark, d):
    return S.operator_trends(F(spark, d))


@query("agg12_sql_machine_summary", sql(f"""
SELECT machine, count(*) AS total_jobs,
  {r6('avg(CASE WHEN JobDuration > 0 THEN RunningTime / JobDuration ELSE 0.0E0 END)')} AS avg_efficiency,
  {r6('avg(JobDuration)')} AS avg_job_duration, sum(PartsProduced) AS total_parts_produced,
  {r6("avg(CASE WHEN RunningTime / 3600.0 = 0 THEN NULL ELSE PartsProduced / (RunningTime / 3600.0) END)")} AS avg_parts_per_hour
FROM joblog WHERE JobDuration > 0 AND year(StartTime) > 1970 GROUP BY machine""", "joblog"))
def agg12(spark, d):
    return S.sql_machine_summary(J(spark, d))


@query("agg13_sql_operator_summary", sql(f"""
SELECT OperatorName, count(*) AS total_jobs, count(DISTINCT machine) AS machines_operated,
  {r6('avg(CASE WHEN JobDuration > 0 THEN RunningTime / JobDuration ELSE 0.0E0 END)')} AS avg_efficiency,
  {r6('avg(SetupTime)')} AS avg_setup_time, sum(PartsProduced) AS total_parts_produced
FROM joblog WHERE OperatorName IS NOT NULL AND JobDuration > 0 AND year(StartTime) > 1970
GROUP BY OperatorName""", "joblog"))
def agg13(spark, d):
    return S.sql_operator_summary(J(spark, d))


@query("agg16_efficiency_factors", sql(f"""
SELECT 'machine' AS factor, CAST(machine AS VARCHAR) AS key, {r6('avg(efficiency)')} AS mean,
  {r6('stddev_samp(efficiency)')} AS std, count(efficiency) AS "count" FROM F GROUP BY machine
UNION ALL
SELECT 'OperatorName', CAST(OperatorName AS VARCHAR), {r6('avg(efficiency)')}, {r6('stddev_samp(efficiency)')},
  count(efficiency) FROM F GROUP BY OperatorName
UNION ALL
SELECT 'hour', CAST(hour AS VARCHAR), {r6('avg(efficiency)')}, NULL, NULL FROM F GROUP BY hour
UNION ALL
SELECT 'day_of_week', CAST(day_of_week AS VARCHAR), {r6('avg(efficiency)')}, NULL, NULL FROM F GROUP BY day_of_week"""))
def agg16(spark, d):
    return S.efficiency_factors(F(spark, d))


_CATS = ", ".join(["SetupTime", "WaitingSetupTime", "NotFeedingTime", "AdjustmentTime", "DressingTime",
                   "ToolingTime", "EngineeringTime", "MaintenanceTime", "BuyInTime", "BreakShiftChangeTime",
                   "IdleTime"])
_LONG = f"""long_dt AS (
  SELECT machine, OperatorName, CAST(hour AS VARCHAR) AS hour, category, seconds
  FROM (UNPIVOT (SELECT machine, OperatorName, hour, {_CATS} FROM F) ON {_CATS} INTO NAME category VALUE seconds))"""


@query("agg17_downtime_patterns", sql(f"""
SELECT 'total' AS dimension, CAST(NULL AS VARCHAR) AS key, category, {r6('sum(seconds)')} AS value FROM long_dt GROUP BY category
UNION ALL SELECT 'machine', machine, category, {r6('avg(seconds)')} FROM long_dt GROUP BY machine, category
UNION ALL SELECT 'OperatorName', OperatorName, category, {r6('avg(seconds)')} FROM long_dt
  WHERE OperatorName <> 'Unknown' GROUP BY OperatorName, category
UNION ALL SELECT 'hour', hour, category, {r6('avg(seconds)')} FROM long_dt GROUP BY hour, category""", "F", _LONG))
def agg17(spark, d):
    return S.downtime_patterns(F(spark, d))


@query("agg20_headline_metrics", sql(f"""
SELECT total_jobs, avg_efficiency, efficiency_std, high_efficiency_jobs,
  {r6('high_efficiency_jobs / total_jobs')} AS high_efficiency_share
FROM (SELECT count(*) AS total_jobs, {r6('avg(efficiency)')} AS avg_efficiency,
  {r6('stddev_samp(efficiency)')} AS efficiency_std,
  count(CASE WHEN efficiency > 0.8 THEN 1 END) AS high_efficiency_jobs FROM F)"""))
def agg20(spark, d):
    return S.headline_metrics(F(spark, d))


_ARGMAX = "CASE " + " ".join(
    f"WHEN {c} = greatest({_CATS}) THEN '{c}'" for c in _CATS.split(", ")) + " END"


@query("agg21_downtime_summary", sql(f"""
SELECT {r6('SetupTime / 3600')} AS total_setup_hours, {r6('MaintenanceTime / 3600')} AS total_maintenance_hours,
  {r6('IdleTime / 3600')} AS total_idle_hours, {_ARGMAX} AS top_downtime_category
FROM (SELECT {', '.join(f'sum({c}) AS {c}' for c in _CATS.split(', '))} FROM F)"""))
def agg21(spark, d):
    return S.downtime_summary(F(spark, d))


def _top_sql(group: str, metric: str, n: int, min_rows: int = 3) -> str:
    return sql(f"""
SELECT {group}, {rn('m', 3)} AS avg_{metric}, job_count FROM (
  SELECT {group}, avg({metric}) AS m, count(*) AS job_count FROM F GROUP BY {group} HAVING count(*) >= {min_rows}
) ORDER BY avg_{metric} DESC, {group} LIMIT {n}""")


def _best_sql(group: str) -> str:
    return f"""(SELECT string_agg(concat({group}, ':', printf('%.3f', a), ':', n), ', ' ORDER BY a DESC, {group}) FROM (
  SELECT {group}, {rn('avg(efficiency)', 3)} AS a, count(*) AS n FROM recent GROUP BY {group} HAVING count(*) >= 3 ORDER BY a DESC, {group} LIMIT 5))"""


@query("agg22_performance_overview", sql(f"""
SELECT 365 AS period_days, total_jobs, {r6('e')} AS average_efficiency, high AS jobs_above_80_efficiency, {r6('1 / (1 + s)')} AS consistency_score,
  CASE WHEN total_jobs < 2 THEN 'stable' WHEN late > early * 1.05 THEN 'improving' WHEN late < early * 0.95 THEN 'declining' ELSE 'stable' END AS efficiency_trend,
  {_best_sql('machine')} AS top_machine, {_best_sql('OperatorName')} AS "top_OperatorName",
  {r6('SetupTime / 3600')} AS total_setup_hours, {r6('MaintenanceTime / 3600')} AS total_maintenance_hours,
  {r6('IdleTime / 3600')} AS total_idle_hours, {_ARGMAX} AS top_downtime_category
FROM (SELECT count(*) AS total_jobs, avg(efficiency) AS e, stddev_samp(efficiency) AS s, count(CASE WHEN efficiency > 0.8 THEN 1 END) AS high,
  avg(CASE WHEN pos >= n - floor(n / 3) THEN efficiency END) AS late, avg(CASE WHEN pos < floor(n / 3) THEN efficiency END) AS early,
  {', '.join(f'sum({c}) AS {c}' for c in _CATS.split(', '))}
  FROM (SELECT *, row_number() OVER (ORDER BY StartTime, JobNumber) - 1 AS pos, count(*) OVER () AS n FROM recent))""", "F",
    "recent AS (SELECT * FROM F WHERE StartTime >= (SELECT max(StartTime) FROM F) - INTERVAL 365 DAY)"))
def agg22(spark, d):
    """The last year of the log (the fixture has a handful of jobs in its last month)."""
    return S.performance_overview(F(spark, d), days=365)


@query("top3_top_machines", _top_sql("machine", "efficiency", 5))
def top3_machines(spark, d):
    return S.top_performers(F(spark, d), "machine", "efficiency", 5)


@query("top3_top_operators", _top_sql("OperatorName", "efficiency", 5))
def top3_operators(spark, d):
    return S.top_performers(F(spark, d), "OperatorName", "efficiency", 5)


@query("top6_top_performer", _top_sql("OperatorName", "efficiency", 1, 1))
def top6(spark, d):
    return S.top_performers(F(spark, d), "OperatorName", "efficiency", 1, min_rows=1)


@query("agg38_period_metrics_daily", sql(f"""
SELECT date_trunc('day', StartTime) AS period, machine, OperatorName, {r6('avg(efficiency)')} AS avg_efficiency,
  {r6('sum(total_downtime) / 60.0')} AS downtime_minutes, count(*) AS job_count
FROM F GROUP BY date_trunc('day', StartTime), machine, OperatorName"""))
def agg38(spark, d):
    return S.period_metrics(F(spark, d), "daily")


@query("agg24_hourly_frame", sql(f"""
SELECT CAST(hour AS BIGINT) AS hour, {r6('avg(efficiency)')} AS avg_efficiency, count(*) AS job_count,
  {r6('avg(total_downtime)')} AS avg_downtime FROM F GROUP BY hour"""))
def agg24(spark, d):
    return S.time_of_day_frames(F(spark, d))


@query("agg24_weekday_frame", sql(f"""
SELECT dayname(StartTime) AS day_name, {r6('avg(efficiency)')} AS avg_efficiency, count(*) AS job_count,
  {r6('avg(total_downtime)')} AS avg_downtime FROM F GROUP BY dayname(StartTime)"""))
def agg24_week(spark, d):
    return S.weekday_frame(F(spark, d))


@query("agg25_machine_frame", sql(f"""
SELECT machine, {rn('avg(efficiency)', 3)} AS avg_efficiency, {rn('stddev_samp(efficiency)', 3)} AS efficiency_std,
  count(*) AS job_count, {r6('sum(RunningTime) / (sum(RunningTime) + sum(total_downtime))')} AS utilization,
  {r6('sum(PartsProduced) * 3600.0 / sum(RunningTime)')} AS productivity,
  {r6('avg(total_downtime) / 3600.0')} AS avg_downtime_hours
FROM F GROUP BY machine"""))
def agg25(spark, d):
    return S.machine_frame(F(spark, d))


_SUMS = ", ".join(f"coalesce(sum({c}), 0.0) AS {c}" for c in DOWNTIME)


@query("agg25_downtime_hours", sql(f"""
SELECT level, machine, category, {r6('s / 3600')} AS hours, {r6('s / nullif(t, 0)')} AS share
FROM (SELECT level, machine, {' + '.join(DOWNTIME)} AS t, unnest([{', '.join(f"{{'category': '{c}', 's': CAST({c} AS DOUBLE)}}" for c in DOWNTIME)}], recursive := true)
  FROM (SELECT 'machine' AS level, machine, {_SUMS} FROM F GROUP BY machine UNION ALL SELECT 'all', NULL, {_SUMS} FROM F))"""))
def agg25_hours(spark, d):
    return S.downtime_hours(F(spark, d))


_DAY = "SELECT * FROM F WHERE CAST(StartTime AS DATE) = (SELECT max(CAST(StartTime AS DATE)) FROM F)"


@query("agg23_daily_report_sections", sql(f"""
SELECT section, name, row_number() OVER (PARTITION BY section ORDER BY e DESC NULLS LAST, name) AS rank, jobs, {rn('e', 3)} AS avg_efficiency, {rn('t', 2)} AS total_downtime
FROM (SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS name, count(*) AS jobs, avg(efficiency) AS e, sum(total_downtime) AS t FROM day
  UNION ALL SELECT 'operator', OperatorName, count(*), avg(efficiency), sum(total_downtime) FROM day GROUP BY OperatorName
  UNION ALL SELECT 'machine', machine, count(*), avg(efficiency), sum(total_downtime) FROM day GROUP BY machine)
WHERE jobs > 0 QUALIFY section <> 'operator' OR rank <= 5""", "F", f"day AS ({_DAY})"))
def agg23_sections(spark, d):
    """The last day of the log."""
    return S.daily_report_sections(F(spark, d))


@query("agg26_operator_frame", sql(f"""
SELECT OperatorName, {r6('avg(efficiency)')} AS avg_efficiency, {r6('stddev_samp(efficiency)')} AS efficiency_std,
  count(*) AS job_count, count(DISTINCT machine) AS machines, count(DISTINCT PartNumber) AS parts,
  {r6('1 / (1 + stddev_samp(efficiency))')} AS consistency
FROM F GROUP BY OperatorName HAVING count(*) >= 5"""))
def agg26(spark, d):
    return S.operator_frame(F(spark, d))


def _hist_sql(expr: str, bins: int) -> str:
    return sql(f"""
SELECT bin, {r6(f'lo + (hi - lo) * bin / {bins}')} AS bin_start, count(*) AS "count" FROM (
  SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) END AS BIGINT) AS bin, lo, hi
  FROM (SELECT {expr} AS x FROM F WHERE {expr} IS NOT NULL) v,
       (SELECT min({expr}) AS lo, max({expr}) AS hi FROM F WHERE {expr} IS NOT NULL) r
) GROUP BY bin, lo, hi""")


@query("agg27_efficiency_histogram", _hist_sql("efficiency", 30))
def agg27(spark, d):
    return S.histogram(F(spark, d), "efficiency", 30)


@query("agg27_log_duration_histogram", _hist_sql("ln(1 + JobDuration)", 50))
def agg27_log(spark, d):
    return S.histogram(F(spark, d), "JobDuration", 50, log1p=True)


_AGG28_CTE = """top10 AS (SELECT OperatorName FROM F GROUP BY OperatorName ORDER BY count(*) DESC, OperatorName LIMIT 10),
cells AS (SELECT OperatorName, machine, avg(efficiency) AS e FROM F
          WHERE OperatorName IN (SELECT OperatorName FROM top10) GROUP BY OperatorName, machine)"""


@query("agg28_operator_machine_pivot", sql(f"""
SELECT t.OperatorName, m.machine, {r6('coalesce(c.e, 0.0E0)')} AS avg_efficiency
FROM top10 t CROSS JOIN (SELECT DISTINCT machine FROM F) m
LEFT JOIN cells c ON c.OperatorName = t.OperatorName AND c.machine = m.machine""", "F", _AGG28_CTE))
def agg28(spark, d):
    return S.pivot_operator_machine(F(spark, d))
