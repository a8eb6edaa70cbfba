"""Registered operator-analysis queries with DuckDB oracles."""

from __future__ import annotations

from ..operators import operator_analysis as OA
from .oracle import cap1, perf, r6, rn, sql
from .registry import query
from .tables import F


def _sd(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN 0.0E0 ELSE ({n}) / ({d}) END)"


_DAYS = "floor(CAST(datesub('second', {a}, {b}) AS DOUBLE) / 86400.0)"


def _r2(e: str) -> str:
    return rn(e, 2)


@query("agg9_operator_basic_metrics", sql(f"""
SELECT *, {r6('1 / (1 + efficiency_std)')} AS efficiency_consistency,
  {r6(_sd('total_parts * 3600', 'total_running_time'))} AS parts_per_hour,
  {r6(_sd('total_jobs', 'experience_days + 1'))} AS jobs_per_day
FROM (
  SELECT OperatorName, count(efficiency) AS total_jobs,
    {_r2('avg(efficiency)')} AS avg_efficiency, {_r2('stddev_samp(efficiency)')} AS efficiency_std,
    {_r2('min(efficiency)')} AS min_efficiency, {_r2('max(efficiency)')} AS max_efficiency,
    {_r2('avg(JobDuration)')} AS avg_job_duration, {_r2('sum(JobDuration)')} AS total_job_duration,
    {_r2('avg(RunningTime)')} AS avg_running_time, {_r2('sum(RunningTime)')} AS total_running_time,
    {_r2('sum(PartsProduced)')} AS total_parts, {_r2('avg(PartsProduced)')} AS avg_parts,
    {_r2('avg(SetupTime)')} AS avg_setup_time, {_r2('sum(SetupTime)')} AS total_setup_time,
    {_r2('avg(total_downtime)')} AS avg_downtime, {_r2('sum(total_downtime)')} AS total_downtime,
    count(DISTINCT machine) AS machines_operated, count(DISTINCT PartNumber) AS unique_parts,
    min(StartTime) AS first_job, max(StartTime) AS last_job,
    CAST({_DAYS.format(a='min(StartTime)', b='max(StartTime)')} AS BIGINT) AS experience_days
  FROM F GROUP BY OperatorName)"""))
def agg9(spark, d):
    return OA.basic_metrics(F(spark, d))


@query("agg10_operator_consistency", sql(f"""
SELECT OperatorName, {r6('s')} AS efficiency_std, {r6('m')} AS efficiency_mean, {r6('q1')} AS efficiency_q25,
  {r6('q3')} AS efficiency_q75, {r6('1 / (1 + s)')} AS consistency_score, {r6('q3 - q1')} AS interquartile_range
FROM (SELECT OperatorName, stddev_samp(efficiency) AS s, avg(efficiency) AS m,
  quantile_cont(efficiency, 0.25) AS q1, quantile_cont(efficiency, 0.75) AS q3 FROM F GROUP BY OperatorName)"""))
def agg10(spark, d):
    return OA.consistency(F(spark, d))


_MC = """mc AS (SELECT OperatorName, machine, stddev_samp(efficiency) AS std, count(efficiency) AS job_count
  FROM F GROUP BY OperatorName, machine HAVING count(efficiency) >= 3),
mcr AS (SELECT *, row_number() OVER (PARTITION BY OperatorName ORDER BY std ASC, machine) AS lo,
  row_number() OVER (PARTITION BY OperatorName ORDER BY std DESC, machine) AS hi FROM mc)"""


@query("agg11_machine_consistency", sql(f"""
SELECT a.OperatorName, a.machine AS most_consistent_machine, {r6('a.std')} AS most_consistent_std,
  a.job_count AS most_consistent_jobs, b.machine AS least_consistent_machine, {r6('b.std')} AS least_consistent_std,
  b.job_count AS least_consistent_jobs
FROM mcr a JOIN mcr b ON a.OperatorName = b.OperatorName AND a.lo = 1 AND b.hi = 1""", "F", _MC))
def agg11(spark, d):
    return OA.machine_consistency(F(spark, d))


@query("agg14_operator_versatility", sql(f"""
SELECT OperatorName, machines, parts, {r6('avg_efficiency')} AS avg_efficiency,
  {r6('machines / max(machines) OVER ()')} AS machine_versatility_score,
  {r6('parts / max(parts) OVER ()')} AS part_versatility_score,
  {r6('(machines / max(machines) OVER ()) * 0.6 + (parts / max(parts) OVER ()) * 0.4')} AS overall_versatility_score
FROM (SELECT OperatorName, count(DISTINCT machine) AS machines, count(DISTINCT PartNumber) AS parts,
  avg(efficiency) AS avg_efficiency FROM F GROUP BY OperatorName)"""))
def agg14(spark, d):
    return OA.versatility(F(spark, d))


_CT = """om AS (SELECT OperatorName, machine, avg(SetupTime) AS s FROM F GROUP BY OperatorName, machine),
op AS (SELECT OperatorName, avg(s) AS cur_setup, count(*) AS cur FROM om GROUP BY OperatorName),
ma AS (SELECT machine, avg(SetupTime) AS msetup FROM F GROUP BY machine),
cand AS (SELECT op.OperatorName, ma.machine, 1 / (1 + abs(cur_setup - msetup) / 1000) AS similarity,
  ((SELECT count(*) FROM ma) - cur) / (SELECT count(*) FROM ma) AS versatility_potential
  FROM op CROSS JOIN ma
  WHERE NOT EXISTS (SELECT 1 FROM om WHERE om.OperatorName = op.OperatorName AND om.machine = ma.machine))"""


@query("mat13_cross_training_potential", sql(f"""
SELECT OperatorName, machine, {r6('similarity')} AS similarity, rank, {r6('versatility_potential')} AS versatility_potential
FROM (SELECT *, row_number() OVER (PARTITION BY OperatorName ORDER BY similarity DESC, machine) AS rank FROM cand)
WHERE rank <= 3""", "F", _CT))
def mat13(spark, d):
    return OA.cross_training_potential(F(spark, d))


@query("agg15_specialization_scores", sql(f"""
SELECT OperatorName,
  {r6('CASE WHEN cnt > 1 THEN CASE WHEN sd = 0 THEN NULL ELSE (mx - mn) / sd END ELSE 0.0E0 END')} AS machine_specialization_score,
  cnt AS versatility_score, CAST(jobs AS BIGINT) AS total_experience
FROM (SELECT OperatorName, max(e) AS mx, avg(e) AS mn, stddev_samp(e) AS sd, count(*) AS cnt, sum(n) AS jobs
  FROM (SELECT OperatorName, machine, avg(efficiency) AS e, count(*) AS n FROM F GROUP BY OperatorName, machine)
  GROUP BY OperatorName)"""))
def agg15(spark, d):
    return OA.specialization_scores(F(spark, d))


@query("top4_best_machine", sql(f"""
SELECT OperatorName, machine AS best_machine, {r6('e')} AS best_efficiency, job_count FROM (
  SELECT *, row_number() OVER (PARTITION BY OperatorName ORDER BY e DESC, machine) AS r FROM (
    SELECT OperatorName, machine, avg(efficiency) AS e, count(*) AS job_count FROM F GROUP BY OperatorName, machine
    HAVING count(*) >= 3)) WHERE r = 1"""))
def top4_machine(spark, d):
    return OA.best_machine(F(spark, d))


@query("top4_top_parts", sql(f"""
SELECT OperatorName, PartNumber, {r6('m')} AS mean, "count", rank FROM (
  SELECT *, row_number() OVER (PARTITION BY OperatorName ORDER BY m DESC, PartNumber) AS rank FROM (
    SELECT OperatorName, PartNumber, avg(efficiency) AS m, count(*) AS "count" FROM F
    GROUP BY OperatorName, PartNumber HAVING count(*) >= 2)) WHERE rank <= 3"""))
def top4_parts(spark, d):
    return OA.top_parts(F(spark, d))


_LC = """lc0 AS (
  SELECT OperatorName, StartTime, efficiency, jobs,
    row_number() OVER (PARTITION BY OperatorName ORDER BY StartTime, JobNumber) - 1 AS pos,
    avg(efficiency) OVER (PARTITION BY OperatorName ORDER BY StartTime, JobNumber ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ma3,
    avg(efficiency) OVER (PARTITION BY OperatorName ORDER BY StartTime, JobNumber ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ma4,
    avg(efficiency) OVER (PARTITION BY OperatorName ORDER BY StartTime, JobNumber ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma5
  FROM (SELECT *, count(*) OVER (PARTITION BY OperatorName) AS jobs FROM F) WHERE jobs >= 10),
lc1 AS (SELECT *, CASE WHEN least(5, floor(jobs / 3)) = 3 THEN ma3 WHEN least(5, floor(jobs / 3)) = 4 THEN ma4 ELSE ma5 END AS ma,
  CAST(pos + 1 AS DOUBLE) AS seq FROM lc0),
curves AS (SELECT OperatorName,
  avg(CASE WHEN pos < 5 THEN efficiency END) AS initial_efficiency,
  avg(CASE WHEN pos >= jobs - 5 THEN efficiency END) AS recent_efficiency,
  regr_slope(ma, seq) * 100 AS improvement_rate,
  max(CASE WHEN pos = jobs - 1 THEN ma END) - max(CASE WHEN pos = 0 THEN ma END) AS total_improvement,
  first(jobs) AS job_count,
  CAST(floor(CAST(datesub('second', min(StartTime), max(StartTime)) AS DOUBLE) / 86400.0) AS BIGINT) AS experience_span_days
  FROM lc1 GROUP BY OperatorName)"""

_LC_COLS = (f"OperatorName, {r6('initial_efficiency')} AS initial_efficiency, {r6('recent_efficiency')} AS recent_efficiency, "
            f"{r6('improvement_rate')} AS improvement_rate, {r6('total_improvement')} AS total_improvement, job_count, "
            "experience_span_days")


@query("win19_learning_curves", sql(f"SELECT {_LC_COLS} FROM curves", "F", _LC))
def win19(spark, d):
    return OA.learning_curves(F(spark, d))


@query("win19_fast_learners", sql(f"""SELECT {_LC_COLS} FROM curves WHERE improvement_rate > 0.01 AND job_count >= 10
ORDER BY improvement_rate DESC, OperatorName LIMIT 5""", "F", _LC))
def win19_fast(spark, d):
    return OA.fast_learners(OA.learning_curves(F(spark, d)))


_RK = f"""m AS (SELECT OperatorName, {rn('avg(efficiency)', 3)} AS efficiency, {rn('avg(SetupTime)', 3)} AS SetupTime,
  {rn('avg(parts_per_hour)', 3)} AS parts_per_hour, {rn('avg(total_downtime)', 3)} AS total_downtime,
  count(DISTINCT machine) AS machine, count(JobDuration) AS JobDuration FROM F GROUP BY OperatorName),
ms AS (SELECT *, {perf('efficiency', cap1('parts_per_hour / 10'), '1 / (1 + total_downtime / 1000)')} AS performance_score FROM m)"""


def _rk(name: str, metric: str, asc: bool, n: int, where: str = "") -> str:
    order = "ASC" if asc else "DESC"
    return f"""SELECT '{name}' AS ranking, position, OperatorName, {r6(f'CAST({metric} AS DOUBLE)')} AS value FROM (
  SELECT *, row_number() OVER (ORDER BY {metric} {order}, OperatorName) AS position FROM ms
  WHERE {metric} IS NOT NULL {where}) WHERE position <= {n}"""


@query("top2_operator_rankings", sql("\nUNION ALL\n".join([
    _rk("efficiency_ranking", "efficiency", False, 10),
    _rk("setup_speed_ranking", "SetupTime", True, 10),
    _rk("productivity_ranking", "parts_per_hour", False, 10),
    _rk("versatility_ranking", "machine", False, 10),
    _rk("overall_performance_ranking", "performance_score", False, 10),
    _rk("experienced_top_performers", "performance_score", False, 5, "AND JobDuration >= 10"),
]), "F", _RK))
def top2(spark, d):
    return OA.rankings(F(spark, d))


@query("agg19_hourly_patterns", sql(f"""
SELECT OperatorName, CAST(max(CASE WHEN b = 1 THEN hour END) AS BIGINT) AS best_hour,
  {r6('max(CASE WHEN b = 1 THEN e END)')} AS best_hour_efficiency,
  CAST(max(CASE WHEN w = 1 THEN hour END) AS BIGINT) AS worst_hour,
  {r6('max(CASE WHEN w = 1 THEN e END)')} AS worst_hour_efficiency, {r6('stddev_samp(e)')} AS hour_variation
FROM (SELECT *, row_number() OVER (PARTITION BY OperatorName ORDER BY e DESC, hour) AS b,
  row_number() OVER (PARTITION BY OperatorName ORDER BY e ASC, hour) AS w
  FROM (SELECT OperatorName, hour, avg(efficiency) AS e FROM F GROUP BY OperatorName, hour))
GROUP BY OperatorName HAVING count(*) > 1"""))
def agg19_hourly(spark, d):
    return OA.hourly_patterns(F(spark, d))


@query("agg19_daily_patterns", sql(f"""
SELECT OperatorName, {r6('max(CASE WHEN day_of_week = 0 THEN e END)')} AS monday_efficiency,
  {r6('max(CASE WHEN day_of_week = 4 THEN e END)')} AS friday_efficiency, {r6('stddev_samp(e)')} AS daily_variation
FROM (SELECT OperatorName, day_of_week, avg(efficiency) AS e FROM F GROUP BY OperatorName, day_of_week)
GROUP BY OperatorName HAVING count(*) > 1"""))
def agg19_daily(spark, d):
    return OA.daily_patterns(F(spark, d))


@query("agg18_operator_profile", sql(f"""
SELECT b.*, x.machines, x.parts, {r6('x.med')} AS median_efficiency FROM (
  SELECT *, {r6('1 / (1 + efficiency_std)')} AS efficiency_consistency,
    {r6(_sd('total_parts * 3600', 'total_running_time'))} AS parts_per_hour,
    {r6(_sd('total_jobs', 'experience_days + 1'))} AS jobs_per_day
  FROM (
    SELECT OperatorName, count(efficiency) AS total_jobs,
      {_r2('avg(efficiency)')} AS avg_efficiency, {_r2('stddev_samp(efficiency)')} AS efficiency_std,
      {_r2('min(efficiency)')} AS min_efficiency, {_r2('max(efficiency)')} AS max_efficiency,
      {_r2('avg(JobDuration)')} AS avg_job_duration, {_r2('sum(JobDuration)')} AS total_job_duration,
      {_r2('avg(RunningTime)')} AS avg_running_time, {_r2('sum(RunningTime)')} AS total_running_time,
      {_r2('sum(PartsProduced)')} AS total_parts, {_r2('avg(PartsProduced)')} AS avg_parts,
      {_r2('avg(SetupTime)')} AS avg_setup_time, {_r2('sum(SetupTime)')} AS total_setup_time,
      {_r2('avg(total_downtime)')} AS avg_downtime, {_r2('sum(total_downtime)')} AS total_downtime,
      count(DISTINCT machine) AS machines_operated, count(DISTINCT PartNumber) AS unique_parts,
      min(StartTime) AS first_job, max(StartTime) AS last_job,
      CAST({_DAYS.format(a='min(StartTime)', b='max(StartTime)')} AS BIGINT) AS experience_days
    FROM F GROUP BY OperatorName)) b
JOIN (SELECT OperatorName AS op, array_to_string(list_sort(list_distinct(list(machine))), ',') AS machines,
  array_to_string(list_sort(list_distinct(list(PartNumber))), ',') AS parts, median(efficiency) AS med
  FROM F GROUP BY OperatorName) x ON b.OperatorName = x.op"""))
def agg18(spark, d):
    return OA.operator_profile(F(spark, d))
