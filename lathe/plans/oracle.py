"""DuckDB oracle SQL: shared CTEs for the job log, the cleaned log and the derived table.

Each oracle query is `sql(body, needs)` - a self-contained SELECT over the
pre-registered parquet views. Published doubles are rounded to 6 places with
half-to-even rounding on both engines.
"""

from __future__ import annotations

from ..schema import DOWNTIME

JOBLOG = """
joblog AS (
SELECT * EXCLUDE (okey) FROM (
SELECT b.*, b.StartTime + INTERVAL '1' SECOND * CAST(b.JobDuration AS BIGINT) AS EndTime
FROM (
  SELECT a.*,
    CASE WHEN a.okey % 811 = 0 THEN 30.0E0 WHEN a.okey % 701 = 0 THEN 80000.0E0
         ELSE a.RunningTime + a.SetupTime + a.WaitingSetupTime + greatest(a.NotFeedingTime, 0.0E0) + a.AdjustmentTime
            + a.DressingTime + a.ToolingTime + a.EngineeringTime + a.MaintenanceTime + a.BreakShiftChangeTime
            + least(a.IdleTime, 1800.0E0) END AS JobDuration
  FROM (
    SELECT
      concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-', CAST(l_partkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR)) AS JobNumber,
      l_orderkey AS okey,
      concat('M', CAST(l_suppkey % 12 AS VARCHAR)) AS machine,
      CASE WHEN o_custkey % 24 = 23 THEN NULL ELSE concat('OP', CAST(o_custkey % 24 AS VARCHAR)) END AS OperatorName,
      CASE WHEN l_partkey % 157 = 156 THEN NULL ELSE concat('P', CAST(l_partkey % 157 AS VARCHAR)) END AS PartNumber,
      concat('E', CAST(o_custkey % 24 AS VARCHAR)) AS EmpID,
      CASE WHEN l_orderkey % 613 = 0 THEN NULL ELSE o_orderstatus END AS State,
      CAST(l_linenumber AS INTEGER) AS OpNumber,
      CASE WHEN l_orderkey % 997 = 0 THEN CAST('1969-12-31 18:00:00' AS TIMESTAMP)
           ELSE CAST(l_shipdate AS TIMESTAMP) + INTERVAL '1' SECOND * ((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + l_suppkey) % 86400) END AS StartTime,
      l_quantity * 120.0E0 AS RunningTime,
      CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE l_quantity END AS PartsProduced,
      CAST((l_partkey % 157) * 6 AS DOUBLE) + round(l_discount * 100) * 60.0E0 + CASE WHEN l_orderkey % 1009 = 0 THEN 4000.0E0 ELSE 0.0E0 END AS SetupTime,
      round(l_tax * 100) * 30.0E0 AS WaitingSetupTime,
      CAST((l_linenumber - 3) * 20 AS DOUBLE) AS NotFeedingTime,
      round(l_discount * 100) * 40.0E0 + CASE WHEN l_orderkey % 1009 = 0 THEN 4000.0E0 ELSE 0.0E0 END AS AdjustmentTime,
      CASE WHEN l_returnflag = 'R' THEN 180.0E0 ELSE 0.0E0 END AS DressingTime,
      CAST((l_suppkey % 7) * 30 AS DOUBLE) + CASE WHEN l_orderkey % 1009 = 0 THEN 4000.0E0 ELSE 0.0E0 END AS ToolingTime,
      CASE WHEN l_linestatus = 'F' THEN 90.0E0 ELSE 0.0E0 END AS EngineeringTime,
      CASE WHEN (l_orderkey + l_linenumber) % 50 = 0 THEN 5400.0E0 ELSE 0.0E0 END AS MaintenanceTime,
      0.0E0 AS BuyInTime,
      CAST((l_linenumber % 2) * 300 AS DOUBLE) AS BreakShiftChangeTime,
      CASE WHEN l_orderkey % 499 = 0 THEN 90000.0E0 ELSE CAST((l_orderkey * 13 + l_partkey) % 1800 AS DOUBLE) END AS IdleTime
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  ) a
) b))"""


def _clamp(c: str) -> str:
    return f"CASE WHEN {c} < 0 THEN 0.0E0 WHEN {c} > 86400 THEN 86400.0E0 ELSE {c} END"


_CAT_COLS = ",\n  ".join(f"coalesce({_clamp(c)}, 0.0E0) AS {c}" for c in DOWNTIME)

CLEAN = f"""
clean0 AS (
SELECT JobNumber, machine, coalesce(OperatorName, 'Unknown') AS OperatorName,
  coalesce(PartNumber, 'Unknown') AS PartNumber, coalesce(EmpID, 'Unknown') AS EmpID, State, OpNumber,
  StartTime, EndTime,
  CASE WHEN JobDuration < 0 THEN 0.0E0 ELSE JobDuration END AS JobDuration,
  {_clamp('RunningTime')} AS RunningTime,
  coalesce(PartsProduced, 0.0E0) AS PartsProduced,
  {_CAT_COLS},
  CAST(datesub('second', StartTime, EndTime) AS DOUBLE) AS ActualDuration
FROM joblog
WHERE StartTime IS NOT NULL AND EndTime IS NOT NULL AND year(StartTime) <> 1969 AND year(EndTime) <> 1969
  AND machine IS NOT NULL AND State IS NOT NULL
),
clean AS (
SELECT * FROM clean0
WHERE JobDuration BETWEEN 60 AND 86400
  AND NOT coalesce(IdleTime > 604800, false) AND NOT coalesce(PartsProduced > 10000, false)
)"""


def _sdiv(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN 0.0E0 ELSE ({n}) / ({d}) END)"


_RATIOS = ",\n  ".join(f"{_sdiv(c, 'JobDuration')} AS {c}_ratio" for c in DOWNTIME)
_TOTAL = " + ".join(f"coalesce({c}, 0.0E0)" for c in DOWNTIME)

DERIVED = f"""
d1 AS (
SELECT *,
  CASE WHEN e0 < 0 THEN 0.0E0 WHEN e0 > 1 THEN 1.0E0 ELSE e0 END AS efficiency,
  {_sdiv('PartsProduced * 3600.0E0', 'RunningTime')} AS parts_per_hour,
  {_TOTAL} AS total_downtime,
  {_RATIOS},
  {_sdiv('RunningTime', 'RunningTime + SetupTime')} AS setup_efficiency,
  CAST(hour(StartTime) AS INTEGER) AS hour,
  CAST(isodow(StartTime) - 1 AS INTEGER) AS day_of_week,
  CAST(day(StartTime) AS INTEGER) AS day_of_month,
  CAST(month(StartTime) AS INTEGER) AS month,
  CAST(quarter(StartTime) AS INTEGER) AS quarter
FROM (SELECT *, {_sdiv('RunningTime', 'JobDuration')} AS e0 FROM clean)
),
d2 AS (
SELECT * EXCLUDE (e0),
  CAST(CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  CASE WHEN hour >= 6 AND hour < 14 THEN 'Day' WHEN hour >= 14 AND hour < 22 THEN 'Evening' ELSE 'Night' END AS shift,
  sin(hour * 6.283185307179586 / 24) AS hour_sin, cos(hour * 6.283185307179586 / 24) AS hour_cos,
  sin(day_of_week * 6.283185307179586 / 7) AS day_sin, cos(day_of_week * 6.283185307179586 / 7) AS day_cos,
  avg(JobDuration) OVER (PARTITION BY machine) AS machine_complexity,
  avg(SetupTime) OVER (PARTITION BY PartNumber) AS part_complexity,
  count(*) OVER (PARTITION BY OperatorName) AS operator_experience
FROM d1
),
mc_rng AS (SELECT min(machine_complexity) AS mn, max(machine_complexity) AS mx FROM d2),
derived_base AS (
SELECT d2.*,
  CASE WHEN machine_complexity <= mn - (mx - mn) * 0.001 AND mn <> mx THEN NULL
       WHEN mn = mx THEN 'Medium'
       WHEN machine_complexity <= (mx - mn) / 3.0 * 1.0 + mn THEN 'Simple'
       WHEN machine_complexity <= (mx - mn) / 3.0 * 2.0 + mn THEN 'Medium'
       ELSE 'Complex' END AS machine_complexity_cat,
  CASE WHEN operator_experience <= 10 THEN 'Novice' WHEN operator_experience <= 50 THEN 'Intermediate'
       WHEN operator_experience <= 200 THEN 'Experienced' ELSE 'Expert' END AS operator_experience_cat
FROM d2, mc_rng
)"""

ROLLING = """
derived AS (
SELECT *,
  avg(efficiency) OVER (PARTITION BY OperatorName ORDER BY StartTime, JobNumber ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS operator_efficiency_rolling_5,
  avg(parts_per_hour) OVER (PARTITION BY OperatorName ORDER BY StartTime, JobNumber ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS operator_parts_per_hour_rolling_5,
  avg(total_downtime) OVER (PARTITION BY OperatorName ORDER BY StartTime, JobNumber ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS operator_total_downtime_rolling_5,
  avg(efficiency) OVER (PARTITION BY OperatorName ORDER BY StartTime, JobNumber ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS operator_efficiency_rolling_10,
  avg(parts_per_hour) OVER (PARTITION BY OperatorName ORDER BY StartTime, JobNumber ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS operator_parts_per_hour_rolling_10,
  avg(total_downtime) OVER (PARTITION BY OperatorName ORDER BY StartTime, JobNumber ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS operator_total_downtime_rolling_10,
  avg(efficiency) OVER (PARTITION BY machine ORDER BY StartTime, JobNumber ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS machine_efficiency_rolling_5,
  avg(JobDuration) OVER (PARTITION BY machine ORDER BY StartTime, JobNumber ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS machine_JobDuration_rolling_5,
  avg(efficiency) OVER (PARTITION BY machine ORDER BY StartTime, JobNumber ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS machine_efficiency_rolling_10,
  avg(JobDuration) OVER (PARTITION BY machine ORDER BY StartTime, JobNumber ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS machine_JobDuration_rolling_10
FROM derived_base
)"""

# F without the rolling columns is enough for most aggregates; name it F.
F_ALIAS = "\nF AS (SELECT * FROM derived_base)"

_LEVELS = {
    "joblog": [JOBLOG],
    "clean": [JOBLOG, CLEAN],
    "F": [JOBLOG, CLEAN, DERIVED, F_ALIAS],
    "derived": [JOBLOG, CLEAN, DERIVED, ROLLING],
}


def sql(body: str, needs: str = "F", extra: str = "") -> str:
    """Prefix `body` with the CTE chain it needs ('joblog', 'clean', 'F', 'derived')."""
    parts = list(_LEVELS[needs])
    if extra:
        parts.append(extra)
    return "WITH " + ",".join(parts) + "\n" + body


def r6(expr: str) -> str:
    return f"round_even(({expr}) * 1e6, 0) / 1e6"


# Column types of the three stages, for `SELECT * REPLACE (...)` publication.
RAW_DOUBLES = ["JobDuration", "RunningTime", "PartsProduced"] + DOWNTIME
CLEAN_DOUBLES = RAW_DOUBLES + ["ActualDuration"]
F_DOUBLES = CLEAN_DOUBLES + ["efficiency", "parts_per_hour", "total_downtime"] + [f"{c}_ratio" for c in DOWNTIME] + [
    "setup_efficiency", "hour_sin", "hour_cos", "day_sin", "day_cos", "machine_complexity", "part_complexity"]
F_INTS = ["OpNumber", "hour", "day_of_week", "day_of_month", "month", "quarter", "is_weekend"]
ROLLING_DOUBLES = [f"operator_{m}_rolling_{k}" for k in (5, 10) for m in ("efficiency", "parts_per_hour", "total_downtime")] + [
    f"machine_{m}_rolling_{k}" for k in (5, 10) for m in ("efficiency", "JobDuration")]


def star(source: str, doubles, ints=("OpNumber",), exclude=()) -> str:
    """SELECT * from a CTE with doubles rounded like `publish` and integers widened."""
    rep = [f"{r6(c)} AS {c}" for c in doubles] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
    ex = f" EXCLUDE ({', '.join(exclude)})" if exclude else ""
    return f"SELECT *{ex} REPLACE ({', '.join(rep)}) FROM {source}"


def rn(expr: str, d: int) -> str:
    return f"round_even(({expr}) * 1e{d}, 0) / 1e{d}"


def avg_rank_desc(c: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    pp = f"PARTITION BY {part + ', ' if part else ''}{c}"
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE CAST(rank() OVER ({p}ORDER BY {c} DESC NULLS LAST) AS DOUBLE)"
            f" + (count(*) OVER ({pp}) - 1) / 2.0 END")


def cap1(e: str) -> str:
    return f"(CASE WHEN ({e}) > 1 THEN 1.0E0 ELSE ({e}) END)"


def perf(e: str, q: str, c: str) -> str:
    return cap1(f"({e}) * 0.5 + ({q}) * 0.3 + ({c}) * 0.2")


def rel_cons(std: str, mean: str) -> str:
    return f"(1.0E0 - CASE WHEN ({mean}) > 0 THEN ({std}) / ({mean}) ELSE 0.0E0 END)"
