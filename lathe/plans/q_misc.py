"""Registered statistics queries (AGG29-AGG34) and the daily report (AGG23)."""

from __future__ import annotations

from ..operators import summaries as S
from .oracle import r6, sql
from .registry import query
from .tables import F

NUMERIC = ["JobDuration", "RunningTime", "PartsProduced", "SetupTime", "IdleTime", "efficiency", "parts_per_hour",
           "total_downtime"]
CATEGORICAL = ["machine", "OperatorName", "PartNumber", "State", "shift"]
# BuyInTime is constant in the fixture (its correlation is undefined), so it is left out.
CORR_COLS = ["JobDuration", "RunningTime", "PartsProduced", "SetupTime", "WaitingSetupTime", "AdjustmentTime",
             "ToolingTime", "MaintenanceTime", "IdleTime", "total_downtime", "parts_per_hour", "hour"]


def _unpivot(cols, cast="DOUBLE") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS {cast}) AS value FROM F" for c in cols)


@query("agg29_describe", sql(f"""
SELECT "column", count(value) AS "count", {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS std,
  min(value) AS min, {r6('quantile_cont(value, 0.25)')} AS q25, {r6('quantile_cont(value, 0.5)')} AS q50,
  {r6('quantile_cont(value, 0.75)')} AS q75, max(value) AS max
FROM ({_unpivot(NUMERIC)}) GROUP BY "column\""""))
def agg29(spark, d):
    return S.describe_numeric(F(spark, d), NUMERIC)


@query("agg30_value_counts", sql(f"""
SELECT "column", value, "count", rank, n_unique FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, value) AS rank,
    count(*) OVER (PARTITION BY "column") AS n_unique
  FROM (SELECT "column", value, count(*) AS "count" FROM ({_unpivot(CATEGORICAL, 'VARCHAR')}) GROUP BY "column", value))
WHERE rank <= CASE WHEN n_unique < 20 THEN 10 ELSE 5 END"""))
def agg30(spark, d):
    return S.value_counts(F(spark, d), CATEGORICAL)


@query("agg31_feature_statistics", sql(f"""
SELECT "column", {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS std, min(value) AS min, max(value) AS max,
  {r6('avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_ratio,
  {r6('avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END)')} AS zeros_ratio
FROM ({_unpivot(NUMERIC)}) GROUP BY "column\""""))
def agg31(spark, d):
    return S.feature_statistics(F(spark, d), NUMERIC)


@query("agg32_efficiency_correlations", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'corr(CAST({c} AS DOUBLE), efficiency)')} AS correlation, "
    f"{r6(f'abs(corr(CAST({c} AS DOUBLE), efficiency))')} AS abs_correlation FROM F" for c in CORR_COLS)))
def agg32(spark, d):
    return S.correlations_with(F(spark, d), "efficiency", CORR_COLS)


_PAIRS = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]


@query("agg33_correlation_pairs", sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r6(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS correlation FROM F"
    for a, b in _PAIRS) + ") WHERE abs(correlation) > 0.8"))
def agg33(spark, d):
    return S.correlation_pairs(F(spark, d), CORR_COLS)


_MI_COLS = ["JobDuration", "RunningTime", "SetupTime", "IdleTime", "total_downtime", "parts_per_hour", "hour"]


def _mi_sql() -> str:
    def b(v, lo, hi):
        return f"CASE WHEN {hi} = {lo} THEN 0 ELSE least(floor(({v} - {lo}) / ({hi} - {lo}) * 10), 9) END"
    lng = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, efficiency AS y FROM F" for c in _MI_COLS)
    return sql(f"""
SELECT feature, {r6('sum((nxy / n) * ln(nxy * n / (nx * ny)))')} AS mutual_information FROM (
  SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, bx) AS nx,
    sum(nxy) OVER (PARTITION BY feature, by_) AS ny
  FROM (SELECT feature, bx, by_, count(*) AS nxy FROM (
    SELECT l.feature, {b('x', 'xl', 'xh')} AS bx, {b('y', 'yl', 'yh')} AS by_
    FROM (SELECT * FROM ({lng}) WHERE x IS NOT NULL AND y IS NOT NULL) l
    JOIN (SELECT feature, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM ({lng})
          WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY feature) r ON l.feature = r.feature)
  GROUP BY feature, bx, by_)) GROUP BY feature""")


@query("agg34_mutual_information", _mi_sql())
def agg34(spark, d):
    return S.binned_mutual_information(F(spark, d), "efficiency", _MI_COLS)


@query("agg23_daily_report", sql(f"""
SELECT machine, count(*) AS jobs, round_even(avg(efficiency) * 1e3, 0) / 1e3 AS avg_efficiency,
  sum(total_downtime) AS total_downtime,
  row_number() OVER (ORDER BY round_even(avg(efficiency) * 1e3, 0) / 1e3 DESC, machine) AS rank
FROM F WHERE CAST(StartTime AS DATE) = DATE '1995-06-15' GROUP BY machine"""))
def agg23(spark, d):
    return S.daily_report(F(spark, d), "1995-06-15")
