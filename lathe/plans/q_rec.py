"""Registered recommender queries. The oracles score every (key, operator) pair by brute
force, which checks the candidate + missing-rank evaluation of the Spark side."""

from __future__ import annotations

from pyspark.sql import functions as F_

from ..operators import recommend as RC
from .oracle import r6, sql
from .registry import query
from .tables import F, J, materialized


def fitted(spark, d) -> RC.Model:
    """The recommender fitted on F, its tables stored once per session."""
    return RC.Model(F(spark, d)).store(lambda name, df: materialized(spark, d, name, lambda: df))


def jobs_table(spark, d):
    """Jobs to assign, derived from the log: every job; second operations arrive without a machine."""
    return J(spark, d).select(
        F_.col("JobNumber").alias("job_id"),
        F_.when(F_.col("OpNumber") == 2, F_.lit(None).cast("string")).otherwise(F_.col("machine")).alias("machine"),
        F_.col("PartNumber").alias("part"))


_JOBS = """jobs AS (SELECT JobNumber AS job_id, CASE WHEN OpNumber = 2 THEN NULL ELSE machine END AS machine,
  PartNumber AS part FROM joblog)"""

_FIT = """ops AS (SELECT OperatorName AS operator, avg(efficiency) AS a,
    CASE WHEN stddev_samp(efficiency) > 0 THEN 1 / (1 + stddev_samp(efficiency)) ELSE 1.0E0 END AS cons,
    stddev_samp(efficiency) AS s, avg(SetupTime) AS st, avg(parts_per_hour) AS pph, count(*) AS n, avg(total_downtime) AS dt,
    count(DISTINCT machine) AS nm, count(DISTINCT PartNumber) AS np
  FROM F WHERE OperatorName <> 'Unknown' GROUP BY OperatorName),
mach AS (SELECT machine, avg(efficiency) AS a, sum(RunningTime) / (sum(RunningTime) + sum(total_downtime)) AS util
  FROM F GROUP BY machine),
om AS (SELECT OperatorName AS o, machine AS m, round_even(avg(efficiency) * 1e3, 0) / 1e3 AS e, count(*) AS c FROM F
  WHERE OperatorName <> 'Unknown' GROUP BY OperatorName, machine HAVING count(*) >= 2),
opp AS (SELECT OperatorName AS o, PartNumber AS p, round_even(avg(efficiency) * 1e3, 0) / 1e3 AS e, count(*) AS c FROM F
  WHERE OperatorName <> 'Unknown' AND PartNumber <> 'Unknown' GROUP BY OperatorName, PartNumber),
mp AS (SELECT machine AS m, PartNumber AS p, round_even(avg(efficiency) * 1e3, 0) / 1e3 AS e, count(*) AS c FROM F
  WHERE PartNumber <> 'Unknown' GROUP BY machine, PartNumber)"""


def _cap(e: str) -> str:
    return f"(CASE WHEN ({e}) > 1 THEN 1.0E0 ELSE ({e}) END)"


_C1 = "CASE WHEN om.e IS NOT NULL THEN om.e * 0.7 + least(om.c / 10.0, 0.3) ELSE ops.a * 0.5 END"
_C2 = "CASE WHEN k.part IS NULL THEN NULL WHEN opp.e IS NOT NULL THEN opp.e * 0.6 ELSE ops.a * 0.3 END"
_C5 = "CASE WHEN om.e IS NOT NULL THEN om.e * 0.3 END"
_OSCORE = _cap(f"(({_C1}) + coalesce({_C2}, 0.0E0) + ops.a * 0.4 + ops.cons * 0.2 + coalesce({_C5}, 0.0E0)) / "
               f"(3 + CAST(({_C2}) IS NOT NULL AS INTEGER) + CAST(({_C5}) IS NOT NULL AS INTEGER))")


def _conf(om_c: str, op_c: str, mp_c: str, a_om: str, a_op: str, a_mp: str) -> str:
    pts = (f"(CASE WHEN {a_om} THEN (CASE WHEN {om_c} >= 10 THEN 3 WHEN {om_c} >= 5 THEN 2 WHEN {om_c} >= 2 THEN 1 ELSE 0 END) ELSE 0 END"
           f" + CASE WHEN {a_op} THEN (CASE WHEN {op_c} >= 5 THEN 2 WHEN {op_c} >= 2 THEN 1 ELSE 0 END) ELSE 0 END"
           f" + CASE WHEN {a_mp} THEN (CASE WHEN {mp_c} >= 5 THEN 2 WHEN {mp_c} >= 2 THEN 1 ELSE 0 END) ELSE 0 END)")
    tot = f"(CAST({a_om} AS INTEGER) + CAST({a_op} AS INTEGER) + CAST({a_mp} AS INTEGER))"
    return (f"CASE WHEN {tot} = 0 THEN 'Low' WHEN {pts} / {tot} >= 2 THEN 'High' WHEN {pts} / {tot} >= 1 THEN 'Medium' "
            f"ELSE 'Low' END")


_OCONF = _conf("om.c", "opp.c", "mp.c", "k.machine IS NOT NULL", "k.part IS NOT NULL",
               "k.machine IS NOT NULL AND k.part IS NOT NULL")


def _op_scores(keys: str) -> str:
    return f"""SELECT k.machine, k.part, ops.operator, {_OSCORE} AS score, {_OCONF} AS confidence
FROM {keys} k CROSS JOIN ops
LEFT JOIN om ON om.o = ops.operator AND om.m = k.machine
LEFT JOIN opp ON opp.o = ops.operator AND opp.p = k.part
LEFT JOIN mp ON mp.m = k.machine AND mp.p = k.part"""


_KEYS5 = "keys5 AS (SELECT DISTINCT machine, part FROM jobs WHERE machine IS NOT NULL)"


@query("rec10_top_operators", sql(f"""
SELECT machine, part, operator, {r6('score')} AS score, confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY machine, part ORDER BY score DESC, operator) AS rank
  FROM ({_op_scores('keys5')})) WHERE rank <= 5""", "F", ",\n".join([_JOBS, _FIT, _KEYS5])))
def rec10(spark, d):
    m = fitted(spark, d)
    return RC.rank_operators(m, jobs_table(spark, d).where(F_.col("machine").isNotNull()), 5)


_MSCORE = _cap("((CASE WHEN mp.e IS NOT NULL THEN mp.e * 0.7 ELSE mach.a * 0.5 END) + coalesce(mp.e * 0.6, 0.0E0) "
               "+ mach.a * 0.4 + mach.util * 0.2) / (3 + CAST(mp.e IS NOT NULL AS INTEGER))")
_MCONF = _conf("NULL", "NULL", "mp.c", "false", "false", "k.part IS NOT NULL")


def _m_scores(keys: str) -> str:
    return f"""SELECT k.part, mach.machine, {_MSCORE} AS score, {_MCONF} AS confidence
FROM {keys} k CROSS JOIN mach LEFT JOIN mp ON mp.m = mach.machine AND mp.p = k.part"""


_PKEYS = "pkeys AS (SELECT DISTINCT part FROM jobs WHERE part IS NOT NULL)"


@query("rec11_top_machines", sql(f"""
SELECT part, machine, {r6('score')} AS score, confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, machine) AS rank FROM ({_m_scores('pkeys')}))
WHERE rank <= 5""", "F", ",\n".join([_JOBS, _FIT, _PKEYS])))
def rec11(spark, d):
    m = fitted(spark, d)
    return RC.rank_machines(m, jobs_table(spark, d).where(F_.col("part").isNotNull()), 5)


_BATCH = f"""k1 AS (SELECT DISTINCT machine, part FROM jobs WHERE machine IS NOT NULL),
best1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine, part ORDER BY score DESC, operator) AS r
  FROM ({_op_scores('k1')})) WHERE r = 1),
k2 AS (SELECT DISTINCT part FROM jobs WHERE machine IS NULL AND part IS NOT NULL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, machine) AS r
  FROM ({_m_scores('k2')})) WHERE r = 1),
k3 AS (SELECT DISTINCT machine, part FROM bm),
best3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine, part ORDER BY score DESC, operator) AS r
  FROM ({_op_scores('k3')})) WHERE r = 1),
assign AS (
  SELECT j.job_id, j.machine, j.part, j.machine AS recommended_machine, coalesce(b.operator, 'Any') AS recommended_operator,
    coalesce(b.score, 0.5) AS expected_performance, coalesce(b.confidence, 'Low') AS confidence
  FROM jobs j LEFT JOIN best1 b ON b.machine = j.machine AND b.part IS NOT DISTINCT FROM j.part WHERE j.machine IS NOT NULL
  UNION ALL
  SELECT j.job_id, j.machine, j.part, coalesce(bm.machine, 'Any'), coalesce(b3.operator, 'Any'),
    coalesce(b3.score, bm.score, 0.5), CASE WHEN bm.machine IS NOT NULL THEN 'Medium' ELSE 'Low' END
  FROM jobs j LEFT JOIN bm ON bm.part = j.part LEFT JOIN best3 b3 ON b3.machine = bm.machine AND b3.part = j.part
  WHERE j.machine IS NULL AND j.part IS NOT NULL
  UNION ALL
  SELECT job_id, machine, part, 'Any', 'Any', 0.5, 'Low' FROM jobs WHERE machine IS NULL AND part IS NULL)"""


def _two(e: str) -> str:
    return f"format('{{:.2f}}', round_even(({e}) * 1e2, 0) / 1e2)"


# reasons for r.operator on r.machine and r.part, and for r.machine and r.part
_OWHY = f"""concat_ws('; ',
  CASE WHEN wom.c IS NOT NULL THEN format('{{}} earlier jobs on {{}} at efficiency {{}}', wom.c, r.machine, {_two('wom.e')})
    ELSE format('new to {{}}; efficiency elsewhere {{}}', r.machine, {_two('coalesce(wo.a, 0.0E0)')}) END,
  CASE WHEN wop.c IS NOT NULL THEN format('knows part {{}} from {{}} jobs at efficiency {{}}', r.part, wop.c, {_two('wop.e')})
    WHEN r.part IS NOT NULL THEN format('new to part {{}}', r.part) END,
  CASE WHEN wo.cons > 0.8 THEN 'steady results' END, CASE WHEN wo.nm * wo.np > 10 THEN 'used to changing work' END)"""
_OWHY_JOINS = """LEFT JOIN ops wo ON wo.operator = r.operator LEFT JOIN om wom ON wom.o = r.operator AND wom.m = r.machine
LEFT JOIN opp wop ON wop.o = r.operator AND wop.p = r.part"""
_MWHY = f"""concat_ws('; ', CASE WHEN wmp.c IS NOT NULL THEN format('made part {{}} in {{}} jobs', r.part, wmp.c) END,
  CASE WHEN wmp.c IS NOT NULL THEN format('the part runs here at efficiency {{}}', {_two('wmp.e')}) END,
  CASE WHEN wm.a > 0.8 THEN format('efficient machine, {{}} on average', {_two('wm.a')}) END,
  CASE WHEN wm.util > 0.7 THEN 'little standstill' END)"""
_MWHY_JOINS = "LEFT JOIN mach wm ON wm.machine = r.machine LEFT JOIN mp wmp ON wmp.m = r.machine AND wmp.p = r.part"


@query("rec9_machine_reasons", sql(f"""
SELECT r.part, r.machine, {r6('r.score')} AS score, r.confidence, r.rank, {_MWHY} AS reasons
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, machine) AS rank FROM ({_m_scores('pkeys')}))
  WHERE rank <= 3) r {_MWHY_JOINS}""", "F", ",\n".join([_JOBS, _FIT, _PKEYS])))
def rec9_machines(spark, d):
    m = fitted(spark, d)
    recs = RC.rank_machines(m, jobs_table(spark, d).where(F_.col("part").isNotNull()), 3)
    return RC.machine_reasons(m, recs).withColumn("reasons", F_.array_join("reasons", "; "))


_C7 = "CASE WHEN om.e IS NOT NULL THEN om.e * 0.3 END"
_MOSCORE = _cap("((CASE WHEN mp.e IS NOT NULL THEN mp.e * 0.7 ELSE mach.a * 0.5 END) + coalesce(mp.e * 0.6, 0.0E0) "
                f"+ mach.a * 0.4 + mach.util * 0.2 + coalesce({_C7}, 0.0E0)) / "
                "(3 + CAST(mp.e IS NOT NULL AS INTEGER) + CAST(om.e IS NOT NULL AS INTEGER))")
_MOCONF = _conf("om.c", "opp.c", "mp.c", "k.operator IS NOT NULL", "(k.operator IS NOT NULL AND k.part IS NOT NULL)",
                "(k.part IS NOT NULL)")
_MOKEYS = "mokeys AS (SELECT DISTINCT PartNumber AS part, OperatorName AS operator FROM joblog WHERE OpNumber = 2)"


@query("rec7_machines_for_part_and_operator", sql(f"""
SELECT part, operator, machine, {r6('score')} AS score, confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY part, operator ORDER BY score DESC, machine) AS rank FROM (
    SELECT k.part, k.operator, mach.machine, {_MOSCORE} AS score, {_MOCONF} AS confidence
    FROM mokeys k CROSS JOIN mach LEFT JOIN mp ON mp.m = mach.machine AND mp.p = k.part
    LEFT JOIN om ON om.m = mach.machine AND om.o = k.operator LEFT JOIN opp ON opp.o = k.operator AND opp.p = k.part))
WHERE rank <= 3""", "F", ",\n".join([_FIT, _MOKEYS])))
def rec7(spark, d):
    """Machines for the jobs that arrive without one (second operations), their operator given."""
    asked = J(spark, d).where("OpNumber = 2").select(F_.col("PartNumber").alias("part"), F_.col("OperatorName").alias("operator"))
    return RC.rank_machines(fitted(spark, d), asked, 3)


@query("rec12_batch_assignment", sql(f"""
SELECT job_id, machine, part, recommended_machine, recommended_operator, {r6('expected_performance')} AS expected_performance,
  confidence FROM assign""", "F", ",\n".join([_JOBS, _FIT, _BATCH])))
def rec12(spark, d):
    return RC.batch_assignment(fitted(spark, d), jobs_table(spark, d))


@query("rec12_assignment_reasons", sql(f"""
SELECT r.job_id, r.machine, r.part, r.recommended_machine, r.recommended_operator,
  coalesce(nullif(concat_ws('; ', nullif(r.machine_why, ''), nullif(r.operator_why, '')), ''), 'no history to go by') AS reasons
FROM (SELECT a.job_id, a.machine, a.part, a.recommended_machine, a.recommended_operator,
  CASE WHEN a.machine IS NULL THEN mw.why END AS machine_why, ow.why AS operator_why FROM assign a
  LEFT JOIN (SELECT r.part, r.machine, {_MWHY} AS why FROM bm r {_MWHY_JOINS}) mw
    ON mw.part = a.part AND mw.machine = a.recommended_machine
  LEFT JOIN (SELECT r.machine, r.part, r.operator, {_OWHY} AS why FROM
    (SELECT machine, part, operator FROM best1 UNION SELECT machine, part, operator FROM best3) r {_OWHY_JOINS}) ow
    ON ow.machine = a.recommended_machine AND ow.part IS NOT DISTINCT FROM a.part AND ow.operator = a.recommended_operator) r""",
                                         "F", ",\n".join([_JOBS, _FIT, _BATCH])))
def rec12_reasons(spark, d):
    found = RC.batch_assignment(fitted(spark, d), jobs_table(spark, d), reasons=True)
    return found.drop("expected_performance", "confidence").withColumn("reasons", F_.array_join("reasons", "; "))


@query("agg36_assignment_report", sql(f"""
SELECT count(*) AS total_assignments, count(*) FILTER (WHERE expected_performance > 0.8) AS high_performance_count,
  count(*) FILTER (WHERE expected_performance >= 0.6 AND expected_performance <= 0.8) AS medium_performance_count,
  count(*) FILTER (WHERE expected_performance < 0.6) AS low_performance_count,
  {r6('avg(expected_performance)')} AS average_expected_performance,
  count(*) FILTER (WHERE confidence = 'High') AS high_confidence, count(*) FILTER (WHERE confidence = 'Medium') AS medium_confidence,
  count(*) FILTER (WHERE confidence = 'Low') AS low_confidence,
  count(*) FILTER (WHERE confidence = 'Low' AND expected_performance < 0.6) AS high_risk_assignments,
  (SELECT CASE WHEN max(c) > max(t) * 0.4 THEN coalesce(array_to_string(list_sort(list(op) FILTER (WHERE c > t * 0.3)), ','), '') ELSE '' END
   FROM (SELECT recommended_operator AS op, count(*) AS c, (SELECT count(*) FROM assign) AS t FROM assign
         GROUP BY recommended_operator)) AS overloaded_operators
FROM assign""", "F", ",\n".join([_JOBS, _FIT, _BATCH])))
def agg36(spark, d):
    return RC.assignment_report(RC.batch_assignment(fitted(spark, d), jobs_table(spark, d)))


@query("agg36_high_risk_assignments", sql(f"""
SELECT job_id, machine, part, recommended_machine, recommended_operator, {r6('expected_performance')} AS expected_performance
FROM assign WHERE confidence = 'Low' AND expected_performance < 0.6""", "F", ",\n".join([_JOBS, _FIT, _BATCH])))
def agg36_risk(spark, d):
    return RC.high_risk_assignments(RC.batch_assignment(fitted(spark, d), jobs_table(spark, d)))


@query("rec1_operator_profiles", sql(f"""
SELECT operator AS OperatorName, {r6('a')} AS avg_efficiency, {r6('s')} AS efficiency_std, {r6('st')} AS avg_setup_time,
  {r6('pph')} AS avg_parts_per_hour, n AS total_jobs, {r6('dt')} AS avg_downtime, nm AS machines_operated,
  np AS parts_worked, nm * np AS versatility_score, {r6('cons')} AS consistency_score,
  {r6('1 / (1 + st / 1000)')} AS setup_expertise FROM ops""", "F", _FIT))
def rec1(spark, d):
    return RC.operator_profiles(F(spark, d))


@query("rec2_machine_profiles", sql(f"""
SELECT machine, {r6('avg(efficiency)')} AS avg_efficiency, {r6('stddev_samp(efficiency)')} AS efficiency_std,
  {r6('avg(JobDuration)')} AS avg_job_duration, {r6('avg(SetupTime)')} AS avg_setup_time, count(*) AS total_jobs,
  count(DISTINCT OperatorName) AS operators_used, count(DISTINCT PartNumber) AS parts_produced,
  {r6('sum(RunningTime) / (sum(RunningTime) + sum(total_downtime))')} AS utilization_rate,
  {r6('avg(SetupTime) / 1000')} AS complexity_score, {r6('1 / (1 + avg(MaintenanceTime) / 1000)')} AS reliability_score
FROM F GROUP BY machine"""))
def rec2(spark, d):
    return RC.machine_profiles(F(spark, d))


@query("rec3_part_profiles", sql(f"""
SELECT PartNumber, {r6('avg(efficiency)')} AS avg_efficiency, {r6('avg(SetupTime)')} AS avg_setup_time,
  {r6('avg(PartsProduced)')} AS avg_parts_per_job, count(*) AS total_jobs, count(DISTINCT machine) AS machines_used,
  count(DISTINCT OperatorName) AS operators_used, count(*) AS production_frequency,
  {r6('avg(SetupTime) / 1000')} AS complexity_score, {r6('count(*) / (SELECT count(*) FROM F)')} AS demand
FROM F WHERE PartNumber <> 'Unknown' GROUP BY PartNumber"""))
def rec3(spark, d):
    return RC.part_profiles(F(spark, d))


@query("rec4_operator_machine_pairs", sql("""
SELECT OperatorName, machine, round_even(avg(efficiency) * 1e3, 0) / 1e3 AS efficiency, count(*) AS job_count,
  round_even(avg(SetupTime) * 1e3, 0) / 1e3 AS setup_time FROM F WHERE OperatorName <> 'Unknown'
GROUP BY OperatorName, machine HAVING count(*) >= 2"""))
def rec4(spark, d):
    return RC.pair_tables(F(spark, d))["operator_machine"]


_PAIR_COLUMNS = """round_even(avg(efficiency) * 1e3, 0) / 1e3 AS efficiency, count(*) AS job_count,
  round_even(avg(SetupTime) * 1e3, 0) / 1e3 AS setup_time FROM F"""


@query("rec4_operator_part_pairs", sql(f"""SELECT OperatorName, PartNumber, {_PAIR_COLUMNS}
WHERE OperatorName <> 'Unknown' AND PartNumber <> 'Unknown' GROUP BY OperatorName, PartNumber"""))
def rec4_operator_part(spark, d):
    return RC.pair_tables(F(spark, d))["operator_part"]


@query("rec4_machine_part_pairs", sql(f"""SELECT machine, PartNumber, {_PAIR_COLUMNS}
WHERE PartNumber <> 'Unknown' GROUP BY machine, PartNumber"""))
def rec4_machine_part(spark, d):
    return RC.pair_tables(F(spark, d))["machine_part"]


@query("rec13_fit_summary", sql("""
SELECT 'operator_profiles' AS "table", count(*) AS n FROM ops UNION ALL SELECT 'machine_profiles', count(*) FROM mach
UNION ALL SELECT 'part_profiles', count(DISTINCT PartNumber) FROM F WHERE PartNumber <> 'Unknown'
UNION ALL SELECT 'operator_machine_pairs', count(*) FROM om UNION ALL SELECT 'operator_part_pairs', count(*) FROM opp
UNION ALL SELECT 'machine_part_pairs', count(*) FROM mp""", "F", _FIT))
def rec13(spark, d):
    return RC.fit_summary(fitted(spark, d))


@query("rec9_recommendation_reasons", sql(f"""
SELECT r.machine, r.part, r.operator, {r6('r.score')} AS score, r.confidence, r.rank, {_OWHY} AS reasons
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine, part ORDER BY score DESC, operator) AS rank
  FROM ({_op_scores('keys5')})) WHERE rank <= 3) r {_OWHY_JOINS}""", "F", ",\n".join([_JOBS, _FIT, _KEYS5])))
def rec9(spark, d):
    m = fitted(spark, d)
    recs = RC.rank_operators(m, jobs_table(spark, d).where(F_.col("machine").isNotNull()), 3)
    return RC.operator_reasons(m, recs).withColumn("reasons", F_.array_join("reasons", "; "))
