"""Registered performance-matrix queries with DuckDB oracles."""

from __future__ import annotations

from ..operators import matrices as MX
from .oracle import cap1, perf, r6, rel_cons, rn, sql
from .registry import query
from .tables import F


def _r3(pairs) -> str:
    return ", ".join(f"{rn(e, 3)} AS {n}" for n, e in pairs)


_CONF5 = ("CASE WHEN job_count > 0 AND job_count <= 2 THEN 'Very Low' WHEN job_count > 2 AND job_count <= 5 THEN 'Low' "
          "WHEN job_count > 5 AND job_count <= 15 THEN 'Medium' WHEN job_count > 15 AND job_count <= 50 THEN 'High' "
          "WHEN job_count > 50 THEN 'Very High' END")

OM = f"""om AS (
SELECT m.*, {perf('avg_efficiency', cap1('avg_parts_per_hour / 10'), rel_cons('efficiency_std', 'avg_efficiency'))} AS performance_score,
  {_CONF5} AS confidence_level, o.operator_avg_efficiency, avg_efficiency / o.operator_avg_efficiency AS specialization_factor
FROM (SELECT OperatorName, machine, count(JobDuration) AS job_count,
  {_r3([('avg_efficiency', 'avg(efficiency)'), ('efficiency_std', 'stddev_samp(efficiency)'), ('min_efficiency', 'min(efficiency)'),
        ('max_efficiency', 'max(efficiency)'), ('avg_parts_per_hour', 'avg(parts_per_hour)'), ('avg_setup_time', 'avg(SetupTime)'),
        ('avg_downtime', 'avg(total_downtime)'), ('total_parts', 'sum(PartsProduced)')])}
  FROM F WHERE OperatorName <> 'Unknown' GROUP BY OperatorName, machine) m
LEFT JOIN (SELECT OperatorName AS o_op, avg(efficiency) AS operator_avg_efficiency FROM F WHERE OperatorName <> 'Unknown'
  GROUP BY OperatorName) o ON m.OperatorName = o.o_op)"""

OP = f"""opm AS (
SELECT m.*, {perf('avg_efficiency', cap1('avg_parts_per_hour / 5'), rel_cons('efficiency_std', 'avg_efficiency'))} AS expertise_score,
  p.part_complexity, o.operator_avg_complexity, p.part_complexity / o.operator_avg_complexity AS complexity_ratio
FROM (SELECT OperatorName, PartNumber, count(JobDuration) AS job_count,
  {_r3([('avg_efficiency', 'avg(efficiency)'), ('efficiency_std', 'stddev_samp(efficiency)'), ('avg_setup_time', 'avg(SetupTime)'),
        ('total_parts', 'sum(PartsProduced)'), ('avg_parts_per_job', 'avg(PartsProduced)'), ('avg_parts_per_hour', 'avg(parts_per_hour)')])}
  FROM F WHERE OperatorName <> 'Unknown' AND PartNumber <> 'Unknown' GROUP BY OperatorName, PartNumber) m
LEFT JOIN (SELECT PartNumber AS p_part, avg(SetupTime) AS part_complexity FROM F WHERE OperatorName <> 'Unknown' AND PartNumber <> 'Unknown'
  GROUP BY PartNumber) p ON m.PartNumber = p.p_part
LEFT JOIN (SELECT OperatorName AS o_op, avg(SetupTime) AS operator_avg_complexity FROM F WHERE OperatorName <> 'Unknown' AND PartNumber <> 'Unknown'
  GROUP BY OperatorName) o ON m.OperatorName = o.o_op)"""

MP = f"""mp AS (
SELECT m.*, {perf('avg_efficiency', cap1('avg_parts_per_hour / 8'), rel_cons('efficiency_std', 'avg_efficiency'))} AS suitability_score,
  p.part_avg_setup, CASE WHEN avg_setup_time = 0 THEN NULL ELSE p.part_avg_setup / avg_setup_time END AS setup_efficiency
FROM (SELECT machine, PartNumber, count(JobDuration) AS job_count,
  {_r3([('avg_efficiency', 'avg(efficiency)'), ('efficiency_std', 'stddev_samp(efficiency)'), ('avg_setup_time', 'avg(SetupTime)'),
        ('avg_running_time', 'avg(RunningTime)'), ('total_parts', 'sum(PartsProduced)'), ('avg_parts_per_hour', 'avg(parts_per_hour)')])}
  FROM F WHERE PartNumber <> 'Unknown' GROUP BY machine, PartNumber) m
LEFT JOIN (SELECT PartNumber AS p_part, avg(SetupTime) AS part_avg_setup FROM F WHERE PartNumber <> 'Unknown'
  GROUP BY PartNumber) p ON m.PartNumber = p.p_part)"""

_V3 = "FROM F WHERE OperatorName <> 'Unknown' AND PartNumber <> 'Unknown'"
OMP = f"""omp AS (
SELECT m.*, {perf('avg_efficiency', cap1('avg_parts_per_hour / 6'), rel_cons('efficiency_std', 'avg_efficiency'))} AS synergy_score,
  ob.operator_baseline, mb.machine_baseline, pb.part_baseline,
  avg_efficiency - ob.operator_baseline AS operator_synergy, avg_efficiency - mb.machine_baseline AS machine_synergy,
  avg_efficiency - (ob.operator_baseline + mb.machine_baseline + pb.part_baseline) / 3 AS overall_synergy
FROM (SELECT OperatorName, machine, PartNumber, count(JobDuration) AS job_count,
  {_r3([('avg_efficiency', 'avg(efficiency)'), ('efficiency_std', 'stddev_samp(efficiency)'), ('avg_setup_time', 'avg(SetupTime)'),
        ('avg_parts_per_hour', 'avg(parts_per_hour)'), ('avg_downtime', 'avg(total_downtime)')])}
  {_V3} GROUP BY OperatorName, machine, PartNumber HAVING count(JobDuration) >= 2) m
LEFT JOIN (SELECT OperatorName AS k, avg(efficiency) AS operator_baseline {_V3} GROUP BY OperatorName) ob ON m.OperatorName = ob.k
LEFT JOIN (SELECT machine AS k, avg(efficiency) AS machine_baseline {_V3} GROUP BY machine) mb ON m.machine = mb.k
LEFT JOIN (SELECT PartNumber AS k, avg(efficiency) AS part_baseline {_V3} GROUP BY PartNumber) pb ON m.PartNumber = pb.k)"""

TM = f"""tm AS (
SELECT *, CASE WHEN hour >= 6 AND hour < 14 THEN 'Day' WHEN hour >= 14 AND hour < 22 THEN 'Evening' ELSE 'Night' END AS shift,
  ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][day_of_week + 1] AS day_name
FROM (SELECT hour, day_of_week, count(JobDuration) AS job_count,
  {_r3([('avg_efficiency', 'avg(efficiency)'), ('efficiency_std', 'stddev_samp(efficiency)'),
        ('avg_parts_per_hour', 'avg(parts_per_hour)'), ('avg_downtime', 'avg(total_downtime)')])}
  FROM F GROUP BY hour, day_of_week))"""

MATS = ",\n".join([OM, OP, MP, OMP, TM])


def _pub(cols_double, table, other, where=""):
    sel = ", ".join(other + [f"{r6(c)} AS {c}" for c in cols_double])
    return f"SELECT {sel} FROM {table} {where}"


@query("mat1_operator_machine_matrix", sql(_pub(
    ["performance_score", "operator_avg_efficiency", "specialization_factor"], "om",
    ["OperatorName", "machine", "job_count", "avg_efficiency", "efficiency_std", "min_efficiency", "max_efficiency",
     "avg_parts_per_hour", "avg_setup_time", "avg_downtime", "total_parts", "confidence_level"]), "F", MATS))
def mat1(spark, d):
    return MX.operator_machine_matrix(F(spark, d))


@query("mat2_operator_part_matrix", sql(_pub(
    ["expertise_score", "part_complexity", "operator_avg_complexity", "complexity_ratio"], "opm",
    ["OperatorName", "PartNumber", "job_count", "avg_efficiency", "efficiency_std", "avg_setup_time", "total_parts",
     "avg_parts_per_job", "avg_parts_per_hour"]), "F", MATS))
def mat2(spark, d):
    return MX.operator_part_matrix(F(spark, d))


@query("mat3_machine_part_matrix", sql(_pub(
    ["suitability_score", "part_avg_setup", "setup_efficiency"], "mp",
    ["machine", "PartNumber", "job_count", "avg_efficiency", "efficiency_std", "avg_setup_time", "avg_running_time",
     "total_parts", "avg_parts_per_hour"]), "F", MATS))
def mat3(spark, d):
    return MX.machine_part_matrix(F(spark, d))


@query("mat4_three_way_matrix", sql(_pub(
    ["synergy_score", "operator_baseline", "machine_baseline", "part_baseline", "operator_synergy", "machine_synergy",
     "overall_synergy"], "omp",
    ["OperatorName", "machine", "PartNumber", "job_count", "avg_efficiency", "efficiency_std", "avg_setup_time",
     "avg_parts_per_hour", "avg_downtime"]), "F", MATS))
def mat4(spark, d):
    return MX.three_way_matrix(F(spark, d))


@query("mat5_time_matrix", sql("""SELECT CAST(hour AS BIGINT) AS hour, CAST(day_of_week AS BIGINT) AS day_of_week,
  job_count, avg_efficiency, efficiency_std, avg_parts_per_hour, avg_downtime, shift, day_name FROM tm""", "F", MATS))
def mat5(spark, d):
    return MX.time_matrix(F(spark, d))


def _combo(table, name, metric, k, keys, asc=False, where="TRUE"):
    order = "ASC" if asc else "DESC"
    cols = {c: (c if c in keys else "CAST(NULL AS VARCHAR)") for c in ("OperatorName", "machine", "PartNumber")}
    sel = ", ".join(f"{v} AS {c}" for c, v in cols.items())
    return f"""SELECT '{name}' AS list, rank, {sel}, '{metric}' AS metric, {r6(f'CAST({metric} AS DOUBLE)')} AS value,
  avg_efficiency, CAST(job_count AS BIGINT) AS job_count FROM (
  SELECT *, row_number() OVER (ORDER BY {metric} {order}, {', '.join(keys)}) AS rank FROM {table}
  WHERE ({where}) AND {metric} IS NOT NULL) WHERE rank <= {k}"""


_OMK, _OPK, _MPK, _3K = ["OperatorName", "machine"], ["OperatorName", "PartNumber"], ["machine", "PartNumber"], [
    "OperatorName", "machine", "PartNumber"]


@query("mat7_optimal_combinations", sql("\nUNION ALL\n".join([
    _combo("om", "top_operator_machine", "performance_score", 10, _OMK, where="confidence_level IN ('High', 'Very High')"),
    _combo("om", "specialized_combinations", "specialization_factor", 5, _OMK, where="specialization_factor > 1.1"),
    _combo("opm", "top_operator_part", "expertise_score", 10, _OPK, where="job_count >= 3"),
    _combo("mp", "top_machine_part", "suitability_score", 10, _MPK, where="job_count >= 5"),
    _combo("omp", "top_3d_combinations", "synergy_score", 10, _3K),
    _combo("omp", "high_synergy_combinations", "overall_synergy", 5, _3K, where="overall_synergy > 0.05"),
]), "F", MATS))
def mat7(spark, d):
    return MX.optimal_combinations(MX.performance_matrices(F(spark, d)))


@query("mat8_improvement_opportunities", sql("\nUNION ALL\n".join([
    _combo("om", "underperforming_operator_machine", "performance_score", 10, _OMK, True,
           "job_count >= 5 AND performance_score < 0.6"),
    _combo("om", "inconsistent_combinations", "efficiency_std", 10, _OMK, where="job_count >= 3 AND efficiency_std > 0.15"),
]), "F", MATS))
def mat8(spark, d):
    return MX.improvement_opportunities(MX.performance_matrices(F(spark, d)))


_CTR = """strong AS (SELECT * FROM om WHERE performance_score > 0.8 AND job_count >= 3),
sop AS (SELECT OperatorName, avg(avg_setup_time) AS cur, array_to_string(list_sort(list_distinct(list(machine))), ',') AS cs
  FROM strong GROUP BY OperatorName),
smach AS (SELECT machine, avg(avg_setup_time) AS ms FROM om GROUP BY machine),
ct AS (SELECT sop.OperatorName AS operator, smach.machine AS recommended_machine, 1 / (1 + abs(cur - ms) / 100) AS similarity_score,
  cs AS current_strong_machines,
  format('mean setup {} s there, {} s on known machines', CAST(round_even(ms, 0) AS BIGINT), CAST(round_even(cur, 0) AS BIGINT)) AS reason
  FROM sop CROSS JOIN smach
  WHERE NOT EXISTS (SELECT 1 FROM strong s WHERE s.OperatorName = sop.OperatorName AND s.machine = smach.machine)),
ct3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY similarity_score DESC, recommended_machine) AS r
  FROM ct) WHERE r <= 3)"""


@query("mat9_cross_training", sql(f"""
SELECT operator, recommended_machine, {r6('similarity_score')} AS similarity_score, current_strong_machines, reason, rank FROM (
  SELECT *, row_number() OVER (ORDER BY similarity_score DESC, operator, recommended_machine) AS rank FROM ct3) WHERE rank <= 10""",
                                 "F", MATS + ",\n" + _CTR))
def mat9(spark, d):
    return MX.cross_training(MX.operator_machine_matrix(F(spark, d)))


_MO = """mpr AS (SELECT PartNumber, machine, avg_efficiency,
  row_number() OVER (PARTITION BY PartNumber ORDER BY avg_efficiency DESC, machine) AS b,
  row_number() OVER (PARTITION BY PartNumber ORDER BY avg_efficiency ASC, machine) AS w,
  count(*) OVER (PARTITION BY PartNumber) AS n FROM mp),
mo AS (SELECT x.PartNumber AS part_number, x.machine AS recommended_machine, x.avg_efficiency AS potential_efficiency,
  y.machine AS current_machine, y.avg_efficiency AS current_efficiency, x.avg_efficiency - y.avg_efficiency AS efficiency_gain
  FROM mpr x JOIN mpr y ON x.PartNumber = y.PartNumber AND x.b = 1 AND y.w = 1 AND x.n > 1
  WHERE x.avg_efficiency - y.avg_efficiency > 0.1)"""


@query("mat10_machine_optimization", sql(f"""
SELECT part_number, recommended_machine, potential_efficiency, current_machine, current_efficiency,
  {r6('efficiency_gain')} AS efficiency_gain, rank FROM (
  SELECT *, row_number() OVER (ORDER BY efficiency_gain DESC, part_number) AS rank FROM mo) WHERE rank <= 10""",
                                        "F", MATS + ",\n" + _MO))
def mat10(spark, d):
    return MX.machine_optimization(MX.machine_part_matrix(F(spark, d)))


def _stat(name, table, has_score):
    score = r6("avg(performance_score)") if has_score else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{name}' AS matrix, {r6('avg(avg_efficiency)')} AS mean_efficiency, {r6('median(avg_efficiency)')} AS median_efficiency,
  {r6('stddev_samp(avg_efficiency)')} AS std_efficiency, min(avg_efficiency) AS min_efficiency, max(avg_efficiency) AS max_efficiency,
  count(*) AS combinations_count, {score} AS mean_performance_score, CAST(sum(job_count) AS BIGINT) AS total_jobs,
  {r6('avg(job_count)')} AS avg_jobs_per_combination FROM {table}"""


@query("mat11_matrix_statistics", sql("\nUNION ALL\n".join([
    _stat("operator_machine", "om", True), _stat("operator_part", "opm", False), _stat("machine_part", "mp", False),
    _stat("operator_machine_part", "omp", False), _stat("time_performance", "tm", False)]), "F", MATS))
def mat11(spark, d):
    return MX.matrix_statistics(MX.performance_matrices(F(spark, d)))


def _tr(key, name, asc):
    order = "ASC" if asc else "DESC"
    return f"""SELECT '{name}' AS trend, key, {r6("value")} AS value, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY value {order}, key) AS rank FROM (
    SELECT CAST({key} AS VARCHAR) AS key, avg(avg_efficiency) AS value FROM tm GROUP BY {key})) WHERE rank <= 3"""


@query("top5_time_trends", sql("\nUNION ALL\n".join([
    _tr("hour", "best_hours", False), _tr("hour", "worst_hours", True), _tr("day_name", "best_days", False),
    _tr("day_name", "worst_days", True),
    f"SELECT 'shift_performance', shift, {r6('avg(avg_efficiency)')}, CAST(NULL AS BIGINT) FROM tm GROUP BY shift"]),
    "F", MATS))
def top5(spark, d):
    return MX.time_trends(MX.time_matrix(F(spark, d)))


@query("agg28_performance_score_pivot", sql(f"""
SELECT o.OperatorName, m.machine, {r6('coalesce(c.performance_score, 0.0E0)')} AS performance_score
FROM (SELECT DISTINCT OperatorName FROM om) o CROSS JOIN (SELECT DISTINCT machine FROM om) m
LEFT JOIN om c ON c.OperatorName = o.OperatorName AND c.machine = m.machine""", "F", MATS))
def agg28_scores(spark, d):
    wide = MX.score_pivot(MX.operator_machine_matrix(F(spark, d)))
    return wide.unpivot("OperatorName", None, "machine", "performance_score")
