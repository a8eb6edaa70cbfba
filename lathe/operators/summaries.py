"""Performance summaries and aggregates (AGG1-AGG8, AGG12, AGG13, AGG16, AGG17, AGG20-AGG38).

All are hash aggregates with partial (map-side) combine; per-key results are
small and are joined back with AQE choosing broadcast from runtime sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles, literal
from ..functions.exprs import (avg_rank_desc, cap1, cut, floor_days_between, not_unknown, perf_score,
                               rel_consistency, rnd, row_sum, sdiv, trunc_ntz)
from ..schema import DOWNTIME


def _named(spec: dict[str, Column], digits: int | None) -> list[Column]:
    return [(rnd(c, digits) if digits is not None else c).alias(n) for n, c in spec.items()]


# --------------------------------------------------------------------------- AGG1/AGG2 (raw log SQL)

def summary_stats(J: DataFrame) -> DataFrame:
    """AGG1: one row of table-level statistics over the raw log."""
    valid = F.year("StartTime") > 1970
    return J.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("machine").alias("unique_machines"),
        F.countDistinct("OperatorName").alias("unique_operators"),
        F.countDistinct("PartNumber").alias("unique_parts"),
        F.min(F.when(valid, F.col("StartTime"))).alias("min_date"),
        F.max(F.when(valid, F.col("StartTime"))).alias("max_date"),
    )


def job_states(J: DataFrame) -> DataFrame:
    """AGG1 (states part): rows per State, NULL State included."""
    return J.groupBy("State").agg(F.count(F.lit(1)).alias("count"))


def downtime_analysis(J: DataFrame) -> DataFrame:
    """AGG2: downtime by machine x operator x part x day (SQL NULL semantics of a + b)."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in DOWNTIME])
    return (
        J.where(F.year("StartTime") > 1970)
        .groupBy("machine", "OperatorName", "PartNumber", F.to_date("StartTime").alias("job_date"))
        .agg(
            F.count(F.lit(1)).alias("job_count"),
            F.avg("JobDuration").alias("avg_job_duration"),
            F.avg("RunningTime").alias("avg_running_time"),
            F.avg("SetupTime").alias("avg_setup_time"),
            F.avg("MaintenanceTime").alias("avg_maintenance_time"),
            F.avg("IdleTime").alias("avg_idle_time"),
            F.sum(total).alias("total_downtime"),
        )
        .where(F.col("total_downtime") > 0)
        .orderBy(F.col("job_date").desc(), F.col("total_downtime").desc())
    )


# --------------------------------------------------------------------------- AGG3-AGG7 (auxiliary tables)

def machine_summary(F_: DataFrame) -> DataFrame:
    """AGG3: machine performance summary with ranks and composite score."""
    spec = {
        "total_jobs": F.count("JobDuration"),
        "avg_job_duration": F.avg("JobDuration"),
        "job_duration_std": F.stddev_samp("JobDuration"),
        "avg_running_time": F.avg("RunningTime"),
        "total_running_time": F.sum("RunningTime"),
        "avg_efficiency": F.avg("efficiency"),
        "efficiency_std": F.stddev_samp("efficiency"),
        "min_efficiency": F.min("efficiency"),
        "max_efficiency": F.max("efficiency"),
        "total_parts": F.sum("PartsProduced"),
        "avg_parts_per_job": F.avg("PartsProduced"),
        "avg_parts_per_hour": F.avg("parts_per_hour"),
        "parts_per_hour_std": F.stddev_samp("parts_per_hour"),
        "avg_downtime_per_job": F.avg("total_downtime"),
        "total_downtime": F.sum("total_downtime"),
        "avg_setup_time": F.avg("SetupTime"),
        "total_setup_time": F.sum("SetupTime"),
        "avg_maintenance_time": F.avg("MaintenanceTime"),
        "total_maintenance_time": F.sum("MaintenanceTime"),
        "avg_idle_time": F.avg("IdleTime"),
        "total_idle_time": F.sum("IdleTime"),
    }
    aggs = [F.count("JobDuration").alias("total_jobs")] + _named({k: v for k, v in spec.items() if k != "total_jobs"}, 2)
    m = F_.groupBy("machine").agg(*aggs)
    m = m.withColumn("utilization_rate",
                     sdiv(F.col("total_running_time"), F.col("total_running_time") + F.col("total_downtime")))
    return m.withColumns({
        "efficiency_rank": avg_rank_desc("avg_efficiency"),
        "productivity_rank": avg_rank_desc("avg_parts_per_hour"),
        "performance_score": perf_score("avg_efficiency", cap1("utilization_rate"),
                                        rel_consistency("efficiency_std", "avg_efficiency")),
    })


def operator_summary(F_: DataFrame) -> DataFrame:
    """AGG4: operator performance summary (excl. Unknown)."""
    spec = {
        "avg_job_duration": F.avg("JobDuration"),
        "avg_efficiency": F.avg("efficiency"),
        "efficiency_std": F.stddev_samp("efficiency"),
        "min_efficiency": F.min("efficiency"),
        "max_efficiency": F.max("efficiency"),
        "total_parts": F.sum("PartsProduced"),
        "avg_parts_per_job": F.avg("PartsProduced"),
        "avg_parts_per_hour": F.avg("parts_per_hour"),
        "parts_per_hour_std": F.stddev_samp("parts_per_hour"),
        "avg_setup_time": F.avg("SetupTime"),
        "total_setup_time": F.sum("SetupTime"),
        "avg_downtime_per_job": F.avg("total_downtime"),
        "total_downtime": F.sum("total_downtime"),
    }
    o = (
        F_.where(not_unknown("OperatorName"))
        .groupBy("OperatorName")
        .agg(F.count("JobDuration").alias("total_jobs"),
             F.countDistinct("machine").alias("machines_operated"),
             F.countDistinct("PartNumber").alias("unique_parts"),
             *_named(spec, 2),
             F.min("StartTime").alias("first_job_date"), F.max("StartTime").alias("last_job_date"))
    )
    o = o.withColumn("experience_days", floor_days_between("first_job_date", "last_job_date"))
    o = o.withColumns({
        "jobs_per_day": sdiv(F.col("total_jobs"), F.col("experience_days") + 1),
        "versatility_score": F.col("machines_operated") * F.col("unique_parts"),
        "consistency_score": rel_consistency("efficiency_std", "avg_efficiency"),
    })
    return o.withColumns({
        "efficiency_rank": avg_rank_desc("avg_efficiency"),
        "productivity_rank": avg_rank_desc("avg_parts_per_hour"),
        "versatility_rank": avg_rank_desc("versatility_score"),
        "performance_score": perf_score("avg_efficiency", cap1("consistency_score"), "consistency_score"),
    })


CONFIDENCE4_EDGES = [0, 5, 15, 50, float("inf")]
CONFIDENCE4_LABELS = ["Low", "Medium", "High", "Very High"]


def operator_machine_summary(F_: DataFrame) -> DataFrame:
    """AGG5: operator x machine table with proficiency score and confidence level."""
    spec = {
        "avg_efficiency": F.avg("efficiency"),
        "efficiency_std": F.stddev_samp("efficiency"),
        "avg_parts_per_hour": F.avg("parts_per_hour"),
        "avg_setup_time": F.avg("SetupTime"),
        "avg_downtime": F.avg("total_downtime"),
    }
    m = (F_.where(not_unknown("OperatorName")).groupBy("OperatorName", "machine")
         .agg(F.count("JobDuration").alias("job_count"), *_named(spec, 3)))
    return m.withColumns({
        "proficiency_score": perf_score("avg_efficiency", F.lit(1.0), rel_consistency("efficiency_std", "avg_efficiency")),
        "confidence_level": cut("job_count", CONFIDENCE4_EDGES, CONFIDENCE4_LABELS),
    })


def operator_part_summary(F_: DataFrame) -> DataFrame:
    """AGG6: operator x part table with specialization score."""
    spec = {
        "avg_efficiency": F.avg("efficiency"),
        "efficiency_std": F.stddev_samp("efficiency"),
        "avg_parts_per_hour": F.avg("parts_per_hour"),
        "avg_setup_time": F.avg("SetupTime"),
        "avg_parts_per_job": F.avg("PartsProduced"),
    }
    m = (F_.where(not_unknown("OperatorName") & not_unknown("PartNumber")).groupBy("OperatorName", "PartNumber")
         .agg(F.count("JobDuration").alias("job_count"), *_named(spec, 3)))
    return m.withColumn(
        "specialization_score",
        perf_score("avg_efficiency", cap1(F.col("avg_parts_per_hour") / 10), rel_consistency("efficiency_std", "avg_efficiency")),
    )


def daily_utilization(F_: DataFrame) -> DataFrame:
    """AGG7: per (date, machine) utilization and efficiency vs the machine's mean."""
    spec = {
        "total_job_duration": F.sum("JobDuration"),
        "total_running_time": F.sum("RunningTime"),
        "total_downtime": F.sum("total_downtime"),
        "total_parts": F.sum("PartsProduced"),
        "avg_efficiency": F.avg("efficiency"),
    }
    daily = F_.groupBy(F.to_date("StartTime").alias("job_date"), "machine").agg(
        F.count("JobDuration").alias("job_count"), *_named(spec, 2))
    mach = F_.groupBy("machine").agg(F.avg("efficiency").alias("machine_avg_efficiency"))
    out = daily.join(mach, "machine", "left")
    return out.withColumns({
        "utilization_rate": sdiv(F.col("total_running_time"), F.col("total_running_time") + F.col("total_downtime")),
        "efficiency_vs_avg": F.try_divide(F.col("avg_efficiency"), F.col("machine_avg_efficiency")),
    })


def machine_trends(F_: DataFrame, window_days: int = 7) -> DataFrame:
    """WIN3: daily means per machine and a `window_days`-row rolling mean over the dates."""
    d = F_.groupBy("machine", F.to_date("StartTime").alias("job_date")).agg(
        F.avg("efficiency").alias("efficiency"), F.avg("parts_per_hour").alias("parts_per_hour"),
        F.avg("total_downtime").alias("total_downtime"))
    w = Window.partitionBy("machine").orderBy("job_date").rowsBetween(-(window_days - 1), 0)
    return d.withColumns({f"{m}_trend": F.avg(m).over(w) for m in ("efficiency", "parts_per_hour", "total_downtime")})


def operator_trends(F_: DataFrame, window_days: int = 7) -> DataFrame:
    """WIN4: the same per operator (excl. Unknown) for efficiency, pph and SetupTime."""
    d = F_.where(not_unknown("OperatorName")).groupBy("OperatorName", F.to_date("StartTime").alias("job_date")).agg(
        F.avg("efficiency").alias("efficiency"), F.avg("parts_per_hour").alias("parts_per_hour"),
        F.avg("SetupTime").alias("SetupTime"))
    w = Window.partitionBy("OperatorName").orderBy("job_date").rowsBetween(-(window_days - 1), 0)
    return d.withColumns({f"{m}_trend": F.avg(m).over(w) for m in ("efficiency", "parts_per_hour", "SetupTime")})


def auxiliary_tables(F_: DataFrame) -> dict[str, DataFrame]:
    """AGG8: all auxiliary tables as a named set of lazy frames over one F."""
    return {
        "machine_performance": machine_summary(F_),
        "operator_performance": operator_summary(F_),
        "operator_machine_matrix": operator_machine_summary(F_),
        "operator_part_matrix": operator_part_summary(F_),
        "daily_utilization": daily_utilization(F_),
        "machine_trends": machine_trends(F_),
        "operator_trends": operator_trends(F_),
    }


# --------------------------------------------------------------------------- AGG12/AGG13 (SQL summaries)

def sql_machine_summary(J: DataFrame) -> DataFrame:
    """AGG12: SQL machine summary; a zero running time gives a skipped NULL rate."""
    J_, R, P = F.col("JobDuration"), F.col("RunningTime"), F.col("PartsProduced")
    return (
        J.where((J_ > 0) & (F.year("StartTime") > 1970)).groupBy("machine")
        .agg(F.count(F.lit(1)).alias("total_jobs"),
             F.avg(F.when(J_ > 0, R / J_).otherwise(F.lit(0.0))).alias("avg_efficiency"),
             F.avg(J_).alias("avg_job_duration"),
             F.sum(P).alias("total_parts_produced"),
             F.avg(F.try_divide(P, R / 3600.0)).alias("avg_parts_per_hour"))
    )


def sql_operator_summary(J: DataFrame) -> DataFrame:
    """AGG13: SQL operator summary (operator not NULL)."""
    J_, R = F.col("JobDuration"), F.col("RunningTime")
    return (
        J.where(F.col("OperatorName").isNotNull() & (J_ > 0) & (F.year("StartTime") > 1970)).groupBy("OperatorName")
        .agg(F.count(F.lit(1)).alias("total_jobs"),
             F.countDistinct("machine").alias("machines_operated"),
             F.avg(F.when(J_ > 0, R / J_).otherwise(F.lit(0.0))).alias("avg_efficiency"),
             F.avg("SetupTime").alias("avg_setup_time"),
             F.sum("PartsProduced").alias("total_parts_produced"))
    )


# --------------------------------------------------------------------------- AGG16/AGG17

def efficiency_factors(F_: DataFrame) -> DataFrame:
    """AGG16: efficiency mean/std/count by machine and operator, mean by hour and weekday (long).
    One grouping-sets pass for the four keys."""
    keys = ["machine", "OperatorName", "hour", "day_of_week"]
    g = F_.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("_gid"), F.avg("efficiency").alias("mean"), F.stddev_samp("efficiency").alias("_std"), F.count("efficiency").alias("_n"))
    full = 2 ** len(keys) - 1
    which = {k: F.col("_gid") == full - 2 ** (len(keys) - 1 - i) for i, k in enumerate(keys)}
    factor, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, is_k in which.items():
        factor, key = F.when(is_k, F.lit(k)).otherwise(factor), F.when(is_k, F.col(k).cast("string")).otherwise(key)
    with_std = which["machine"] | which["OperatorName"]
    return g.select(factor.alias("factor"), key.alias("key"), "mean", F.when(with_std, F.col("_std")).alias("std"), F.when(with_std, F.col("_n")).alias("count"))


def downtime_patterns(F_: DataFrame) -> DataFrame:
    """AGG17: category totals, and category means by machine, operator (excl. Unknown) and hour (long).
    One grouping-sets pass over wide rows; only its small result is turned into long form."""
    keys = ["machine", "OperatorName", "hour"]
    g = F_.groupingSets([[], *[[k] for k in keys]], *keys).agg(
        F.grouping_id().alias("_gid"), *[F.avg(c).alias(f"_a_{c}") for c in DOWNTIME], *[F.sum(c).alias(f"_s_{c}") for c in DOWNTIME])
    total = F.col("_gid") == 7
    stack = ", ".join(f"'{c}', CASE WHEN _gid = 7 THEN _s_{c} ELSE _a_{c} END" for c in DOWNTIME)
    dimension = F.when(total, "total").when(F.col("_gid") == 3, "machine").when(F.col("_gid") == 5, "OperatorName").otherwise("hour")
    key = F.when(F.col("_gid") == 3, F.col("machine")).when(F.col("_gid") == 5, F.col("OperatorName")).when(F.col("_gid") == 6, F.col("hour").cast("string"))
    known = (F.col("_gid") != 5) | not_unknown("OperatorName")
    return g.where(known).select(dimension.alias("dimension"), key.alias("key"), F.expr(f"stack({len(DOWNTIME)}, {stack}) AS (category, value)"))


def _column_statistics(F_: DataFrame, cols, stats: dict) -> DataFrame:
    """One row per column with `stats` ({name: Column -> aggregate}): one wide aggregate, its single row then turned long."""
    wide = F_.agg(*[make(F.col(c).cast("double")).alias(f"{name}__{i}") for i, c in enumerate(cols) for name, make in stats.items()])
    stack = ", ".join(f"'{c}', " + ", ".join(f"{name}__{i}" for name in stats) for i, c in enumerate(cols))
    return wide.select(F.expr(f"stack({len(cols)}, {stack}) AS (`column`, {', '.join(f'`{n}`' for n in stats)})"))


# --------------------------------------------------------------------------- AGG20-AGG23

def headline_metrics(F_: DataFrame, threshold: float = 0.8) -> DataFrame:
    """AGG20: mean/std efficiency and the count and share above the threshold."""
    return F_.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.avg("efficiency").alias("avg_efficiency"),
        F.stddev_samp("efficiency").alias("efficiency_std"),
        F.count(F.when(F.col("efficiency") > threshold, 1)).alias("high_efficiency_jobs"),
    ).withColumn("high_efficiency_share", F.col("high_efficiency_jobs") / F.col("total_jobs"))


def downtime_summary(F_: DataFrame) -> DataFrame:
    """AGG21: setup/maintenance/idle hours and the category with the largest sum."""
    s = F_.agg(*[F.sum(c).alias(c) for c in DOWNTIME])
    mx = F.greatest(*[F.col(c) for c in DOWNTIME])
    arg = None
    for c in DOWNTIME:
        arg = F.when(F.col(c) == mx, F.lit(c)) if arg is None else arg.when(F.col(c) == mx, F.lit(c))
    return s.select(
        (F.col("SetupTime") / 3600).alias("total_setup_hours"),
        (F.col("MaintenanceTime") / 3600).alias("total_maintenance_hours"),
        (F.col("IdleTime") / 3600).alias("total_idle_hours"),
        arg.alias("top_downtime_category"),
    )


def top_performers(F_: DataFrame, group_col: str, metric_col: str = "efficiency", top_n: int = 5,
                   min_rows: int = 3, digits: int = 3) -> DataFrame:
    """TOP3: groups with at least `min_rows` rows ranked by their rounded mean metric (ties: key asc)."""
    g = F_.groupBy(group_col).agg(F.avg(metric_col).alias("_m"), F.count(F.lit(1)).alias("job_count")).where(
        F.col("job_count") >= min_rows)
    out = f"avg_{metric_col}"
    return g.select(group_col, rnd("_m", digits).alias(out), "job_count").orderBy(F.col(out).desc(), F.col(group_col)).limit(top_n)


def performance_overview(F_: DataFrame, days: int = 30, end=None, top_n: int = 5) -> DataFrame:
    """AGG22: one row about the jobs of the `days` before `end` (default: the latest start): jobs, mean
    efficiency, trend (WIN20), best machines and operators (TOP3, as "name:score:jobs, ..."), downtime (AGG21),
    jobs above 80 % and consistency."""
    from .windows import trend_label

    # as text, since a Python datetime would pass through the session's time zone
    last = F.lit(str(end) if end is not None else F_.agg(F.max("StartTime").cast("string")).first()[0]).cast("timestamp_ntz")
    recent = F_.where((F.col("StartTime") <= last) & (F.col("StartTime") >= last - F.make_dt_interval(F.lit(days))))

    def best(group: str) -> DataFrame:
        top = top_performers(recent, group, "efficiency", top_n)
        entry = F.struct((-F.col("avg_efficiency")).alias("o"), F.col(group).alias("g"),
                         F.concat_ws(":", F.col(group), F.format_number("avg_efficiency", 3), F.col("job_count")).alias("t"))
        return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), ", ").alias(f"top_{group}"))  # top_n rows

    head = headline_metrics(recent).select(
        F.lit(days).alias("period_days"), "total_jobs", F.col("avg_efficiency").alias("average_efficiency"),
        F.col("high_efficiency_jobs").alias("jobs_above_80_efficiency"), (1 / (1 + F.col("efficiency_std"))).alias("consistency_score"))
    for one_row in (trend_label(recent, "efficiency").select(F.col("trend").alias("efficiency_trend")), best("machine"), best("OperatorName"), downtime_summary(recent)):
        head = head.crossJoin(F.broadcast(one_row))
    return head


def period_metrics(F_: DataFrame, level: str = "day", machines=None, operators=None) -> DataFrame:
    """AGG38: efficiency, downtime minutes and jobs per period, per machine and operator."""
    unit = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}.get(level, level)
    d = F_
    if machines:
        d = d.where(F.col("machine").isin(*machines))
    if operators:
        d = d.where(F.col("OperatorName").isin(*operators))
    return d.groupBy(trunc_ntz(unit, "StartTime").alias("period"), "machine", "OperatorName").agg(
        F.avg("efficiency").alias("avg_efficiency"),
        (F.sum("total_downtime") / 60.0).alias("downtime_minutes"),
        F.count(F.lit(1)).alias("job_count"))


def time_of_day_frames(F_: DataFrame) -> DataFrame:
    """AGG24: per-hour mean efficiency, job count and mean downtime."""
    return F_.groupBy("hour").agg(F.avg("efficiency").alias("avg_efficiency"),
                                  F.count(F.lit(1)).alias("job_count"),
                                  F.avg("total_downtime").alias("avg_downtime"))


def weekday_frame(F_: DataFrame) -> DataFrame:
    """AGG24 (daily frame): the same per weekday name."""
    return F_.groupBy(F.date_format("StartTime", "EEEE").alias("day_name")).agg(
        F.avg("efficiency").alias("avg_efficiency"), F.count(F.lit(1)).alias("job_count"),
        F.avg("total_downtime").alias("avg_downtime"))


def machine_frame(F_: DataFrame) -> DataFrame:
    """AGG25: per-machine mean/std efficiency (3 dp), count, utilization and productivity."""
    return F_.groupBy("machine").agg(
        rnd(F.avg("efficiency"), 3).alias("avg_efficiency"),
        rnd(F.stddev_samp("efficiency"), 3).alias("efficiency_std"),
        F.count(F.lit(1)).alias("job_count"),
        (F.sum("RunningTime") / (F.sum("RunningTime") + F.sum("total_downtime"))).alias("utilization"),
        F.try_divide(F.sum("PartsProduced") * 3600.0, F.sum("RunningTime")).alias("productivity"),
        (F.avg("total_downtime") / 3600.0).alias("avg_downtime_hours"),
    )


def downtime_hours(F_: DataFrame) -> DataFrame:
    """AGG25: hours of downtime by category, of each machine and of all (`level` machine, all; machine is null for all), with the
    category's share of that level's downtime (null where there is none). One pass of partial sums; missing times count as none."""
    sums = F_.groupingSets([["machine"], []], "machine").agg(F.grouping("machine").alias("_all"), *[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in DOWNTIME])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in DOWNTIME])
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("s")) for c in DOWNTIME])
    return sums.select(F.when(F.col("_all") == 1, "all").otherwise("machine").alias("level"), "machine", total.alias("_t"), F.explode(each).alias("e")).select(
        "level", "machine", "e.category", (F.col("e.s") / 3600).alias("hours"), F.try_divide(F.col("e.s"), F.col("_t")).alias("share"))


def operator_frame(F_: DataFrame, min_jobs: int = 5) -> DataFrame:
    """AGG26: operators with at least `min_jobs` jobs: mean, std, count, consistency, versatility."""
    return (
        F_.groupBy("OperatorName").agg(
            F.avg("efficiency").alias("avg_efficiency"), F.stddev_samp("efficiency").alias("efficiency_std"),
            F.count(F.lit(1)).alias("job_count"), F.countDistinct("machine").alias("machines"),
            F.countDistinct("PartNumber").alias("parts"))
        .where(F.col("job_count") >= min_jobs)
        .withColumn("consistency", 1 / (1 + F.col("efficiency_std")))
    )


def histogram(F_: DataFrame, c: str = "efficiency", bins: int = 30, log1p: bool = False,
              upper_quantile: float | None = None) -> DataFrame:
    """AGG27: equal-width histogram over [min, max] of a column (optionally log1p and <= q)."""
    x = F.log1p(F.col(c)) if log1p else F.col(c)
    d = F_.select(x.alias("x")).where(F.col("x").isNotNull())
    if upper_quantile is not None:
        d = d.where(F.col("x") <= literal(exact_quantiles(d, {"x": [upper_quantile]})["x"][0]))
    r = d.agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    b = F.least(F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(b)
    return (d.crossJoin(F.broadcast(r)).groupBy(b.cast("bigint").alias("bin"), "_lo", "_hi")
            .agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / bins).alias("bin_start"),
                    "count"))


def pivot_operator_machine(F_: DataFrame, top_n: int = 10) -> DataFrame:
    """AGG28 + JN7: top-n operators (by job count) x machine mean efficiency, long form with 0 for
    missing cells. Machines are a small dimension: the pairs come from a distinct machine list."""
    counts = F_.groupBy("OperatorName").agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.col("_n").desc(), F.col("OperatorName")).limit(top_n).select("OperatorName")
    cells = F_.join(top, "OperatorName", "left_semi").groupBy("OperatorName", "machine").agg(
        F.avg("efficiency").alias("avg_efficiency"))
    machines = F_.select("machine").distinct()
    grid = top.crossJoin(machines)
    return grid.join(cells, ["OperatorName", "machine"], "left").fillna({"avg_efficiency": 0.0})


def describe_numeric(F_: DataFrame, cols) -> DataFrame:
    """AGG29: count, mean, std, min, quartiles (exact), max per numeric column (long)."""
    found = exact_quantiles(F_, {c: [0.25, 0.5, 0.75] for c in cols})
    of = F.create_map(*[x for c in cols for x in (F.lit(c), F.array(*map(literal, found[c])))])[F.col("column")]
    plain = _column_statistics(F_, cols, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    return plain.select("column", "count", "mean", "std", "min", of[0].alias("q25"), of[1].alias("q50"), of[2].alias("q75"), "max")


def value_counts(F_: DataFrame, cols) -> DataFrame:
    """AGG30: per categorical column its distinct count and the top values
    (top 10 if fewer than 20 distinct values, else top 5; ties by value)."""
    stack = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    longf = F_.select(F.expr(f"stack({len(cols)}, {stack}) AS (`column`, value)"))
    vc = longf.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    # ten best of each hash slice, then of each column; no task sees all values of a column
    slices = Window.partitionBy("column", F.pmod(F.xxhash64("value"), F.lit(256))).orderBy(F.col("count").desc(), F.col("value"))
    best = vc.withColumn("_s", F.row_number().over(slices)).where(F.col("_s") <= 10).drop("_s")
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value"))
    number = vc.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    best = best.withColumn("rank", F.row_number().over(w)).join(F.broadcast(number), "column")  # a row per column
    return best.where(F.col("rank") <= F.when(F.col("n_unique") < 20, 10).otherwise(5))


def feature_statistics(F_: DataFrame, cols) -> DataFrame:
    """AGG31: mean, std, min, max, missing ratio, zero ratio per numeric column (long)."""
    return _column_statistics(F_, cols, {
        "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
        "missing_ratio": lambda c: F.avg(c.isNull().cast("double")),
        "zeros_ratio": lambda c: F.avg(F.coalesce(c == 0, F.lit(False)).cast("double"))})


def correlations_with(F_: DataFrame, target: str, cols) -> DataFrame:
    """AGG32: Pearson correlation of each column with the target in one aggregate (long)."""
    wide = F_.agg(*[F.corr(F.col(c).cast("double"), F.col(target)).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.select(F.expr(f"stack({len(cols)}, {stack}) AS (feature, correlation)")).withColumn(
        "abs_correlation", F.abs("correlation"))


def correlation_pairs(F_: DataFrame, cols, threshold: float = 0.8) -> DataFrame:
    """AGG33: correlation of every column pair i < j in one aggregate; pairs with |r| above threshold."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = F_.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    longf = wide.select(F.expr(f"stack({len(pairs)}, {stack}) AS (feature_a, feature_b, correlation)"))
    return longf.where(F.abs("correlation") > threshold)


def binned_mutual_information(F_: DataFrame, target: str, cols, bins: int = 10) -> DataFrame:
    """AGG34: mutual information of each feature with the target on equal-width bins
    (sum p(x,y) ln(p(x,y) / (p(x) p(y)))). One scan: the table is stacked long."""
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    longf = F_.select(F.col(target).alias("_y"), F.expr(f"stack({len(cols)}, {stack}) AS (feature, x)")).where(
        F.col("x").isNotNull() & F.col("_y").isNotNull())
    rng = longf.groupBy("feature").agg(F.min("x").alias("_xl"), F.max("x").alias("_xh"),
                                      F.min("_y").alias("_yl"), F.max("_y").alias("_yh"))

    def binexpr(v, lo, hi):
        b = F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins)
        return F.when(F.col(hi) == F.col(lo), F.lit(0)).otherwise(F.least(b, F.lit(bins - 1)))

    j = longf.join(F.broadcast(rng), "feature").select("feature", binexpr("x", "_xl", "_xh").alias("bx"),
                                           binexpr("_y", "_yl", "_yh").alias("by"))
    joint = j.groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).alias("nxy"))
    wf = Window.partitionBy("feature")
    joint = joint.withColumns({
        "n": F.sum("nxy").over(wf),
        "nx": F.sum("nxy").over(Window.partitionBy("feature", "bx")),
        "ny": F.sum("nxy").over(Window.partitionBy("feature", "by")),
    })
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return joint.groupBy("feature").agg(F.sum(term).alias("mutual_information"))


def daily_report(F_: DataFrame, report_date: str) -> DataFrame:
    """AGG23: one day's jobs, mean efficiency (3 dp), total downtime, and the machines ranked."""
    d = F_.where(F.to_date("StartTime") == F.lit(report_date).cast("date"))
    return d.groupBy("machine").agg(
        F.count(F.lit(1)).alias("jobs"), rnd(F.avg("efficiency"), 3).alias("avg_efficiency"),
        F.sum("total_downtime").alias("total_downtime"),
    ).withColumn("rank", F.row_number().over(Window.orderBy(F.col("avg_efficiency").desc(), F.col("machine"))))


def daily_report_sections(F_: DataFrame, report_date: str | None = None, top_operators: int = 5) -> DataFrame:
    """AGG23: one day's report as rows of `section` total (one row), operator (the best `top_operators` by mean efficiency) and machine (all,
    best first): name, rank, jobs, avg_efficiency (3 dp), total_downtime (2 dp). Default: the log's last day; a day without jobs has
    no rows. Ranks go by the unrounded mean (missing last), ties by name. One grouping-sets pass over the day."""
    if report_date is None:
        last = F_.agg(F.to_date(F.max("StartTime")).cast("string").alias("d")).first()
        report_date = last["d"] if last else None
    day = F_.where(F.to_date("StartTime") == F.lit(report_date).cast("date")).select(F.col("OperatorName").alias("_o"), F.col("machine").alias("_m"), "efficiency", "total_downtime")
    sums = day.groupingSets([["_o"], ["_m"], []], "_o", "_m").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("jobs"), F.avg("efficiency").alias("_e"), F.sum("total_downtime").alias("_d")).where("jobs > 0")
    section = F.when(F.col("_g") == 1, "operator").when(F.col("_g") == 2, "machine").otherwise("total")
    named = sums.select(section.alias("section"), F.when(F.col("_g") == 1, F.col("_o")).when(F.col("_g") == 2, F.col("_m")).alias("name"), "jobs", "_e", "_d")
    best = Window.partitionBy("section").orderBy(F.col("_e").desc_nulls_last(), "name")  # the names of one day
    return named.withColumn("rank", F.row_number().over(best)).where((F.col("section") != "operator") | (F.col("rank") <= top_operators)).select(
        "section", "name", "rank", "jobs", rnd("_e", 3).alias("avg_efficiency"), rnd("_d", 2).alias("total_downtime"))
