"""Derived columns (DRV1-DRV25, FUN1) and the derived fact table F = derive(clean(J))."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles, literal
from ..functions.exprs import cap1, clip01, cut, cut_equal3, human_seconds, row_sum, sdiv, shift_of
from ..schema import DOWNTIME, JOBLOG_SCHEMA
from ..session import stage, stored_statistics
from .sequence import Sequence, over_sequence, over_sequences, rolling_mean


def core_metrics(df: DataFrame) -> DataFrame:
    """DRV1-DRV5: efficiency, parts_per_hour, total_downtime, <cat>_ratio, setup_efficiency."""
    cats = [c for c in DOWNTIME if c in df.columns]
    cols = {
        "efficiency": clip01(sdiv("RunningTime", "JobDuration")),
        "parts_per_hour": sdiv(F.col("PartsProduced") * 3600.0, F.col("RunningTime")),
        "total_downtime": row_sum(cats),
    }
    cols.update({f"{c}_ratio": sdiv(c, "JobDuration") for c in cats})
    cols["setup_efficiency"] = sdiv(F.col("RunningTime"), F.col("RunningTime") + F.col("SetupTime"))
    return df.withColumns(cols)


def time_features(df: DataFrame, ts: str = "StartTime") -> DataFrame:
    """DRV6-DRV8: calendar parts (Monday = 0), shift and cyclic encodings."""
    t = F.col(ts)
    df = df.withColumns({
        "hour": F.hour(t),
        "day_of_week": F.weekday(t),
        "day_of_month": F.dayofmonth(t),
        "month": F.month(t),
        "quarter": F.quarter(t),
    })
    two_pi = 2 * math.pi
    return df.withColumns({
        "is_weekend": (F.col("day_of_week") >= 5).cast("int"),
        "shift": shift_of("hour"),
        "hour_sin": F.sin(F.col("hour") * two_pi / 24),
        "hour_cos": F.cos(F.col("hour") * two_pi / 24),
        "day_sin": F.sin(F.col("day_of_week") * two_pi / 7),
        "day_cos": F.cos(F.col("day_of_week") * two_pi / 7),
    })


EXPERIENCE_EDGES = [0, 10, 50, 200, float("inf")]
EXPERIENCE_LABELS = ["Novice", "Intermediate", "Experienced", "Expert"]


def group_features(df: DataFrame) -> DataFrame:
    """DRV9-DRV11: per-machine mean duration (+ 3 equal-width bins), per-part mean
    setup, per-operator job count (+ bins), mapped back onto each job.

    The three per-key aggregates come from one grouping-sets aggregate (one
    scan, partial aggregation, one small shuffle) and are stored; the joins back
    to the jobs are left equi-joins that broadcast them if they are small.
    """
    g = (
        df.groupingSets([["machine"], ["PartNumber"], ["OperatorName"]], "machine", "PartNumber", "OperatorName")
        .agg(F.avg("JobDuration").alias("_mc"), F.avg("SetupTime").alias("_pc"),
             F.count(F.lit(1)).alias("_oe"), F.grouping_id().alias("_gid"))
    )
    g = stored_statistics(g)
    # grouping_id bits follow (machine, PartNumber, OperatorName): set = not grouped
    mach = g.where(F.col("_gid") == 3).select(F.col("machine").alias("_km"), F.col("_mc").alias("machine_complexity"))
    rng = mach.agg(F.min("machine_complexity").alias("_mn"), F.max("machine_complexity").alias("_mx"))
    mach = mach.crossJoin(F.broadcast(rng)).select(
        "_km", "machine_complexity",
        cut_equal3("machine_complexity", "_mn", "_mx").alias("machine_complexity_cat"))
    part = g.where(F.col("_gid") == 5).select(F.col("PartNumber").alias("_kp"), F.col("_pc").alias("part_complexity"))
    oper = g.where(F.col("_gid") == 6).select(F.col("OperatorName").alias("_ko"),
                                               F.col("_oe").alias("operator_experience"))
    out = df.join(mach, F.col("machine").eqNullSafe(F.col("_km")), "left")
    out = out.join(part, F.col("PartNumber").eqNullSafe(F.col("_kp")), "left")
    out = out.join(oper, F.col("OperatorName").eqNullSafe(F.col("_ko")), "left").drop("_km", "_kp", "_ko")
    return out.withColumn("operator_experience_cat",
                          cut("operator_experience", EXPERIENCE_EDGES, EXPERIENCE_LABELS))


def rolling_features(df: DataFrame, at_once: bool = False) -> DataFrame:
    """WIN1 + WIN2: 5/10-row rolling means by operator and by machine (StartTime order); `at_once`: with one shuffle of the whole rows
    instead of two for each key (`over_sequences`)."""
    op_metrics, machine_metrics = ["efficiency", "parts_per_hour", "total_downtime"], ["efficiency", "JobDuration"]

    def means(name, metrics):
        return lambda w: {f"{name}_{m}_rolling_{k}": rolling_mean(m, k, w) for k in (5, 10) for m in metrics}
    operator, machine = means("operator", op_metrics), means("machine", machine_metrics)
    if at_once:
        return over_sequences(df, [Sequence(["OperatorName"], op_metrics, (operator,), before=9),
                                   Sequence(["machine"], machine_metrics, (machine,), before=9)])
    return over_sequence(stage(over_sequence(df, ["OperatorName"], operator, before=9)), ["machine"], machine, before=9, base=df)


def rolling_on_derived(df: DataFrame) -> DataFrame:
    """`rolling_features` of a derived table: columns that follow from the row's own values (DRV1-DRV8) are not shuffled but made again."""
    raw = [c for c in JOBLOG_SCHEMA.names if c in df.columns]
    made = set(df.select(*raw).transform(core_metrics).transform(time_features).columns) - set(raw)
    kept = [c for c in df.columns if c not in made or c in ("efficiency", "parts_per_hour", "total_downtime")]
    out = rolling_features(df.select(*kept), at_once=True)
    rolled = [c for c in out.columns if c not in kept]
    return out.transform(core_metrics).transform(time_features).select(*df.columns, *rolled)


def derive(df: DataFrame, rolling: bool = True) -> DataFrame:
    """DRV12: the whole derivation (DRV1-DRV11, then WIN1/WIN2)."""
    out = df.transform(core_metrics).transform(time_features).transform(group_features)
    return out.transform(rolling_features) if rolling else out


def efficiency_scalar(running, duration) -> Column:
    """DRV13: 0 when duration <= 0, otherwise running / duration capped above at 1."""
    r, d = F.col(running), F.col(duration)
    return F.when(d <= 0, F.lit(0.0)).otherwise(cap1(F.try_divide(r, d)))


def notebook_ratios(df: DataFrame) -> DataFrame:
    """DRV15 (setup_efficiency overwritten as in the notebook)."""
    R, S, D, J, P = (F.col(c) for c in ("RunningTime", "SetupTime", "total_downtime", "JobDuration", "PartsProduced"))
    return df.withColumns({
        "productive_time_ratio": R / (R + S + 1),
        "downtime_intensity": D / (J + 1),
        "setup_efficiency": 1 / (S / 1000 + 1),
        "parts_per_minute": P * 60 / (R + 1),
    })


def notebook_time_flags(df: DataFrame) -> DataFrame:
    """DRV16."""
    h, dow = F.col("hour"), F.col("day_of_week")
    return df.withColumns({
        "is_rush_hour": h.isin(8, 9, 10, 14, 15, 16).cast("int"),
        "shift_start": h.isin(6, 14, 22).cast("int"),
        "shift_end": h.isin(13, 21, 5).cast("int"),
        "week_position": F.when(dow <= 1, "start").when(dow <= 3, "middle").otherwise("end"),
        "production_day": (dow < 5).cast("int"),
    })


def regression_time_features(df: DataFrame, ts: str = "StartTime") -> DataFrame:
    """DRV17."""
    t = F.col(ts)
    return df.withColumns({
        "hour_in_shift": F.pmod(F.hour(t) - 6, F.lit(24)),
        "minutes_in_hour": F.minute(t),
        "is_monday": (F.weekday(t) == 0).cast("int"),
        "is_friday": (F.weekday(t) == 4).cast("int"),
        "days_until_month_end": F.dayofmonth(F.last_day(t)) - F.dayofmonth(t),
    }).withColumn("is_month_end", (F.col("days_until_month_end") <= 3).cast("int"))


def anomaly_ratios(df: DataFrame) -> DataFrame:
    """DRV18: raw-division ratios; +/-inf parts_per_hour -> 0, 0/0 stays missing."""
    cols = {f"{c}_ratio": F.try_divide(F.col(c), F.col("JobDuration")) for c in DOWNTIME if c in df.columns}
    R, P = F.col("RunningTime"), F.col("PartsProduced")
    cols["parts_per_hour"] = F.when((R == 0) & (P != 0), F.lit(0.0)).otherwise(F.try_divide(P, R / 3600.0))
    return df.withColumns(cols)


def dominant_downtime(df: DataFrame, out: str = "dominant_downtime", no_downtime_label: bool = True) -> DataFrame:
    """DRV23: row arg-max over the 11 categories, first category on ties.

    With `no_downtime_label` an all-zero row is 'NoDowntime' (training variant);
    otherwise it is the first category (pattern-analysis variant)."""
    cats = [c for c in DOWNTIME if c in df.columns]
    mx = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in cats])
    e = None
    for c in cats:
        cond = F.coalesce(F.col(c), F.lit(0.0)) == mx
        e = F.when(cond, F.lit(c)) if e is None else e.when(cond, F.lit(c))
    if no_downtime_label:
        e = F.when(row_sum(cats) == 0, F.lit("NoDowntime")).otherwise(e)
    return df.withColumn(out, e)


def readable_seconds(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """DRV24."""
    return df.withColumn(out or f"{c}_readable", human_seconds(c))


def risk_bucket(p) -> Column:
    """DRV25: > 0.7 HIGH, > 0.3 MEDIUM, else LOW."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p > 0.7, "HIGH").when(p > 0.3, "MEDIUM").otherwise("LOW")


def performance_projection(df: DataFrame) -> DataFrame:
    """FUN1: the SQL performance projection (unclipped efficiency), newest first."""
    J, R, P = F.col("JobDuration"), F.col("RunningTime"), F.col("PartsProduced")
    keep = ["machine", "OperatorName", "PartNumber", "StartTime", "EndTime", "JobDuration", "RunningTime",
            "PartsProduced"] + DOWNTIME
    return (
        df.where((J > 0) & (F.year("StartTime") > 1970))
        .select(*keep,
                F.when(J > 0, R / J).otherwise(F.lit(0.0)).alias("efficiency"),
                F.when((R > 0) & (P > 0), P / (R / 3600.0)).otherwise(F.lit(0.0)).alias("parts_per_hour"))
        .orderBy(F.col("StartTime").desc())
    )


def extreme_flags(df: DataFrame) -> DataFrame:
    """DRV19: flags against global quantiles (exact, computed first): efficiency above
    q95 / below q05, duration above 2 x q95 / below q05 / 2, downtime above 2 x q95."""
    q = {c: [literal(v) for v in found] for c, found in exact_quantiles(
        df, {"efficiency": [0.95, 0.05], "JobDuration": [0.95, 0.05], "total_downtime": [0.95]}).items()}
    return df.withColumns({
        "efficiency_extreme_high": (F.col("efficiency") > q["efficiency"][0]).cast("int"),
        "efficiency_extreme_low": (F.col("efficiency") < q["efficiency"][1]).cast("int"),
        "duration_extreme_long": (F.col("JobDuration") > q["JobDuration"][0] * 2).cast("int"),
        "duration_extreme_short": (F.col("JobDuration") < q["JobDuration"][1] / 2).cast("int"),
        "downtime_extreme_high": (F.col("total_downtime") > q["total_downtime"][0] * 2).cast("int"),
    })


def quality_indicators(df: DataFrame) -> DataFrame:
    """DRV20: rolling-5 efficiency std by machine (>= 2, else 0) and its stability score,
    deviation from the machine's mean in machine std units, rush job (< 300 s after the
    previous job on the machine; the first job counts 0 s)."""
    from .sequence import rolling_std
    out = over_sequence(df, ["machine"], lambda w: {
        "efficiency_consistency": F.coalesce(rolling_std("efficiency", 5, w, min_periods=2), F.lit(0.0)),
        "_prev": F.lag("StartTime").over(w())}, before=4)
    m = stored_statistics(df.groupBy("machine").agg(F.avg("efficiency").alias("_mm"), F.stddev_samp("efficiency").alias("_ms")))
    from ..functions.exprs import seconds_between
    out = out.join(m, "machine", "left").withColumns({
        "stability_score": 1 / (1 + F.col("efficiency_consistency")),
        "performance_deviation": F.abs(F.col("efficiency") - F.col("_mm")) / (F.col("_ms") + 0.01),
        "rush_job": (F.coalesce(seconds_between("_prev", "StartTime"), F.lit(0.0)) < 300).cast("int"),
    })
    return out.drop("_prev", "_mm", "_ms")
