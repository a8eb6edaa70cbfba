"""Operator analysis: basic metrics, consistency, specialization, versatility, learning
curves, rankings and time patterns (AGG9-AGG11, AGG14, AGG15, AGG18, AGG19, TOP2, TOP4,
WIN19, MAT13).

Every per-operator result is a grouped aggregate or a `row_number` over a small
aggregated table; the only sequence window (learning curves) runs through the
chunked `over_sequence`, so a dominant operator never lands in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cap1, floor_days_between, perf_score, rnd, sdiv
from ..functions.quantiles import grouped_quantiles
from ..session import stored_statistics
from .sequence import over_sequence, rolling_mean


def basic_metrics(F_: DataFrame) -> DataFrame:
    """AGG9: per-operator aggregates rounded to 2 places and the metrics derived from them."""
    r2 = {
        "avg_efficiency": F.avg("efficiency"), "efficiency_std": F.stddev_samp("efficiency"),
        "min_efficiency": F.min("efficiency"), "max_efficiency": F.max("efficiency"),
        "avg_job_duration": F.avg("JobDuration"), "total_job_duration": F.sum("JobDuration"),
        "avg_running_time": F.avg("RunningTime"), "total_running_time": F.sum("RunningTime"),
        "total_parts": F.sum("PartsProduced"), "avg_parts": F.avg("PartsProduced"),
        "avg_setup_time": F.avg("SetupTime"), "total_setup_time": F.sum("SetupTime"),
        "avg_downtime": F.avg("total_downtime"), "total_downtime": F.sum("total_downtime"),
    }
    m = F_.groupBy("OperatorName").agg(
        F.count("efficiency").alias("total_jobs"),
        *[rnd(c, 2).alias(n) for n, c in r2.items()],
        F.countDistinct("machine").alias("machines_operated"),
        F.countDistinct("PartNumber").alias("unique_parts"),
        F.min("StartTime").alias("first_job"), F.max("StartTime").alias("last_job"),
    )
    m = m.withColumns({
        "efficiency_consistency": 1 / (1 + F.col("efficiency_std")),
        "parts_per_hour": sdiv(F.col("total_parts") * 3600, F.col("total_running_time")),
        "experience_days": floor_days_between("first_job", "last_job"),
    })
    return m.withColumn("jobs_per_day", sdiv(F.col("total_jobs"), F.col("experience_days") + 1))


def consistency(F_: DataFrame) -> DataFrame:
    """AGG10: efficiency std, mean, exact quartiles, 1/(1+std) and IQR per operator."""
    m = F_.groupBy("OperatorName").agg(
        F.stddev_samp("efficiency").alias("efficiency_std"), F.avg("efficiency").alias("efficiency_mean"))
    quartiles = grouped_quantiles(F_, ["OperatorName"], "efficiency", [0.25, 0.75], ["efficiency_q25", "efficiency_q75"])
    return m.join(quartiles, "OperatorName", "left").withColumns({
        "consistency_score": 1 / (1 + F.col("efficiency_std")),
        "interquartile_range": F.col("efficiency_q75") - F.col("efficiency_q25"),
    })


def machine_consistency(F_: DataFrame, min_jobs: int = 3) -> DataFrame:
    """AGG11: most and least consistent machine per operator (>= min_jobs jobs), by std."""
    g = (F_.groupBy("OperatorName", "machine")
         .agg(F.stddev_samp("efficiency").alias("std"), F.count("efficiency").alias("job_count"))
         .where(F.col("job_count") >= min_jobs))
    lo = F.row_number().over(Window.partitionBy("OperatorName").orderBy(F.col("std").asc(), "machine"))
    hi = F.row_number().over(Window.partitionBy("OperatorName").orderBy(F.col("std").desc(), "machine"))
    g = g.withColumns({"_lo": lo, "_hi": hi})
    most = g.where("_lo = 1").select("OperatorName", F.col("machine").alias("most_consistent_machine"),
                                     F.col("std").alias("most_consistent_std"),
                                     F.col("job_count").alias("most_consistent_jobs"))
    least = g.where("_hi = 1").select("OperatorName", F.col("machine").alias("least_consistent_machine"),
                                      F.col("std").alias("least_consistent_std"),
                                      F.col("job_count").alias("least_consistent_jobs"))
    return most.join(least, "OperatorName")


def versatility(F_: DataFrame) -> DataFrame:
    """AGG14: distinct machine/part counts relative to the most versatile operator."""
    v = F_.groupBy("OperatorName").agg(F.countDistinct("machine").alias("machines"),
                                       F.countDistinct("PartNumber").alias("parts"),
                                       F.avg("efficiency").alias("avg_efficiency"))
    whole = Window.partitionBy()  # a per-operator table: one row per operator
    v = v.withColumns({
        "machine_versatility_score": F.col("machines") / F.max("machines").over(whole),
        "part_versatility_score": F.col("parts") / F.max("parts").over(whole),
    })
    return v.withColumn("overall_versatility_score",
                        F.col("machine_versatility_score") * 0.6 + F.col("part_versatility_score") * 0.4)


def cross_training_potential(F_: DataFrame, top_n: int = 3) -> DataFrame:
    """MAT13: for each operator, the machines never run ranked by setup-time similarity
    1 / (1 + |operator setup level - machine mean setup| / 1000), top `top_n`.

    Candidates are the machines nearest in setup time only (`nearest_machines`).
    """
    from .matrices import nearest_machines

    om = F_.groupBy("OperatorName", "machine").agg(F.avg("SetupTime").alias("_s"))
    op = om.groupBy("OperatorName").agg(F.avg("_s").alias("current_avg_setup"),
                                        F.count(F.lit(1)).alias("_cur"))
    mach = F_.groupBy("machine").agg(F.avg("SetupTime").alias("machine_avg_setup"))
    n_all = mach.agg(F.count(F.lit(1)).alias("_all"))
    cand = nearest_machines(op, mach, om.select("OperatorName", "machine"), top_n)
    cand = cand.crossJoin(F.broadcast(n_all))
    cand = cand.withColumns({
        "similarity": 1 / (1 + F.abs(F.col("current_avg_setup") - F.col("machine_avg_setup")) / 1000),
        "versatility_potential": (F.col("_all") - F.col("_cur")) / F.col("_all"),
    })
    w = Window.partitionBy("OperatorName").orderBy(F.col("similarity").desc(), "machine")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
            .select("OperatorName", "machine", "similarity", "rank", "versatility_potential"))


def specialization_scores(F_: DataFrame) -> DataFrame:
    """AGG15: (max - mean) / std of the operator's per-machine mean efficiencies (0 with one machine)."""
    pm = F_.groupBy("OperatorName", "machine").agg(F.avg("efficiency").alias("_e"), F.count(F.lit(1)).alias("_n"))
    g = pm.groupBy("OperatorName").agg(
        F.max("_e").alias("_mx"), F.avg("_e").alias("_mean"), F.stddev_samp("_e").alias("_sd"),
        F.count(F.lit(1)).alias("versatility_score"), F.sum("_n").alias("total_experience"))
    score = F.when(F.col("versatility_score") > 1,
                   F.try_divide(F.col("_mx") - F.col("_mean"), F.col("_sd"))).otherwise(F.lit(0.0))
    return g.select("OperatorName", score.alias("machine_specialization_score"), "versatility_score",
                    "total_experience")


def best_machine(F_: DataFrame, min_jobs: int = 3) -> DataFrame:
    """TOP4: the operator's machine with the highest mean efficiency (>= min_jobs jobs)."""
    g = (F_.groupBy("OperatorName", "machine").agg(F.avg("efficiency").alias("best_efficiency"),
                                                   F.count(F.lit(1)).alias("job_count"))
         .where(F.col("job_count") >= min_jobs))
    w = Window.partitionBy("OperatorName").orderBy(F.col("best_efficiency").desc(), "machine")
    return g.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        "OperatorName", F.col("machine").alias("best_machine"), "best_efficiency", "job_count")


def top_parts(F_: DataFrame, min_jobs: int = 2, top_n: int = 3) -> DataFrame:
    """TOP4: the operator's top parts by mean efficiency (>= min_jobs jobs)."""
    g = (F_.groupBy("OperatorName", "PartNumber").agg(F.avg("efficiency").alias("mean"),
                                                      F.count(F.lit(1)).alias("count"))
         .where(F.col("count") >= min_jobs))
    w = Window.partitionBy("OperatorName").orderBy(F.col("mean").desc(), "PartNumber")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def learning_curves(F_: DataFrame, min_jobs: int = 10) -> DataFrame:
    """WIN19: per operator with >= min_jobs jobs, a moving average of efficiency over
    min(5, n // 3) jobs, its OLS slope x 100 against the job sequence, first/last five
    means, last - first moving average and the span in days."""
    n = F_.groupBy("OperatorName").agg(F.count(F.lit(1)).alias("_jobs"))
    d = F_.select("OperatorName", "StartTime", "JobNumber", "efficiency").join(stored_statistics(n), "OperatorName")
    d = d.where(F.col("_jobs") >= min_jobs)
    d = over_sequence(d, ["OperatorName"],
                      lambda w: {f"_ma{k}": rolling_mean("efficiency", k, w) for k in (3, 4, 5)},
                      before=4, keep_pos=True)
    win = F.least(F.lit(5), F.floor(F.col("_jobs") / 3))
    ma = F.when(win == 3, F.col("_ma3")).when(win == 4, F.col("_ma4")).otherwise(F.col("_ma5"))
    d = d.withColumns({"_ma": ma, "_seq": (F.col("_pos") + 1).cast("double")})
    g = d.groupBy("OperatorName").agg(
        F.first("_jobs").alias("job_count"),
        F.regr_slope("_ma", "_seq").alias("_slope"),
        F.avg(F.when(F.col("_pos") < 5, F.col("efficiency"))).alias("initial_efficiency"),
        F.avg(F.when(F.col("_pos") >= F.col("_jobs") - 5, F.col("efficiency"))).alias("recent_efficiency"),
        F.max(F.when(F.col("_pos") == 0, F.col("_ma"))).alias("_first"),
        F.max(F.when(F.col("_pos") == F.col("_jobs") - 1, F.col("_ma"))).alias("_last"),
        F.min("StartTime").alias("_t0"), F.max("StartTime").alias("_t1"))
    return g.select(
        "OperatorName", "initial_efficiency", "recent_efficiency",
        (F.col("_slope") * 100).alias("improvement_rate"),
        (F.col("_last") - F.col("_first")).alias("total_improvement"),
        "job_count", floor_days_between("_t0", "_t1").alias("experience_span_days"))


def fast_learners(curves: DataFrame, min_rate: float = 0.01, top_n: int = 5) -> DataFrame:
    """WIN19: operators improving more than `min_rate` % per job, best `top_n`."""
    return (curves.where((F.col("improvement_rate") > min_rate) & (F.col("job_count") >= 10))
            .orderBy(F.col("improvement_rate").desc(), "OperatorName").limit(top_n))


def rankings(F_: DataFrame, top_n: int = 10) -> DataFrame:
    """TOP2: six operator rankings as one long table (ranking, position, OperatorName, value)."""
    m = F_.groupBy("OperatorName").agg(
        rnd(F.avg("efficiency"), 3).alias("efficiency"), rnd(F.avg("SetupTime"), 3).alias("SetupTime"),
        rnd(F.avg("parts_per_hour"), 3).alias("parts_per_hour"), rnd(F.avg("total_downtime"), 3).alias("total_downtime"),
        F.countDistinct("machine").alias("machine"), F.count("JobDuration").alias("JobDuration"))
    m = m.withColumn("performance_score", perf_score(
        "efficiency", cap1(F.col("parts_per_hour") / 10), 1 / (1 + F.col("total_downtime") / 1000)))

    def ranked(name: str, metric: str, asc: bool, n: int, frame: DataFrame) -> DataFrame:
        order = F.col(metric).asc() if asc else F.col(metric).desc()
        w = Window.orderBy(order, "OperatorName")  # over the per-operator table only
        return (frame.where(F.col(metric).isNotNull())
                .withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
                .select(F.lit(name).alias("ranking"), "position", "OperatorName",
                        F.col(metric).cast("double").alias("value")))

    parts = [
        ranked("efficiency_ranking", "efficiency", False, top_n, m),
        ranked("setup_speed_ranking", "SetupTime", True, top_n, m),
        ranked("productivity_ranking", "parts_per_hour", False, top_n, m),
        ranked("versatility_ranking", "machine", False, top_n, m),
        ranked("overall_performance_ranking", "performance_score", False, top_n, m),
        ranked("experienced_top_performers", "performance_score", False, 5, m.where(F.col("JobDuration") >= 10)),
    ]
    return reduce(DataFrame.unionByName, parts)


def _best_worst(F_: DataFrame, key: str) -> DataFrame:
    g = F_.groupBy("OperatorName", key).agg(F.avg("efficiency").alias("_e"))
    return g


def hourly_patterns(F_: DataFrame) -> DataFrame:
    """AGG19: per operator with more than one hour seen: best/worst hour and spread over hours."""
    g = _best_worst(F_, "hour")
    wb = Window.partitionBy("OperatorName").orderBy(F.col("_e").desc(), "hour")
    ww = Window.partitionBy("OperatorName").orderBy(F.col("_e").asc(), "hour")
    g = g.withColumns({"_b": F.row_number().over(wb), "_w": F.row_number().over(ww)})
    return g.groupBy("OperatorName").agg(
        F.max(F.when(F.col("_b") == 1, F.col("hour"))).alias("best_hour"),
        F.max(F.when(F.col("_b") == 1, F.col("_e"))).alias("best_hour_efficiency"),
        F.max(F.when(F.col("_w") == 1, F.col("hour"))).alias("worst_hour"),
        F.max(F.when(F.col("_w") == 1, F.col("_e"))).alias("worst_hour_efficiency"),
        F.stddev_samp("_e").alias("hour_variation"),
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")


def daily_patterns(F_: DataFrame) -> DataFrame:
    """AGG19: per operator with more than one weekday seen: Monday, Friday and spread."""
    g = _best_worst(F_, "day_of_week")
    return g.groupBy("OperatorName").agg(
        F.max(F.when(F.col("day_of_week") == 0, F.col("_e"))).alias("monday_efficiency"),
        F.max(F.when(F.col("day_of_week") == 4, F.col("_e"))).alias("friday_efficiency"),
        F.stddev_samp("_e").alias("daily_variation"),
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")


def operator_profile(F_: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """AGG18: one profile row per operator: AGG9 metrics, machine and part lists,
    efficiency mean/median/std/min/max and (optionally) the cluster label."""
    base = basic_metrics(F_)
    extra = F_.groupBy("OperatorName").agg(
        F.array_join(F.array_sort(F.collect_set("machine")), ",").alias("machines"),
        F.array_join(F.array_sort(F.collect_set("PartNumber")), ",").alias("parts"))
    median = grouped_quantiles(F_, ["OperatorName"], "efficiency", [0.5], ["median_efficiency"])
    out = base.join(extra, "OperatorName").join(median, "OperatorName", "left")
    if clusters is not None:
        out = out.join(clusters.select("OperatorName", "cluster_label"), "OperatorName", "left")
    return out
