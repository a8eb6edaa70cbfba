"""Sequence and history windows over jobs (WIN5-WIN18, WIN20, WIN21).

Order within a key is always (StartTime, JobNumber). Per-key sequences go
through `over_sequence` (position + chunk + halo) or, for several key sets,
`over_sequences` (time segments), so a machine, operator or
pair that holds a third of the log is still split over many tasks. Whole-key
means are grouped aggregates joined back, never `avg().over(partitionBy(k))`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cut, hour_bucket, seconds_between
from ..schema import DOWNTIME
from ..session import stage, stored_statistics
from .derive import dominant_downtime
from .sequence import ORDER, Sequence, cumulative_last, over_sequence, over_sequences, rolling_mean, rolling_std, with_position

MO = ["machine", "OperatorName"]


def downtime_history_sequences(window: int = 5) -> list[Sequence]:
    def means(name):
        return lambda w: {f"{c}_{name}_avg": rolling_mean(c, window, w) for c in DOWNTIME}
    return [Sequence([key], DOWNTIME, (means(name),), before=window - 1) for key, name in (("machine", "machine"), ("OperatorName", "operator"))]


def downtime_history(df: DataFrame, window: int = 5) -> DataFrame:
    """WIN5: rolling mean of every downtime category by machine and by operator."""
    return over_sequences(df, downtime_history_sequences(window))


def jobs_since_downtime(df: DataFrame, never: int = 999) -> DataFrame:
    """WIN6: jobs since the last job with each category > 0 in the same (machine, operator);
    0 on a job where it occurs, `never` if it has not occurred yet."""
    d = with_position(df, MO)
    d = cumulative_last(d, MO, {f"_last_{c}": F.col(c) > 0 for c in DOWNTIME})
    cols = {f"time_since_{c}": F.coalesce(F.col("_pos") - F.col(f"_last_{c}"), F.lit(never)).cast("bigint")
            for c in DOWNTIME}
    return d.withColumns(cols).drop("_pos", *[f"_last_{c}" for c in DOWNTIME])


def since_downtime_sequence(counter: str) -> Sequence:
    """WIN6 beside a counter of the pair's jobs (`since_or_never` replaces the missing ones)."""
    return Sequence(MO, DOWNTIME, counter=counter, since={f"time_since_{c}": F.col(c) > 0 for c in DOWNTIME})


def since_or_never(df: DataFrame, never: int = 999) -> DataFrame:
    return df.withColumns({f"time_since_{c}": F.coalesce(F.col(f"time_since_{c}"), F.lit(never)).cast("bigint") for c in DOWNTIME})


def next_downtime(df: DataFrame) -> DataFrame:
    """WIN7: the next job's dominant downtime in (machine, operator); rows without one dropped."""
    d = dominant_downtime(df, "dominant_downtime", True)
    out = over_sequence(d, MO, lambda w: {"next_downtime": F.lead("dominant_downtime").over(w())}, after=1)
    return out.where(F.col("next_downtime").isNotNull())


def downtime_sequences(df: DataFrame, top_n: int = 10) -> DataFrame:
    """WIN8: the most common pairs (dominant downtime of a job, of the next job on its machine);
    ties by pair. An all-zero job counts as the first category here."""
    d = dominant_downtime(df, "current_downtime", False)
    out = over_sequence(d.select("machine", "StartTime", "JobNumber", "current_downtime"), ["machine"],
                        lambda w: {"next_downtime": F.lead("current_downtime").over(w())}, after=1)
    pairs = out.where(F.col("next_downtime").isNotNull()).groupBy("current_downtime", "next_downtime").agg(F.count(F.lit(1)).alias("count"))
    return pairs.orderBy(F.desc("count"), "current_downtime", "next_downtime").limit(top_n)


def sequence_counters(df: DataFrame, keysets: dict[str, list[str]], at_once: bool = False) -> DataFrame:
    """WIN9: 1-based job counters per key set ({out: keys}); `at_once`: with one shuffle of the whole rows for all key sets instead of one
    for each (`over_sequences`)."""
    if at_once:
        return over_sequences(df, [Sequence(keys, counter=out) for out, keys in keysets.items()])
    d, done = df, None
    for i, (out, keys) in enumerate(keysets.items()):
        if i:
            d = done = stage(d, done)
        d = with_position(d, keys, pos_col="_p", base=df).withColumn(out, F.col("_p") + 1).drop("_p")
    return d


EXPERIENCE_EDGES = [0, 1, 5, 15, float("inf")]
EXPERIENCE_LABELS = ["novice", "beginner", "experienced", "expert"]


def experience_label(c) -> object:
    """WIN10: counter bins (0,1], (1,5], (5,15], (15,inf)."""
    return cut(c, EXPERIENCE_EDGES, EXPERIENCE_LABELS)


def recent_windows(w) -> dict:
    return {
        "recent_efficiency": rolling_mean("efficiency", 3, w),
        "recent_downtime_trend": rolling_mean("total_downtime", 3, w),
        "efficiency_consistency": F.coalesce(rolling_std("efficiency", 5, w), F.lit(0.0)),
    }


def recent_performance(df: DataFrame) -> DataFrame:
    """WIN11: rolling-3 efficiency and downtime, rolling-5 efficiency std (missing -> 0) by (machine, operator)."""
    return over_sequence(df, MO, recent_windows, before=4)


def duration_sequences(target: str = "JobDuration", related=("RunningTime", "SetupTime", "total_downtime")) -> list[Sequence]:
    return [
        Sequence(["machine"], [target, *related], (lambda w: {
            **{f"machine_{target}_rolling_{k}": rolling_mean(target, k, w) for k in (3, 5, 10)},
            **{f"{v}_rolling_{k}": rolling_mean(v, k, w) for v in related for k in (3, 5)}},), before=9),
        Sequence(["OperatorName"], [target], (lambda w: {f"operator_{target}_rolling_{k}": rolling_mean(target, k, w) for k in (3, 5, 10)},), before=9)]


def duration_rolling(df: DataFrame, target: str = "JobDuration",
                     related=("RunningTime", "SetupTime", "total_downtime")) -> DataFrame:
    """WIN12: target rolling 3/5/10 by machine and by operator; related variables 3/5 by machine."""
    return over_sequences(df, duration_sequences(target, related))


def _efficiency_means(name: str):
    return lambda w: {f"{name}_efficiency_rolling_{k}": rolling_mean("efficiency", k, w) for k in (5, 10, 20)}


def _pair_efficiency(w) -> dict:
    f5 = w(-4, 0)
    return {
        **{f"machine_operator_efficiency_rolling_{k}": rolling_mean("efficiency", k, w) for k in (3, 5)},
        "efficiency_trend": F.when(F.count("efficiency").over(f5) >= 2,
                                   F.regr_slope(F.col("efficiency"), F.col("_pos").cast("double")).over(f5)),
        "efficiency_volatility": F.coalesce(rolling_std("efficiency", 10, w, min_periods=2), F.lit(0.0)),
    }


def efficiency_sequences() -> list[Sequence]:
    """WIN13 + WIN14; `_pos` counts from a segment's first row, as a slope is the same from any first position."""
    return [Sequence(["machine"], ["efficiency"], (_efficiency_means("machine"),), before=19),
            Sequence(["OperatorName"], ["efficiency"], (_efficiency_means("operator"),), before=19),
            Sequence(MO, ["efficiency"], (lambda w: {"_pos": F.row_number().over(w())}, _pair_efficiency), before=9)]


def efficiency_history(df: DataFrame, at_once: bool = False) -> DataFrame:
    """WIN13 + WIN14: efficiency rolling means (machine 5/10/20, operator 5/10/20,
    machine x operator 3/5), OLS slope of the last <= 5 values (>= 2) and the std of
    the last <= 10 values (>= 2, else 0) by machine x operator. `at_once`: see `sequence_counters`."""
    if at_once:
        return over_sequences(df, efficiency_sequences()).drop("_pos")
    first = out = stage(over_sequence(df, ["machine"], _efficiency_means("machine"), before=19))
    out = over_sequence(out, ["OperatorName"], _efficiency_means("operator"), before=19, base=df)
    d = with_position(stage(out, first), MO, base=df)
    return over_sequence(d, MO, _pair_efficiency, before=9, pos_col="_pos")


def gap_sequences() -> list[Sequence]:
    def previous(name):
        return lambda w: {name: F.lag("StartTime").over(w())}
    return [Sequence(keys, (), (previous(name),), before=1) for name, keys in (("_pm", ["machine"]), ("_pmo", MO), ("_pmp", ["machine", "PartNumber"]))]


def gaps(df: DataFrame) -> DataFrame:
    """WIN15: seconds since the previous job on the machine (first: 0), in the
    (machine, operator) pair (first: 0) and in the (machine, part) pair (first: 86400)."""
    return gap_seconds(over_sequences(df, gap_sequences()))


def gap_seconds(df: DataFrame) -> DataFrame:
    """The gaps from what `gap_sequences` found."""
    return df.withColumns({
        "time_since_last_machine_job": F.coalesce(seconds_between("_pm", "StartTime"), F.lit(0.0)),
        "time_since_last_job": F.coalesce(seconds_between("_pmo", "StartTime"), F.lit(0.0)),
        "time_since_last_part_job": F.coalesce(seconds_between("_pmp", "StartTime"), F.lit(86400.0)),
    }).drop("_pm", "_pmo", "_pmp")


def _difference(w) -> dict:
    return {"_diff": F.col("efficiency") - F.lag("efficiency").over(w())}


def _learning(w) -> dict:
    return {"operator_learning_rate": F.coalesce(rolling_mean("_diff", 5, w, min_periods=2), F.lit(0.0))}


def learning_sequences() -> list[Sequence]:
    return [Sequence(["OperatorName", "machine"], ["efficiency"], (_difference, _learning), before=5)]


def learning_rate(df: DataFrame) -> DataFrame:
    """WIN16: mean of the last <= 5 first differences of efficiency (>= 2 present) by (operator, machine), else 0."""
    keys = ["OperatorName", "machine"]
    d = over_sequence(df, keys, _difference, before=1, keep_pos=True)
    return over_sequence(d, keys, _learning, before=4, pos_col="_pos").drop("_diff")


def pair_means(df: DataFrame, target: str = "JobDuration", of: DataFrame | None = None) -> DataFrame:
    """WIN17: whole-group means of the target mapped to each job, and efficiency minus the machine mean. `of`: a frame with the same jobs to
    take the means from (default `df`)."""
    of = df if of is None else of
    specs = {
        "machine_part_avg_duration": ["machine", "PartNumber"],
        "operator_machine_avg_duration": ["OperatorName", "machine"],
        "operator_part_avg_duration": ["OperatorName", "PartNumber"],
        f"machine_avg_{target}": ["machine"],
        f"operator_avg_{target}": ["OperatorName"],
        f"part_avg_{target}": ["PartNumber"],
    }
    d = df
    for out, keys in specs.items():  # means of the input, not of the joins so far
        d = d.join(stored_statistics(of.groupBy(*keys).agg(F.avg(target).alias(out))), keys, "left")
    m = of.groupBy("machine").agg(F.avg("efficiency").alias("_me"))
    return d.join(stored_statistics(m), "machine", "left").withColumn(
        "efficiency_vs_machine_avg", F.col("efficiency") - F.col("_me")).drop("_me")


def notebook_rolling(df: DataFrame) -> DataFrame:
    """WIN18: machine efficiency/downtime 3/5/10, operator efficiency/setup 3/5, differences
    to the 5/3 means and the machine rolling-5 std (>= 2, else 0)."""
    out = over_sequences(df, [
        Sequence(["machine"], ["efficiency", "total_downtime"], (lambda w: {
            **{f"machine_{m}_roll_{k}": rolling_mean(m, k, w) for m in ("efficiency", "total_downtime") for k in (3, 5, 10)},
            "machine_efficiency_std_5": F.coalesce(rolling_std("efficiency", 5, w, min_periods=2), F.lit(0.0))},), before=9),
        Sequence(["OperatorName"], ["efficiency", "SetupTime"], (lambda w: {
            f"operator_{m}_roll_{k}": rolling_mean(m, k, w) for m in ("efficiency", "SetupTime") for k in (3, 5)},), before=4)])
    return out.withColumns({
        "efficiency_vs_machine_roll": F.col("efficiency") - F.col("machine_efficiency_roll_5"),
        "efficiency_vs_operator_roll": F.col("efficiency") - F.col("operator_efficiency_roll_3"),
        "stability_score": 1 / (1 + F.col("machine_efficiency_std_5")),
    })


def trend_label(df: DataFrame, column: str = "efficiency", keys=()) -> DataFrame:
    """WIN20: mean of the last n // 3 rows vs the first n // 3 rows (StartTime order):
    > 1.05x improving, < 0.95x declining, else stable (fewer than 2 rows: stable).

    Counts and sums by hour tell which hours lie wholly in a third; only the rows of the (at most two) hours that a border
    cuts are ordered."""
    keys = list(keys)
    x = F.col(column).cast("double")
    d = df.select(*keys, *[c for c in ORDER if c not in keys], x.alias("_x"), hour_bucket("StartTime").alias("_b"))
    hours = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_x").alias("_s"), F.count("_x").alias("_c"))
    whole = Window.partitionBy(*keys)  # over a row for each hour
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.withColumns({"_off": before, "_all": F.sum("_n").over(whole)})
    third = F.floor(F.col("_all") / 3)
    hours = hours.withColumns({  # rows of the hour in the first and in the last third
        "_old": F.greatest(F.least(third - F.col("_off"), F.col("_n")), F.lit(0)),
        "_new": F.greatest(F.least(F.col("_off") + F.col("_n") - (F.col("_all") - third), F.col("_n")), F.lit(0))})
    cut_by = ((F.col("_old") > 0) & (F.col("_old") < F.col("_n"))) | ((F.col("_new") > 0) & (F.col("_new") < F.col("_n")))
    border = hours.where(cut_by).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), F.col("_n").alias("_kn"), F.col("_old").alias("_ko"), F.col("_new").alias("_kw"))
    same = F.col("_b").eqNullSafe(F.col("_kb"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*ORDER))
    ranked = d.join(border, same).withColumn("_p", place)
    sides = {"_old": F.col("_p") <= F.col("_ko"), "_new": F.col("_p") > F.col("_kn") - F.col("_kw")}
    rows = ranked.select(*keys, F.lit(0).alias("rows"), *[F.when(at, F.col("_x")).alias(f"_s{s}") for s, at in sides.items()],
                         *[F.when(at & F.col("_x").isNotNull(), 1).otherwise(0).alias(f"_c{s}") for s, at in sides.items()])
    full = {s: (F.col(s) == F.col("_n")) & ~cut_by for s in sides}
    parts = hours.select(*keys, F.col("_n").alias("rows"), *[F.when(at, F.col("_s")).alias(f"_s{s}") for s, at in full.items()],
                         *[F.when(at, F.col("_c")).otherwise(0).alias(f"_c{s}") for s, at in full.items()])
    parts = parts.unionByName(rows)
    agg = (parts.groupBy(*keys) if keys else parts.groupBy()).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), (F.sum("_s_new") / F.nullif(F.sum("_c_new"), F.lit(0))).alias("recent_avg"), (F.sum("_s_old") / F.nullif(F.sum("_c_old"), F.lit(0))).alias("older_avg"))
    label = (F.when(F.col("rows") < 2, "stable")
             .when(F.col("recent_avg") > F.col("older_avg") * 1.05, "improving")
             .when(F.col("recent_avg") < F.col("older_avg") * 0.95, "declining").otherwise("stable"))
    return agg.withColumn("trend", label)


def daily_efficiency(df: DataFrame, min_days: int = 30) -> DataFrame:
    """WIN21: mean efficiency per day and its 7-day (7-row) moving average when more than `min_days` days."""
    d = df.groupBy(F.to_date("StartTime").alias("date")).agg(F.avg("efficiency").alias("efficiency"))
    days = Window.partitionBy()  # the per-day table: one row per calendar day
    w = Window.orderBy("date").rowsBetween(-6, 0)
    return d.withColumn("efficiency_ma7", F.when(F.count(F.lit(1)).over(days) > min_days, F.avg("efficiency").over(w)))
