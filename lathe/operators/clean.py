"""Cleaning operators (CLN1-CLN13): typed, lazy DataFrame -> DataFrame steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import seconds_between
from ..functions.quantiles import exact_quantiles, literal
from ..schema import DEFAULT, DOWNTIME, DURATIONS, UNKNOWN, Config


def _as_timestamp(df: DataFrame, c: str) -> Column:
    """Coerce a column to timestamp_ntz; unparsable text becomes NULL."""
    t = df.schema[c].dataType
    if isinstance(t, T.TimestampNTZType):
        return F.col(c)
    if isinstance(t, T.StringType):
        return F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")
    return F.col(c).cast("timestamp_ntz")


def clean_datetimes(df: DataFrame) -> DataFrame:
    """CLN1 + CLN2: coerce StartTime/EndTime, drop NULL or year-1969 stamps, add ActualDuration."""
    for c in ("StartTime", "EndTime"):
        if c in df.columns:
            df = df.withColumn(c, _as_timestamp(df, c))
            df = df.where(F.col(c).isNotNull() & (F.year(c) != 1969))
    if "StartTime" in df.columns and "EndTime" in df.columns:
        df = df.withColumn("ActualDuration", seconds_between("StartTime", "EndTime"))
    return df


def duration_mismatch_count(df: DataFrame, tolerance: float = 300.0) -> DataFrame:
    """CLN2 report: rows whose recorded JobDuration differs from End - Start by more than 5 min."""
    d = clean_datetimes(df)
    return d.agg(
        F.count(F.when(F.abs(F.col("ActualDuration") - F.col("JobDuration")) > tolerance, 1)).alias("mismatched_rows"),
        F.count(F.lit(1)).alias("checked_rows"),
    )


def clamp_durations(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """CLN3 + CLN4: negatives -> 0, > 24 h -> 24 h (JobDuration exempt); keep JobDuration in range."""
    cols = {}
    for c in DURATIONS:
        if c not in df.columns:
            continue
        x = F.col(c)
        e = F.when(x < 0, F.lit(0.0))
        if c != "JobDuration":
            e = e.when(x > cfg.max_category_seconds, F.lit(cfg.max_category_seconds))
        cols[c] = e.otherwise(x)
    df = df.withColumns(cols)
    if "JobDuration" in df.columns:
        df = df.where(F.col("JobDuration").between(cfg.min_job_duration, cfg.max_job_duration))
    return df


def handle_missing(df: DataFrame) -> DataFrame:
    """CLN5 + CLN6: drop rows missing a critical field, fill the rest."""
    critical = [c for c in ("machine", "StartTime", "JobDuration", "State") if c in df.columns]
    df = df.dropna(subset=critical)
    fills = {c: UNKNOWN for c in ("OperatorName", "PartNumber", "EmpID") if c in df.columns}
    fills.update({c: 0.0 for c in DOWNTIME + ["PartsProduced"] if c in df.columns})
    return df.fillna(fills)


def remove_extreme_outliers(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """CLN7: drop IdleTime > 7 days and PartsProduced > 10000 (NULL kept)."""
    if "IdleTime" in df.columns:
        df = df.where(~F.coalesce(F.col("IdleTime") > cfg.max_idle_seconds, F.lit(False)))
    if "PartsProduced" in df.columns:
        df = df.where(~F.coalesce(F.col("PartsProduced") > cfg.max_parts_per_job, F.lit(False)))
    return df


def validate_raw(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """CLN8: the whole cleaning chain in the reference order."""
    return (
        df.transform(clean_datetimes)
        .transform(clamp_durations, cfg)
        .transform(handle_missing)
        .transform(remove_extreme_outliers, cfg)
    )


def clean_strict(df: DataFrame) -> DataFrame:
    """SRC7: strict clean scan - drop (not clamp) negative or missing durations."""
    preds = [F.coalesce(F.year(_as_timestamp(df, "StartTime")) > 1970, F.lit(False))]
    preds += [F.coalesce(F.col(c) >= 0, F.lit(False)) for c in DURATIONS if c in df.columns]
    preds.append(F.coalesce(F.col("IdleTime") <= 86400, F.lit(False)))
    preds.append(F.coalesce(F.col("JobDuration") > 0, F.lit(False)))
    return df.where(reduce(lambda a, b: a & b, preds))


def valid_datetime(c) -> Column:
    """CLN9: parsable timestamp with year > 1970."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.year(F.try_to_timestamp(x.cast("string"))) > 1970, F.lit(False))


def _numeric_cols(df: DataFrame):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def quality_report(df: DataFrame, iqr_cols=("JobDuration", "RunningTime", "PartsProduced")) -> DataFrame:
    """CLN10: long (check, column, value) table computed in one aggregate pass
    (plus one pass for exact quartiles and one distinct count for duplicates)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("total_records")]
    aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"missing__{c}") for c in cols]
    aggs += [F.count(F.when(F.col(c) < 0, 1)).alias(f"negative__{c}") for c in DURATIONS if c in cols]
    if "StartTime" in cols:
        aggs.append(F.count(F.when(F.year(F.col("StartTime")) == 1969, 1)).alias("invalid_dates"))
    one = df.agg(*aggs)

    q = [c for c in iqr_cols if c in cols]
    fences = {c: [literal(v) for v in found] for c, found in exact_quantiles(df, {c: [0.25, 0.75] for c in q}).items()}
    outl = df.agg(*[F.count(F.when((F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1)), 1)).alias(f"outliers__{c}")
                    for c, (q1, q3) in fences.items()])
    dup = df.agg(F.count(F.lit(1)).alias("_n")).crossJoin(
        df.distinct().agg(F.count(F.lit(1)).alias("_d"))
    ).select((F.col("_n") - F.col("_d")).alias("duplicate_records"))

    wide = one.crossJoin(outl).crossJoin(dup)
    names = [c for c in wide.columns]
    stack = ", ".join(f"'{n.split('__')[0]}', '{n.split('__')[1] if '__' in n else ''}', CAST(`{n}` AS BIGINT)" for n in names)
    long = wide.selectExpr(f"stack({len(names)}, {stack}) AS (check, `column`, value)")
    return long.where(~((F.col("check") == "negative") & (F.col("value") == 0)))


def outlier_flag(df: DataFrame, c: str, method: str = "iqr", threshold: float = 1.5, out: str | None = None) -> DataFrame:
    """CLN11: flag outliers of one column by IQR fences or |z| > threshold (sample std)."""
    out = out or f"{c}_outlier"
    if method == "iqr":
        q1, q3 = (literal(v) for v in exact_quantiles(df, {c: [0.25, 0.75]})[c])
        flag = (F.col(c) < q1 - threshold * (q3 - q1)) | (F.col(c) > q3 + threshold * (q3 - q1))
        return df.withColumn(out, F.coalesce(flag, F.lit(False)))
    elif method == "zscore":
        s = df.agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"))
        flag = F.abs(F.try_divide(F.col(c) - F.col("_m"), F.col("_s"))) > threshold
        tmp = ["_m", "_s"]
    else:
        raise ValueError("method must be 'iqr' or 'zscore'")
    # the statistics side is one row: a broadcast of proven size
    return df.crossJoin(F.broadcast(s)).withColumn(out, F.coalesce(flag, F.lit(False))).drop(*tmp)


def missing_profile(df: DataFrame) -> DataFrame:
    """CLN12: columns with missing values, count and percent, most missing first (ties by name)."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_total"),
                  *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in cols)
    long = wide.selectExpr("_total", f"stack({len(cols)}, {stack}) AS (`column`, missing_count)")
    return (
        long.where(F.col("missing_count") > 0)
        .select("column", "missing_count",
                (F.col("missing_count") * 100.0 / F.col("_total")).alias("missing_percent"))
        .orderBy(F.desc("missing_count"), "column")
    )


REQUEST_TYPES = ("efficiency", "downtime", "both")


def validate_requests(req: DataFrame) -> DataFrame:
    """CLN13: normalise job requests and attach the list of violated rules.

    Returns every request with `machine`/`part` trimmed and upper-cased, an
    array `errors` and a boolean `is_valid`; split with `.where(is_valid)`.
    """
    m = F.upper(F.trim(F.col("machine")))
    p = F.upper(F.trim(F.col("part")))
    rules = [
        F.when(F.coalesce(F.length(m), F.lit(0)) == 0, F.lit("machine must not be empty")),
        F.when(F.coalesce(F.length(p), F.lit(0)) == 0, F.lit("part must not be empty")),
        F.when(~F.coalesce(F.col("planned_cycle_time") > 0, F.lit(False)), F.lit("planned_cycle_time must be > 0")),
        F.when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), F.lit("quantity must be > 0")),
    ]
    if "setup_time" in req.columns:
        rules.append(F.when(F.col("setup_time") < 0, F.lit("setup_time must be >= 0")))
    if "complexity_score" in req.columns:
        rules.append(F.when((F.col("complexity_score") < 1) | (F.col("complexity_score") > 10),
                            F.lit("complexity_score must be in 1..10")))
    if "prediction_type" in req.columns:
        rules.append(F.when(~F.col("prediction_type").isin(*REQUEST_TYPES), F.lit("unknown prediction_type")))
    errs = F.array_compact(F.array(*rules))
    return req.withColumns({"machine": m, "part": p}).withColumn("errors", errs).withColumn(
        "is_valid", F.size("errors") == 0
    )
