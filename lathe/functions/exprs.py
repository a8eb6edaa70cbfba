"""Column expressions that reproduce the analysed application's numeric rules.

Every helper returns a Column and stays inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sdiv(n, d, default: float = 0.0) -> Column:
    """n / d, `default` when d == 0, NULL when n or d is NULL."""
    n, d = col(n), col(d)
    return F.when(d == 0, F.lit(default)).otherwise(F.try_divide(n, d))


def cap1(x) -> Column:
    """min(x, 1.0) with NULL kept NULL (Spark's `least` would return 1.0)."""
    x = col(x)
    return F.when(x > 1, F.lit(1.0)).otherwise(x)


def clip01(x) -> Column:
    x = col(x)
    return F.when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(x)


def rnd(x, digits: int) -> Column:
    """Half-to-even decimal rounding as NumPy does it: rint(x * 10^d) / 10^d."""
    scale = float(10**digits)
    return F.rint(col(x) * scale) / scale


def perf_score(eff, quality, consistency, weights=(0.5, 0.3, 0.2)) -> Column:
    """Composite score w_e*eff + w_q*quality + w_c*consistency, capped at 1."""
    we, wq, wc = weights
    return cap1(col(eff) * we + col(quality) * wq + col(consistency) * wc)


def rel_consistency(std, mean) -> Column:
    """1 - std/mean, with nothing subtracted when the mean is not positive."""
    std, mean = col(std), col(mean)
    return F.lit(1.0) - F.when(mean > 0, std / mean).otherwise(F.lit(0.0))


def row_sum(cols) -> Column:
    """Row sum with missing values counted as 0."""
    return reduce(add, [F.coalesce(col(c), F.lit(0.0)) for c in cols])


def avg_rank_desc(c, partition=()) -> Column:
    """Average rank of a descending order (ties share the mean of their ranks).

    NULL values get a NULL rank. Meant for small aggregated tables.
    """
    c = col(c)
    part = list(partition)
    w = Window.partitionBy(*part).orderBy(c.desc_nulls_last())
    peers = Window.partitionBy(*(part + [c]))
    r = F.rank().over(w) + (F.count(F.lit(1)).over(peers) - 1) / 2.0
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(r.cast("double"))


def cut(x, edges, labels) -> Column:
    """Right-closed binning (a, b]; values at or below the first edge, or NULL, give NULL."""
    x = col(x)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > lo) & (x <= hi) if hi != float("inf") else (x > lo)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def cut_equal3(x, mn, mx, labels=("Simple", "Medium", "Complex")) -> Column:
    """Three equal-width right-closed bins over [mn, mx] (lowest edge lowered by 0.1 %
    of the range); a constant column falls in the middle bin."""
    x, mn, mx = col(x), col(mn), col(mx)
    same = mn == mx
    lo_c = mn - F.when(mn != 0, F.abs(mn) * 0.001).otherwise(F.lit(0.001))
    hi_c = mx + F.when(mx != 0, F.abs(mx) * 0.001).otherwise(F.lit(0.001))
    lo = F.when(same, lo_c).otherwise(mn)
    hi = F.when(same, hi_c).otherwise(mx)
    step = (hi - lo) / 3.0
    e1 = step * 1.0 + lo
    e2 = step * 2.0 + lo
    first = F.when(same, lo).otherwise(mn - (mx - mn) * 0.001)
    return (
        F.when(x.isNull() | (x <= first), F.lit(None).cast("string"))
        .when(x <= e1, F.lit(labels[0]))
        .when(x <= e2, F.lit(labels[1]))
        .when(x <= hi, F.lit(labels[2]))
    )


def shift_of(hour) -> Column:
    h = col(hour)
    return (
        F.when((h >= 6) & (h < 14), F.lit("Day"))
        .when((h >= 14) & (h < 22), F.lit("Evening"))
        .otherwise(F.lit("Night"))
    )


_EPOCH_DATE = "1970-01-01"


def _second_of_day(t: Column) -> Column:
    return (F.hour(t) * 3600 + F.minute(t) * 60).cast("double") + F.extract(F.lit("SECOND"), t).cast("double")


def seconds_between(a, b) -> Column:
    """Elapsed seconds from a to b as a double, computed on the wall-clock calendar
    (timestamp_ntz has no zone; `timestamp_diff` would apply the session zone's DST)."""
    a, b = col(a), col(b)
    days = F.datediff(F.to_date(b), F.to_date(a)).cast("double")
    return days * 86400.0 + _second_of_day(b) - _second_of_day(a)


def second_of_time(t) -> Column:
    """Seconds since 1970-01-01 of a timestamp_ntz as a double (monotone, zone free)."""
    t = col(t)
    return F.datediff(F.to_date(t), F.lit(_EPOCH_DATE).cast("date")).cast("double") * 86400.0 + _second_of_day(t)


def floor_days_between(a, b) -> Column:
    """Whole elapsed days from a to b (floor of the elapsed time)."""
    return F.floor(seconds_between(a, b) / 86400.0)


def bias_corrected_skew(g1, n) -> Column:
    """Sample skewness G1 = g1 * sqrt(n (n-1)) / (n - 2) from population skewness g1."""
    g1, n = col(g1), col(n).cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def not_unknown(c) -> Column:
    """True for known keys: not NULL and not the 'Unknown' marker."""
    return F.coalesce(col(c) != F.lit("Unknown"), F.lit(False))


def human_seconds(s) -> Column:
    s = col(s).cast("bigint")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), F.pmod(s, F.lit(60))))
        .otherwise(
            F.format_string("%dh %dm", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60))
        )
    )


def trunc_ntz(unit: str, ts) -> Column:
    """Truncate a timestamp_ntz to hour/day/week (Monday)/month without any time zone."""
    t = col(ts)
    d = F.to_date(t)
    if unit == "hour":
        return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0))
    if unit == "day":
        return d.cast("timestamp_ntz")
    if unit == "week":
        return F.date_sub(d, F.weekday(t)).cast("timestamp_ntz")
    if unit == "month":
        return F.trunc(d, "month").cast("timestamp_ntz")
    raise ValueError(f"unsupported unit {unit}")


def hour_bucket(ts) -> Column:
    """Whole hours since 1970-01-01 of a timestamp_ntz (monotone, zone free)."""
    t = col(ts)
    return F.datediff(F.to_date(t), F.lit(_EPOCH_DATE).cast("date")).cast("bigint") * 24 + F.hour(t)
