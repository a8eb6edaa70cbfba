"""Exact quantiles of whole columns, and of all groups of a table at once, without one big buffer.

`percentile` keeps every distinct value of a column in one task. Here approximate quantiles (bounded sketches) give a range
of values around each wanted rank, the rows below it are counted, and only the values in the ranges are counted one by
one (`groupBy(value).count()`), so few of them are shuffled. Results equal `percentile`: linear interpolation between neighbouring ranks, missing values skipped.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, small_methods

MARGIN = 0.005  # of all ranks, on each side of a wanted one
ACCURACY = 1000  # of sketches: off by a thousandth of all ranks at most


def exact_percentiles(df: DataFrame, columns: list[str], p: float) -> dict[str, float | None]:
    """The exact `p` percentile of each column (None for a column without values)."""
    return {c: found[0] for c, found in exact_quantiles(df, {c: [p] for c in columns}).items()}


def literal(value: float | None):
    return F.lit(value).cast("double")


def exact_quantiles(df: DataFrame, wanted_of: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """The exact percentiles asked for of each column, in order (None for a column without values).

    Sketches of all columns give a range of values around each wanted rank, a second pass counts the rows below and in it, and
    only the values in the ranges, about 2 * MARGIN of a column's, are counted one by one. A range that misses its rank after all
    grows to that end. The driver sees a few numbers a percentile."""
    with small_methods(df.sparkSession):  # a pass has an expression or more for each column
        return _exact_quantiles(df, wanted_of)


def _exact_quantiles(df: DataFrame, wanted_of: dict[str, list[float]]) -> dict[str, list[float | None]]:
    columns = [c for c, ps in wanted_of.items() if ps]
    if not columns:
        return {c: [] for c in wanted_of}
    value = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns}
    plain = df.select(*[value[c].alias(f"v{i}") for i, c in enumerate(columns)])
    asked = [(i, p) for i, c in enumerate(columns) for p in wanted_of[c]]
    grids = [[x for p in wanted_of[c] for x in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))] for c in columns]
    sketch = plain.agg(*[F.percentile_approx(f"v{i}", g, ACCURACY).alias(f"b{i}") for i, g in enumerate(grids)]).first()
    borders = [tuple(sketch[f"b{i}"][2 * j:2 * j + 2]) if sketch[f"b{i}"] else None for i, c in enumerate(columns) for j in range(len(wanted_of[c]))]
    sides = [(F.count(F.when(F.col(f"v{i}") < F.lit(b[0]), 1)), F.count(F.when(F.col(f"v{i}") <= F.lit(b[1]), 1))) if b else (F.lit(0), F.lit(0)) for (i, _), b in zip(asked, borders)]
    sums = plain.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))], *[x.alias(f"{side}{j}") for j, pair in enumerate(sides) for side, x in zip(("below", "upto"), pair)]).first()

    wanted, ranges, weights = [], [], {}  # (number of the percentile, rank within its range, which of its two neighbours)
    for j, ((i, p), border) in enumerate(zip(asked, borders)):
        if border is None:
            continue
        position = p * (sums[f"n{i}"] - 1)
        low, high = math.floor(position), math.ceil(position)
        weights[j] = position - low
        below, v = sums[f"below{j}"], F.col(f"v{i}")
        inside = v.isNotNull()
        if low < below:
            below = 0
        else:
            inside &= v >= F.lit(border[0])
        if high < sums[f"upto{j}"]:
            inside &= v <= F.lit(border[1])
        ranges.append(F.when(inside, F.struct(F.lit(j).alias("j"), v.alias("v"))))
        wanted += [(j, low - below, 0), (j, high - below, 1)]
    ends: dict[int, dict[int, float]] = {}
    if wanted:
        counted = plain.select(F.explode(F.array_compact(F.array(*ranges))).alias("x")).select("x.*").groupBy("j", "v").agg(F.count(F.lit(1)).alias("n"))
        ranks = F.broadcast(df.sparkSession.createDataFrame(wanted, "j int, rank long, side int"))  # two rows a percentile
        placed = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("j").orderBy("v")))
        found = placed.join(ranks, "j").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        for r in found.select("j", "side", "v").collect():
            ends.setdefault(r["j"], {})[r["side"]] = r["v"]
    out: dict[str, list[float | None]] = {c: [] for c in wanted_of}
    for j, (i, _) in enumerate(asked):
        out[columns[i]].append(ends[j][0] + (ends[j][1] - ends[j][0]) * weights[j] if j in ends else None)
    return out


BUCKETS = 1024  # value buckets of a group in a round of the selection
SMALL = 4096  # different values of a range that one window may order


def grouped_quantiles(df: DataFrame, keys: list[str], column: str, ps: list[float], names: list[str], small: int = SMALL, buckets: int = BUCKETS) -> DataFrame:
    """One row per group (`keys`, null a group too) with its exact percentiles as `names` (null for a group without values).

    Rank selection for all groups at once: values are counted by group, and each wanted rank keeps a range of values, at first from the
    group's least to its largest. A round cuts every range into equal value buckets, adds their counts up and keeps the bucket that
    holds the rank, narrowed to the values in it; ranges with at most `small` different values are done. Rounds are aggregates with
    partial sums, so a group may hold any part of all rows; the driver sees one number a round."""
    if not keys:
        raise ValueError("groups need keys; exact_quantiles serves whole columns")
    group = [F.col(f"`{k}`").alias(f"g{i}") for i, k in enumerate(keys)]
    on = [f"g{i}" for i in range(len(keys))]
    x = F.col(f"`{column}`").cast("double")
    counted = cut_lineage(df.select(*group, F.when(~F.isnan(x), x).alias("v")).groupBy(*on, "v").agg(F.count(F.lit(1)).alias("n")), _name("counted"))
    values = counted.where("v is not null").withColumn("k", F.xxhash64(*on))
    whole = values.groupBy("k", *on).agg(F.sum("n").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("different"))
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), f((F.col("rows") - 1) * F.lit(p)).cast("long").alias("rank"))
                      for i, p in enumerate(ps) for side, f in ((0, F.floor), (1, F.ceil))])
    state = cut_lineage(whole.select("k", *on, "lo", "hi", "different", F.explode(sides).alias("w")).select("k", *on, "w.*", "lo", "hi", "different"), _name("ranges"))
    of = ["k", *on, "i", "side"]

    def inside(ranges: DataFrame) -> DataFrame:
        held = [F.col("s.k") == F.col("x.k"), *[F.col(f"s.{c}").eqNullSafe(F.col(f"x.{c}")) for c in on], F.col("x.v").between(F.col("s.lo"), F.col("s.hi"))]
        return ranges.alias("s").join(values.alias("x"), reduce(and_, held)).select("s.*", F.col("x.v").alias("v"), F.col("x.n").alias("n"))

    while state.where(F.col("different") > small).limit(1).count():
        wide = inside(state.where(F.col("different") > small))
        # monotone in v, so buckets are ranges of values; the least and the largest value fall into different ones
        width = F.col("hi") / 2 - F.col("lo") / 2  # halves, as the difference may pass the largest double; 0 next to the smallest
        part = F.when(width > 0, F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * buckets), F.lit(buckets - 1))).otherwise((F.col("v") > F.col("lo")).cast("long"))
        sums = wide.groupBy(*of, "rank", part.alias("part")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("different"))
        upto = F.sum("n").over(Window.partitionBy(*of).orderBy("part"))
        kept = sums.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        narrowed = kept.select(*of, (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi", "different")
        state = cut_lineage(state.where(F.col("different") <= small).select(*of, "rank", "lo", "hi", "different").unionByName(narrowed), _name("ranges"))
    upto = F.sum("n").over(Window.partitionBy(*of).orderBy("v"))
    ends = inside(state).withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    found = ends.groupBy("k", *on).agg(*[F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("v"))).alias(f"e{i}_{side}") for i in range(len(ps)) for side in (0, 1)])
    found = found.join(whole.select(F.col("k").alias("wk"), *[F.col(c).alias(f"w{c}") for c in on], "rows"),
                       reduce(and_, [F.col("k") == F.col("wk"), *[F.col(c).eqNullSafe(F.col(f"w{c}")) for c in on]]))
    weight = [(F.col("rows") - 1) * F.lit(p) - F.floor((F.col("rows") - 1) * F.lit(p)) for p in ps]
    found = found.select(*on, *[(F.col(f"e{i}_0") + (F.col(f"e{i}_1") - F.col(f"e{i}_0")) * w).alias(f"q{i}") for i, w in enumerate(weight)])
    every = counted.select(*[F.col(c).alias(f"a{c}") for c in on]).distinct()
    out = every.join(found, reduce(and_, [F.col(f"a{c}").eqNullSafe(F.col(c)) for c in on]), "left")
    return out.select(*[F.col(f"ag{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"q{i}").alias(name) for i, name in enumerate(names)])


def _name(stage: str) -> str:
    return f"quantiles_{stage}_{uuid.uuid4().hex[:10]}"
