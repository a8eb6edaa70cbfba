"""Sequence windows over time-ordered jobs that never run a whole key in one task.

A job log has few machines and one 'Unknown' operator may hold a third of all
rows, so `Window.partitionBy(machine).orderBy(StartTime)` would put each such
key into a single task. Instead:

1. `with_position` numbers the rows of each key exactly: rows are counted per
   (key, hour bucket) with a partial aggregate, a running sum over the small
   counts table gives each bucket's offset, and `row_number` inside
   (key, bucket) adds the local index. The order (StartTime, JobNumber) is
   total, so the numbering is deterministic and survives task retries.
2. `over_sequence` splits each key's sequence into chunks of `chunk_rows`
   positions and copies the few rows a ROWS frame needs from the neighbouring
   chunk (a halo). Windows run per (key, chunk); halo rows are dropped after.

The result is exact for any ROWS frame, lag or lead no wider than the halo.

`over_sequences` does several key sets at once and shuffles the whole rows a single time, by segments of the time line that all key sets
share: see there.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hour_bucket, second_of_time
from ..schema import DEFAULT
from ..session import cut_lineage, stage

ORDER = ("StartTime", "JobNumber")


def with_position(df: DataFrame, keys, order=ORDER, ts: str = "StartTime", pos_col: str = "_pos",
                  base: DataFrame | None = None) -> DataFrame:
    """Add the 0-based position of each row within its key, ordered by `order`.

    `base`: a frame with the same rows, keys and times to count from (default `df`). Chained
    steps pass their common input, so each step adds one narrow scan of it instead of
    evaluating all earlier steps a second time."""
    keys = list(keys)
    # the bucket is one struct (equal with NULLs inside), so that window and join share one shuffle of the rows
    d = df.withColumn("_g", F.struct(*keys, hour_bucket(ts).alias("_b")))
    local = Window.partitionBy("_g").orderBy(*order)
    d = d.withColumn("_i", F.row_number().over(local))
    counts = (df if base is None else base).select(*keys, hour_bucket(ts).alias("_b")).groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.struct(*keys, "_b").alias("_og"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_off"))
    d = d.join(offsets, F.col("_g") == F.col("_og"))
    return d.withColumn(pos_col, F.col("_off") + F.col("_i") - 1).drop("_g", "_og", "_i", "_off")


WindowFactory = Callable[..., Window]


def over_sequence(df: DataFrame, keys, build: Callable[[WindowFactory], dict], before: int = 0,
                  after: int = 0, order=ORDER, chunk_rows: int = DEFAULT.chunk_rows,
                  pos_col: str | None = None, keep_pos: bool = False, base: DataFrame | None = None) -> DataFrame:
    """Evaluate window columns over each key's ordered sequence (`base`: see `with_position`).

    `build(w)` returns {name: Column}; `w()` is the ordered window and
    `w(lo, hi)` the same with `rowsBetween(lo, hi)`. `before`/`after` are the
    largest number of preceding/following rows any column looks at.
    """
    keys = list(keys)
    if max(before, after) > chunk_rows:
        raise ValueError("frame wider than a chunk")
    if pos_col is None:
        d = with_position(df, keys, order, base=base)
        pos_col = "_pos"
    else:
        d = df
    pos = F.col(pos_col)
    # each row is emitted once for its own chunk, and once more (as halo) for a neighbour
    # chunk when a frame there reaches it; one Generate, no union of the input lineage
    off = F.pmod(pos, F.lit(chunk_rows))
    copies = F.array(F.lit(0))
    if before:
        copies = F.when(off >= chunk_rows - before, F.array_append(copies, F.lit(1))).otherwise(copies)
    if after:
        copies = F.when(off < after, F.array_append(copies, F.lit(-1))).otherwise(copies)
    u = d.withColumn("_copy", F.explode(copies)).withColumns({
        "_chunk": F.floor(pos / chunk_rows) + F.col("_copy"), "_halo": F.col("_copy") != 0}).drop("_copy")
    ordered = Window.partitionBy(*keys, "_chunk").orderBy(pos_col)

    def w(lo=None, hi=None):
        return ordered if lo is None else ordered.rowsBetween(lo, hi)

    cols = build(w)
    out = u.select("*", *[c.alias(n) for n, c in cols.items()]).where(~F.col("_halo")).drop("_chunk", "_halo")
    return out if keep_pos else out.drop(pos_col)


@dataclass(frozen=True)
class Sequence:
    """Window columns over the ordered rows of each key: `builds` are called in turn with `w` as in `over_sequence`, and a later one may use
    the columns of the ones before. `values` are the columns that frames look at, `before` and `after` the rows that all
    `builds` together look back and ahead. `counter` names a column for the 1-based position within the key, and `since` ({out: condition},
    with a counter) columns for the rows since the condition last held (0 where it does, NULL if it has not yet)."""

    keys: list
    values: list = ()
    builds: tuple = ()
    before: int = 0
    after: int = 0
    counter: str | None = None
    since: dict | None = None


def merged(sequences: list[Sequence]) -> list[Sequence]:
    """The same columns with the windows of equal key sets in one, so that their rows are ordered once; counters stay as they are."""
    groups: dict = {}
    for s in sequences:
        groups.setdefault((frozenset(s.keys), s.counter), []).append(s)

    def together(builds):
        return lambda w: {name: c for build in builds for name, c in build(w).items()}
    out = []
    for same in groups.values():
        levels = [together([s.builds[i] for s in same if i < len(s.builds)]) for i in range(max(len(s.builds) for s in same))]
        out.append(same[0] if len(same) == 1 else Sequence(same[0].keys, list(dict.fromkeys(v for s in same for v in s.values)), tuple(levels),
                                                           max(s.before for s in same), max(s.after for s in same)))
    return out


def time_segments(df: DataFrame, ts: str, segment_rows: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds `_seg`, the number of a row's segment of the time line (equal times share one; rows without a time come first).

    Segments hold about `segment_rows` rows, by quantiles of the times: where they end changes no result."""
    at = F.coalesce(second_of_time(ts), F.lit(float("-inf")))
    n = min(-(-df.count() // segment_rows), MAX_SEGMENTS)
    marks = []
    if n > 1:
        grid = [i / n for i in range(1, n)]
        marks = df.agg(F.percentile_approx(second_of_time(ts), grid, 20 * n).alias("q")).first()["q"] or []
    splits = [float("-inf"), *sorted(set(marks)), float("inf")]
    if len(splits) < 3:
        return lambda d: d.withColumn("_seg", F.lit(0))
    buckets = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket")  # a binary search
    return lambda d: buckets.transform(d.withColumn("_at", at)).withColumn("_seg", F.col("_bucket").cast("int")).drop("_at", "_bucket")


MAX_SEGMENTS = 4096


def over_sequences(df: DataFrame, sequences: list[Sequence], order=ORDER, ts: str = "StartTime",
                   segment_rows: int = DEFAULT.segment_rows) -> DataFrame:
    """Evaluate the columns of several key sets with one shuffle of the whole rows.

    1. The time line is cut into segments. The narrow columns that frames look at are shuffled by segment once, and of every (key set, key,
       segment) the last `before` and first `after` rows are kept, or a count for a counter: the borders.
    2. Within a key the borders are in order, so those that a segment's frames reach are the next ones in a row: each border row learns
       the segments that it is copied to. Segments without a row of the key get none. The copies are stored; shuffle files of
       this step are then gone.
    3. The whole rows and the copies are shuffled by segment; every key set's windows run within (segment, key) beside its own copies only.
    """
    sequences = merged(sequences)
    locate = time_segments(df, ts, segment_rows)
    copies = _copies(locate(_narrow(df, sequences, order)), sequences, order)
    rows = locate(df).withColumns({"_for": F.lit(-1), "_n": F.lit(1).cast("long"), "_l": F.lit(None).cast("array<bigint>")})
    out = rows.unionByName(stage(copies), allowMissingColumns=True).repartition("_seg")
    for i, s in enumerate(sequences):
        part = ["_seg", *s.keys, ~F.col("_for").isin(-1, i)]
        ordered = Window.partitionBy(*part).orderBy(*order)

        def w(lo=None, hi=None, ordered=ordered):
            return ordered if lo is None else ordered.rowsBetween(lo, hi)

        for build in s.builds:
            out = out.select("*", *[c.alias(n) for n, c in build(w).items()])
        if s.counter:
            upto = Window.partitionBy(*part).orderBy(F.col("_for") == -1, *order).rowsBetween(Window.unboundedPreceding, 0)
            out = out.withColumn(s.counter, F.sum("_n").over(upto))
            at = [F.coalesce(F.get("_l", F.lit(j)), F.when((F.col("_for") == -1) & on, F.col(s.counter))) for j, on in enumerate((s.since or {}).values())]
            out = out.withColumns({name: F.col(s.counter) - F.max(x).over(upto) for name, x in zip(s.since or {}, at)})
    return out.where(F.col("_for") == -1).drop("_seg", "_for", "_n", "_l")


def _narrow(df: DataFrame, sequences: list[Sequence], order) -> DataFrame:
    return df.select(*dict.fromkeys([*order, *[c for s in sequences for c in [*s.keys, *s.values]]]))


def _copies(rows: DataFrame, sequences: list[Sequence], order) -> DataFrame:
    """Rows of `sequences` in other segments than their own: `_seg` (where to), `_for` (number of the sequence) and, for counters, `_n`,
    the number of rows of the key in all segments before, and `_l`, the positions where the conditions last held there."""
    d = rows.repartition("_seg")
    kept, none = [], F.lit(None).cast("array<bigint>")
    for i, s in enumerate(sequences):
        own = Window.partitionBy("_seg", *s.keys)
        if s.before:
            d = d.withColumn(f"_b{i}", F.row_number().over(own.orderBy(*[F.desc_nulls_last(c) for c in order])))
            kept.append((F.col(f"_b{i}") <= s.before, i, "before", F.lit(0), none))
        if s.after or s.counter:
            d = d.withColumn(f"_a{i}", F.row_number().over(own.orderBy(*order)))
        if s.after:
            kept.append((F.col(f"_a{i}") <= s.after, i, "after", F.lit(0), none))
        if s.counter:
            d = d.withColumn(f"_c{i}", F.count(F.lit(1)).over(own))
            held = [F.max(F.when(on, F.col(f"_a{i}").cast("long"))).over(own) for on in (s.since or {}).values()]
            kept.append((F.col(f"_a{i}") == 1, i, "count", F.col(f"_c{i}"), F.col(f"_l{i}") if held else none))
            d = d.withColumn(f"_l{i}", F.array(*held)) if held else d
    tags = F.array(*[F.when(at, F.struct(F.lit(i).alias("_for"), F.lit(side).alias("_side"), n.cast("long").alias("_n"), last.alias("_l"))) for at, i, side, n, last in kept])
    d = d.select(*rows.columns, F.explode(F.array_compact(tags)).alias("_t")).select(*rows.columns, "_t.*")
    keys = list(dict.fromkeys(k for s in sequences for k in s.keys))
    group = [F.when(F.col("_for").isin([i for i, s in enumerate(sequences) if k in s.keys]), F.col(k)) for k in keys]
    line = Window.partitionBy("_for", "_side", *group).orderBy("_seg", *order)
    d = d.withColumns({"_first": ~F.col("_seg").eqNullSafe(F.lag("_seg").over(line)), "_last": ~F.col("_seg").eqNullSafe(F.lead("_seg").over(line)),
                       "_sum": F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1))})
    to = F.when(F.col("_side") == "count", F.when(F.col("_sum") > 0, F.array("_seg")))
    for k in sorted({s.before for s in sequences} - {0}):
        reach = F.collect_list(F.when(F.col("_first"), F.col("_seg"))).over(line.rowsBetween(1, k))
        to = to.when((F.col("_side") == "before") & F.col("_for").isin([i for i, s in enumerate(sequences) if s.before == k]), reach)
    for k in sorted({s.after for s in sequences} - {0}):
        reach = F.collect_list(F.when(F.col("_last"), F.col("_seg"))).over(line.rowsBetween(-k, -1))
        to = to.when((F.col("_side") == "after") & F.col("_for").isin([i for i, s in enumerate(sequences) if s.after == k]), reach)
    d = d.withColumn("_to", to)
    conditions = max([len(s.since or {}) for s in sequences])
    at = [F.max(F.coalesce("_sum", F.lit(0)) + F.get("_l", F.lit(j))).over(line.rowsBetween(Window.unboundedPreceding, -1)) for j in range(conditions)]
    d = d.withColumn("_l", F.when(F.col("_side") == "count", F.array(*at)) if at else none)
    n = F.when(F.col("_side") == "count", F.col("_sum")).otherwise(F.lit(0)).cast("long")
    return d.select(*[c for c in rows.columns if c != "_seg"], F.explode("_to").alias("_seg"), "_for", n.alias("_n"), "_l")


def rolling_mean(x: str, k: int, w: WindowFactory, min_periods: int = 1) -> Column:
    """pandas rolling(k, min_periods).mean(): NULLs skipped, k counts rows."""
    frame = w(-(k - 1), 0)
    m = F.avg(x).over(frame)
    return m if min_periods <= 1 else F.when(F.count(x).over(frame) >= min_periods, m)


def rolling_std(x: str, k: int, w: WindowFactory, min_periods: int = 1) -> Column:
    frame = w(-(k - 1), 0)
    s = F.stddev_samp(x).over(frame)
    return s if min_periods <= 1 else F.when(F.count(x).over(frame) >= min_periods, s)


def cumulative_last(df: DataFrame, keys, flags: dict, pos_col: str = "_pos",
                    chunk_rows: int = DEFAULT.chunk_rows) -> DataFrame:
    """For each boolean column in `flags` ({out: flag}), the latest position at or
    before each row where the flag held (NULL if none), scanning chunk by chunk.

    Chunk maxima are carried forward over a small (key, chunk) table, so no key
    is scanned by a single task.
    """
    keys = list(keys)
    d = df.withColumn("_chunk", F.floor(F.col(pos_col) / chunk_rows))
    marks = {o: F.when(f, F.col(pos_col)) for o, f in flags.items()}
    d = d.withColumns({f"_m_{o}": m for o, m in marks.items()})
    per_chunk = d.groupBy(*keys, "_chunk").agg(*[F.max(f"_m_{o}").alias(f"_cm_{o}") for o in flags])
    prev = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(*keys, "_chunk", *[F.max(f"_cm_{o}").over(prev).alias(f"_carry_{o}") for o in flags])
    inside = Window.partitionBy("_g").orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_g", F.struct(*keys, "_chunk")).withColumns({f"_m_{o}": F.max(f"_m_{o}").over(inside) for o in flags})
    d = d.join(carry.select(F.struct(*keys, "_chunk").alias("_og"), *[f"_carry_{o}" for o in flags]), F.col("_g") == F.col("_og"))
    res = {o: F.coalesce(F.col(f"_m_{o}"), F.col(f"_carry_{o}")) for o in flags}
    return d.withColumns(res).drop("_chunk", "_g", "_og", *[f"_m_{o}" for o in flags], *[f"_carry_{o}" for o in flags])


def running_count(df: DataFrame, order, flag: str, name: str) -> tuple[DataFrame, int]:
    """(`df` with the number of rows with `flag` = 1 up to and with each row in the whole table's order, their total).

    Rows are sorted into ranges, stored with their range's number, and counted within; the driver sees one count a range
    (`spark.sql.shuffle.partitions` of them). `order` has to tell rows apart for the result to be defined; then ranges also
    split rows that share their first key."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = dict(ranged.groupBy("_range").agg(F.sum(flag)).collect())
    before, total = [], 0
    for i in range(n):
        before.append(total)
        total += counts.get(i) or 0
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_range") + 1)
    return ranged.withColumn(name, F.sum(flag).over(w) + ahead).drop("_range"), total
