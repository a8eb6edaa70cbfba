"""Packing token pieces into sequences: bin completion over the histogram of lengths.

Only the number of pieces of each length (at most `capacity` of them, whatever the corpus) decides a
packing, so the histogram is counted in Spark, the search works on it, and its plan - which
lengths share a sequence, and how often - is turned back into places of pieces by ranks within a length.

Search: every sequence is a filling around the largest length left. Undominated fillings of the room
beside it (no smaller length could be swapped for a larger unused one that still fits) are enumerated, fullest first;
a branch is cut once the room lost so far exceeds what the best packing known allows. Best-fit packings
are the incumbents, at the start and from every node. A filling is applied as often as the counts
allow, so work depends on `capacity`, not on the number of pieces. The search ends when an incumbent meets the
lower bound or after `nodes` nodes (the best incumbent then stands).

Ranks: pieces are numbered within (length, hash bucket); bucket sizes are summed in Spark. No length, however
frequent, meets in one task. Result rows: one per piece; equal rows are interchangeable and each gets a place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import with_columns
from .store import written
from .tokens import encoder

CAPACITY = 1024
NODES = 100
BUCKET_ROWS = 50_000


def cut(docs: DataFrame, tokenizer: str, end: int | None, capacity: int = CAPACITY, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) x pieces: piece, start, length and ids_crc32 of each piece of a document.

    Documents of at most `capacity` ids are one piece; longer ones are cut into pieces of `capacity`, the first
    one shorter where needed. A null text is an empty one."""
    piece = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                          T.StructField("ids_crc32", T.LongType())])
    kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def compute(column: pa.Array) -> list[pa.Array]:
        ids, offsets = encoder(tokenizer, end).encode(column.to_pylist())
        raw = ids.astype("<u4")
        sizes = np.diff(offsets)
        number = np.maximum(1, -(-sizes // capacity))
        first = sizes - (number - 1) * capacity
        doc = np.repeat(np.arange(len(sizes)), number)
        bounds = np.concatenate([[0], np.cumsum(number)])
        at = np.arange(len(doc)) - bounds[doc]
        start = np.where(at == 0, 0, first[doc] + (at - 1) * capacity)
        length = np.where(at == 0, first[doc], capacity)
        begin = offsets[doc] + start
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
        rows = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], fields=list(kind))
        return [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows)]

    cutted = with_columns(docs, text, [T.StructField("pieces", T.ArrayType(piece))], compute, keep)
    own = [c for c in cutted.columns if c != "pieces" and c not in piece.names]
    return cutted.select(*own, F.explode("pieces").alias("p")).select(*own, "p.*")


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs: room taken, with large lengths apart (bound L2). counts[l]: pieces of length l."""
    capacity = len(counts) - 1
    size = np.arange(len(counts))
    number, room = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * size)
    best = -(-int(room[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        big = int(counts[capacity - k + 1:].sum())
        half = int(counts[capacity // 2 + 1:capacity - k + 1].sum())
        free = half * capacity - int((counts * size)[capacity // 2 + 1:capacity - k + 1].sum())
        small = int((counts * size)[max(k, 1):capacity // 2 + 1].sum())
        best = max(best, big + half + max(0, -(-(small - free) // capacity)))
    return max(best, int(number[-1] > 0))


Plan = list[tuple[tuple[int, ...], int]]  # (lengths of a sequence, how many such sequences)


def _largest(counts: np.ndarray, limit: int) -> int:
    """The largest length up to `limit` that is left, or 0."""
    left = np.flatnonzero(counts[1:limit + 1])
    return int(left[-1]) + 1 if len(left) else 0


def _times(counts: np.ndarray, filling: tuple[int, ...]) -> int:
    sizes, need = np.unique(filling, return_counts=True)
    return int((counts[sizes] // need).min())


def _apply(counts: np.ndarray, filling: tuple[int, ...], times: int) -> None:
    sizes, need = np.unique(filling, return_counts=True)
    counts[sizes] -= need * times


def best_fit(counts: np.ndarray) -> Plan:
    """Fill each sequence around the largest length with the largest that still fits, repeatedly."""
    counts, plan, capacity = counts.copy(), [], len(counts) - 1
    while top := _largest(counts, capacity):
        counts[top] -= 1
        filling, room = [top], capacity - top
        while size := _largest(counts, room):
            filling.append(size)
            counts[size] -= 1
            room -= size
        for size in filling:
            counts[size] += 1
        times = _times(counts, tuple(filling))
        _apply(counts, tuple(filling), times)
        plan.append((tuple(filling), times))
    return plan


def fillings(counts: np.ndarray, top: int, width: int = 4, tries: int = 64) -> list[tuple[int, ...]]:
    """Undominated fillings around `top`, fullest first, at most `width`."""
    capacity = len(counts) - 1
    left = counts.copy()
    left[top] -= 1
    found: dict[tuple[int, ...], int] = {}
    stack: list[tuple[tuple[int, ...], int]] = [((), capacity - top)]
    steps = 0
    while stack and steps < tries:
        steps += 1
        chosen, room = stack.pop()
        free = left.copy()
        for size in chosen:
            free[size] -= 1
        limit = min(room, chosen[-1] if chosen else room)
        sizes = np.flatnonzero(free[1:limit + 1])[::-1][:width] + 1
        if len(sizes) == 0:
            # dominated if an unused larger length could stand for a chosen one
            if not any(free[size + 1:size + room + 1].any() for size in chosen):
                found[(top, *chosen)] = room
                if room == 0 and len(found) >= width:
                    break
            continue
        for size in sizes[::-1].tolist():
            stack.append(((*chosen, size), room - size))
    return sorted(found, key=lambda f: (found[f], [-x for x in f]))[:width]


def plan_sequences(counts: np.ndarray, nodes: int = NODES) -> Plan:
    """A packing of the histogram (counts[l] pieces of length l) into few sequences of len(counts) - 1."""
    counts = counts.astype(np.int64)
    capacity, total = len(counts) - 1, int((counts * np.arange(len(counts))).sum())
    bound = lower_bound(counts)
    best = best_fit(counts)
    size = sum(n for _, n in best)
    stack: list[tuple[np.ndarray, Plan, int]] = [(counts, [], 0)]
    seen = 0
    while stack and size > bound and seen < nodes:
        left, plan, used = stack.pop()
        seen += 1
        top = _largest(left, capacity)
        placed = total - int((left * np.arange(len(left))).sum())
        waste = used * capacity - placed
        if not top or waste > (size - 1) * capacity - total:  # cannot beat the incumbent
            continue
        rest = best_fit(left)
        if used + sum(n for _, n in rest) < size:
            best, size = plan + rest, used + sum(n for _, n in rest)
        for filling in reversed(fillings(left, top)):
            times = _times(left, filling)
            after = left.copy()
            _apply(after, filling, times)
            stack.append((after, [*plan, (filling, times)], used + times))
    return best


def _segments(plan: Plan, capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence and offset of each run of places, in rank order."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks = [0] * (capacity + 1)
    sequence = 0
    for filling, times in plan:
        offset = 0
        for size in filling:
            runs.setdefault(size, []).append((ranks[size], sequence, offset))
            ranks[size] += times
            offset += size
        sequence += times
    return {size: tuple(np.array(x, dtype=np.int64) for x in zip(*found)) for size, found in runs.items()}


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, nodes: int = NODES, order: list[str] | None = None) -> DataFrame:
    """`pieces` with sequence_id and offset (gapless from 0 within a sequence).

    `length`: 1 to `capacity`, else an error. `order`: columns that name a piece (default: all), for ranks that do not
    depend on partitioning. `pieces` is read three times, so pass a stored table."""
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    named = pieces.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.col(f"`{length}`").cast("long").alias("size"),
                          F.xxhash64(*(order or own)).alias("key"))
    histogram = named.groupBy("size").agg(F.count("*").alias("n"))
    rows = histogram.orderBy(F.col("size").between(1, capacity), "size").limit(capacity + 1).collect()  # one row per length
    if any(r["size"] is None or not 1 <= r["size"] <= capacity for r in rows):
        raise ValueError(f"piece lengths have to be 1 to {capacity}")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows:
        counts[r["size"]] = r["n"]
    segments = _segments(plan_sequences(counts, nodes), capacity)

    buckets = max(1, int(counts.max()) // BUCKET_ROWS + 1)
    bucketed = named.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    sizes = bucketed.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    sizes = sizes.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("size", "bucket").orderBy("key", *[f"c{i}" for i in range(len(own))])  # about BUCKET_ROWS rows
    ranked = bucketed.withColumn("inner", F.row_number().over(inner)).join(sizes, ["size", "bucket"])
    ranked = ranked.select(*[f"c{i}" for i in range(len(own))], "size", (F.col("before") + F.col("inner") - 1).alias("rank"))
    names = [f"c{i}" for i in range(len(own))] + ["sequence_id", "offset"]
    schema = T.StructType([ranked.schema[n] for n in names[:-2]] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("size", "rank"))
            sequence, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                ranks, sequences, offsets = segments[s]
                run = np.searchsorted(ranks, rank[at], "right") - 1
                sequence[at] = sequences[run] + rank[at] - ranks[run]
                offset[at] = offsets[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(own)], pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(place, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end: int | None, capacity: int = CAPACITY, keep: list[str] | None = None) -> DataFrame:
    """Cut `docs` into pieces and pack them: columns `keep` (default: all but the text), piece, start, length, ids_crc32, sequence_id, offset."""
    kept = [c for c in docs.columns if c != "text"] if keep is None else keep
    pieces = written(cut(docs, tokenizer, end, capacity, keep=kept), "pieces")
    return pack(pieces, capacity=capacity)
