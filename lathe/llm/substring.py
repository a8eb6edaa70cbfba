"""Substring dedup by level-wise doubling: words covered by a window that an earlier document has too.

A window is `window` consecutive words. `levels` halves that length down to runs of 7 to 13 words, and the levels
go back up: runs that two different texts hold survive, and only these are extended to twice their length (less where
the halves were rounded up, so that the last level ends at the window), until none survive. A level looks at each next
level's run only at its minimum-hash run: equal runs have equal minima, so nothing is lost, and about a quarter
of the runs travel. At the window's length, windows around one surviving run form a segment; a segment that an earlier
document holds as a whole settles all its windows at once, and only the windows of first segments are compared one by
one. Longer repeats consist of repeated windows, so no further level changes which words are covered.

No segment or window meets in one task: least documents are partial aggregates, and very frequent keys, whose
number is bounded, get theirs by a broadcast instead of a shuffle.

Equal word sequences are one text class: all but the least doc_id of a class are covered entirely (from
`window` words on). Hashes have 64 bits for runs and classes and 96 for segments and windows.

Defined results: a null text has no words; a text of fewer than `window` words keeps them all; a null doc_id
neither removes nor loses words; rows that share a doc_id are documents of their own that remove nothing from
each other; extra columns are kept, and n_words, n_removed and kept replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import unused, with_columns
from .store import discard, release, written
from .text import Words, buffers, inside, pieces, spans, windows

WINDOW = 13
HOT, HOT_KEYS = 10_000, 1_000  # rows of a key that is met without a shuffle, and the bound on such keys
SHORTEST = 7  # words of the first level's runs, at least (windows up to 12 words begin at half their length)


def levels(window: int) -> list[int]:
    """Run lengths, ascending, each at most twice the one before; the last is the window."""
    lengths = [window, -(-window // 2)]
    while -(-lengths[-1] // 2) >= SHORTEST:
        lengths.append(-(-lengths[-1] // 2))
    return lengths[::-1]


def _class(words: Words) -> np.ndarray:
    """A hash of each document's whole word sequence."""
    return spans(words.hashes, words.offsets[:-1], words.counts())


def _minima(words: Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts inside one document, place of each one's minimum run, hashes of all runs)."""
    runs = windows(words.hashes, run)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), runs
    least, where = runs[:n].copy(), np.zeros(n, dtype=np.int64)
    for step in range(1, window - run + 1):
        other = runs[step:step + n]
        lower = other < least
        least[lower] = other[lower]
        where[lower] = step
    starts = np.flatnonzero(inside(words.offsets, len(words), window))
    return starts, starts + where[starts], runs


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(place: np.ndarray, words: Words, runs: np.ndarray) -> pa.Array:
    """The hashes of the runs at `place` (ascending, with repeats), a list for each document."""
    chosen = place[np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))] if len(place) else place
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(chosen, words.offsets).astype(np.int32)), _signed(runs[chosen]))


def _first_runs(run: int, longer: int):
    def compute(column: pa.Array) -> list[pa.Array]:
        words = Words(*buffers(column))
        _, place, runs = _minima(words, longer, run)
        return [_signed(_class(words)), pa.array(words.counts()), _lists(place, words, runs)]
    return compute


def _alive(batch: pa.RecordBatch, words: Words, starts: np.ndarray, place: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Of the runs at `starts`, those whose minimum run (at `place`) survived in their text. Batch: text, doc, fp, survivors."""
    doc_of = np.searchsorted(words.offsets, starts, "right") - 1
    fps, survivors = np.asarray(batch.column(2)), batch.column(3)
    same = _class(words).view(np.int64) == fps  # rows of that doc_id with another text are not meant
    alive = np.zeros(len(starts), dtype=bool)
    edges = np.searchsorted(doc_of, np.arange(len(fps) + 1))
    flat, offsets = np.asarray(survivors.flatten()), np.concatenate([[0], np.cumsum(np.asarray(survivors.value_lengths()))])
    signed = runs.view(np.int64)
    for i in np.flatnonzero(same).tolist():
        at = slice(edges[i], edges[i + 1])
        alive[at] = np.isin(signed[place[at]], flat[offsets[i]:offsets[i + 1]])
    return alive


def _extend(short: int, run: int, longer: int):
    """(text, doc, fp, surviving runs of length `short`) -> fp and its runs of length `run` around them."""
    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(*buffers(batch.column(0)))
            starts, place, runs = _minima(words, run, short)
            open_ = np.zeros(len(words) + 1, dtype=bool)
            open_[starts[_alive(batch, words, starts, place, runs)]] = True
            _, place, runs = _minima(words, longer, run)
            yield pa.RecordBatch.from_arrays([batch.column(2), _lists(place[open_[place]], words, runs)], names=["fp", "runs"])
    return process


SEGMENT = "s1 long, s2 int, fp long, doc long, at int, wins array<struct<w1:long,w2:int>>"
_WIN = pa.struct([("w1", pa.int64()), ("w2", pa.int32())])


def _segments(window: int, run: int):
    """(text, doc, fp, surviving runs) -> segments of windows around a surviving run."""
    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(*buffers(batch.column(0)), second=True)
            starts, place, runs = _minima(words, window, run)
            docs, fps = (np.asarray(batch.column(i)) for i in (1, 2))
            alive = _alive(batch, words, starts, place, runs)
            starts, place = starts[alive], place[alive]
            doc_of = np.searchsorted(words.offsets, starts, "right") - 1
            if not len(starts):
                continue
            # a segment: neighbouring windows of one minimum run
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
            size = np.diff(np.concatenate([first, [len(starts)]]))
            w1, w2 = windows(words.hashes, window)[starts], windows(words.second, window)[starts]
            s1, s2 = spans(words.hashes, starts[first], size + window - 1), spans(words.second, starts[first], size + window - 1)
            owner = doc_of[first]
            wins = pa.StructArray.from_arrays([_signed(w1), pa.array((w2 >> np.uint64(33)).astype(np.int32))], fields=list(_WIN))
            yield pa.RecordBatch.from_arrays([
                _signed(s1), pa.array((s2 >> np.uint64(33)).astype(np.int32)), pa.array(fps[owner]), pa.array(docs[owner]),
                pa.array((starts[first] - words.offsets[owner]).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(starts)]]).astype(np.int32)), wins),
            ], names=["s1", "s2", "fp", "doc", "at", "wins"])
    return process


def _removal(window: int):
    """(text, [(fp, copy, [(at, n)])]) -> words, removed words, kept text."""
    def compute(column: pa.Array, infos: pa.Array) -> list[pa.Array]:
        data, off = buffers(column)
        words = Words(data, off)
        fps = _class(words).view(np.int64)
        counts = words.counts()
        raw = data.tobytes()
        removed, kept = np.zeros(len(counts), dtype=np.int64), []
        texts = None
        for i, info in enumerate(infos.to_pylist()):
            mine = next((x for x in info or () if x["fp"] == fps[i]), None)
            n = int(counts[i])
            texts = raw[off[i]:off[i + 1]].split()
            if mine and mine["copy"] and n >= window:
                removed[i] = n
                texts = []
            elif mine and mine["spans"]:
                change = np.zeros(n + 1, dtype=np.int64)
                for span in mine["spans"]:
                    change[span["at"]] += 1
                    change[span["at"] + span["n"] + window - 1] -= 1
                cover = np.cumsum(change[:-1]) > 0
                removed[i] = int(cover.sum())
                texts = [t for t, c in zip(texts, cover.tolist()) if not c]
            kept.append(b" ".join(texts))
        return [pa.array(counts), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())]
    return compute


def _with_least(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(`rows` with the least doc of their keys, null where one doc alone holds a key; a stored table to discard after use).

    Keys of HOT rows or more, and of a thousandth of all shared rows (so at most HOT_KEYS of them, which are broadcast),
    are met where their rows are; the others in a shuffle. Either way a row meets at most one key."""
    found = rows.groupBy(*keys).agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n"))
    shared = written(found.where("least < most").select(*keys, "least", "n"), "shared")
    release(rows.sparkSession)
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.where(F.col("n") >= max(HOT, -(-total // HOT_KEYS))).select(*keys, F.col("least").alias("hot"))
    shared_keys = shared.select(*keys, "least")
    if not hot.take(1):
        return rows.join(shared_keys, keys, "left"), shared
    marked = rows.join(F.broadcast(hot), keys, "left")
    # rows of hot keys have their answer: they travel by their place and match nothing
    salt = F.when(F.col("hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("fp", "at"), F.lit(1 << 16)).cast("int"))
    met = marked.withColumn("salt", salt).join(shared_keys.withColumn("salt", F.lit(0)), [*keys, "salt"], "left").drop("salt")
    return met.withColumn("least", F.coalesce("hot", "least")).drop("hot"), shared


def _survivors(runs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """(doc, fp, runs): of the texts' runs (fp, runs), those that two different texts hold."""
    each = runs.where(F.size("runs") > 0).select("fp", F.explode("runs").alias("h"))
    repeated = written(each.groupBy("h").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("h"), "repeated")
    release(runs.sparkSession)
    left = each.join(repeated, "h", "left_semi").groupBy("fp").agg(F.collect_set("h").alias("runs"))  # at most a text's runs
    left = written(left.join(classes, "fp").select(F.col("first").alias("doc"), "fp", "runs"), name)
    discard(runs, repeated)
    release(runs.sparkSession)
    return left


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with n_words, n_removed and kept (the words left, joined by one blank)."""
    spark = docs.sparkSession
    lengths = levels(window)
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc is not null")

    # first level: minimum runs of each text
    base = written(with_columns(plain, "text", [T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("runs", T.ArrayType(T.LongType()))],
                                _first_runs(lengths[0], lengths[1]), keep=["doc"]), "runs")
    ids = written(base.select("doc", "fp").distinct(), "ids")
    classes = written(ids.groupBy("fp").agg(F.min("doc").alias("first")), "classes")
    survivors = _survivors(base, classes, "survivors")

    # middle levels: survivors doubled, until none are left or the next level is the window
    for short, run, longer in zip(lengths, lengths[1:], lengths[2:]):
        if not survivors.take(1):
            break
        around = plain.join(survivors, "doc").select("text", "doc", "fp", "runs").mapInArrow(_extend(short, run, longer), "fp long, runs array<long>")
        runs = written(around, "runs")
        discard(survivors)
        survivors = _survivors(runs, classes, "survivors")

    # last level: windows around surviving runs, by segments, then those of first segments one by one
    around = plain.join(survivors, "doc").select("text", "doc", "fp", "runs").mapInArrow(_segments(window, lengths[-2]), SEGMENT)
    segments = written(around, "segments")
    discard(survivors)
    release(spark)
    later = F.col("doc") > F.col("least")
    found, shared = _with_least(segments, ["s1", "s2"])
    placed = written(found.withColumn("settled", F.coalesce(later, F.lit(False))).select(
        "fp", "doc", "at", F.size("wins").alias("n"), "settled", F.when(~F.col("settled"), F.col("wins")).alias("wins")), "placed")
    discard(segments, shared)
    release(spark)
    single = placed.where(~F.col("settled")).select("fp", "doc", "at", F.posexplode("wins").alias("i", "w")).select("fp", "doc", (F.col("at") + F.col("i")).alias("at"), "w.*")
    found, shared = _with_least(single, ["w1", "w2"])
    hits = found.where(later).select("fp", "at", F.lit(1).alias("n"))
    marks = placed.where("settled").select("fp", "at", "n").unionByName(hits)
    marks = marks.groupBy("fp").agg(F.collect_list(F.struct("at", "n")).alias("spans"))  # at most a text's windows

    own, info = unused(docs, "own"), unused(docs, "info")
    copy = F.col("doc") > F.col("first")
    infos = ids.join(classes, "fp").join(marks, "fp", "left").groupBy(F.col("doc").alias(own)).agg(
        F.collect_list(F.struct("fp", copy.alias("copy"), F.when(~copy, F.col("spans")).alias("spans"))).alias(info))
    infos = written(infos, "marks")
    discard(placed, shared, classes, ids)
    release(spark)
    joined = docs.join(infos, F.col(f"`{doc_id}`").cast("long") == F.col(own), "left")
    kept = docs.columns if keep is None else keep
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return with_columns(joined, text, fields, _removal(window), kept, (info,))
