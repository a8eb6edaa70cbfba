"""Near-duplicate components: circulant MinHash banding, exact Jaccard verification, connected components.

A document's set holds its distinct shingles (`shingle` consecutive words, A-Z folded; the whole
sequence when it has fewer). Circulant MinHash uses two permutations of the 64-bit numbers: the first
scatters the shingles, the second, shifted circularly by k, gives coordinate k as its minimum. `BANDS` bands of
`ROWS` coordinates miss a pair at similarity 0.8 with probability 3e-8.

Documents with equal sets are one class, so groups of copies meet in one aggregate. The other links
are found so that no bucket is expanded into its pairs:

1. Shingles that one candidate alone holds can match nothing. They bound each similarity: with m of n shingles
   shared, a pair reaches at most o / (n1 + n2 - o), o = min(m1, m2). Documents with m / n below the threshold leave.
2. In each bucket every member is compared with one hub, the member with the largest m / n.
3. In buckets whose members are not yet in one component, the others are compared with a member of the largest one.
4. Members of buckets that still hold several components are joined on rare shingles: sorted by frequency, two sets
   with the overlap needed share a shingle among the first ones of both (prefix and position filtering, exact). Of
   the pairs that share one, those across components are compared.

Only pairs inside one component, whose answer cannot change the result, and pairs that cannot reach the threshold
are left out, so nothing is lost or capped.

Every link is confirmed on the full sets. Components come from alternating large-star and small-star steps.

Defined results: no words or null text: n_shingles 0, a component of its own; a null doc_id: likewise, with a null
component; rows that share a doc_id are one node (linked if any of their texts is); extra columns are
kept, and n_shingles, component_id and kept replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import unused, with_columns
from .store import discard, release, written
from .text import Words, buffers, inside, mix, pieces, spans, windows

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 24, 3
_CHUNK = 1 << 15  # shingles whose coordinates are made at once


def shingles(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): every document's shingles in text order, repeats included."""
    words = Words(*buffers(column), lower=True)
    counts = words.counts()
    own = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(own)])
    out = np.zeros(int(offsets[-1]), dtype=np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    full = np.ones(len(out), dtype=bool)
    full[offsets[short]] = False
    out[full] = windows(words.hashes, shingle)[inside(words.offsets, len(words), shingle)]
    out[offsets[short]] = spans(words.hashes, words.offsets[short], counts[short])
    return out, offsets


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with each document's hashes sorted and distinct."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return (np.concatenate(sets) if sets else hashes), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _scatter(x: np.ndarray) -> np.ndarray:
    return mix(x ^ np.uint64(0x5851F42D4C957F2D))


def signature(hashes: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash coordinates, documents x size; documents without shingles get the largest number."""
    docs = len(offsets) - 1
    out = np.full((docs, size), np.iinfo(np.uint64).max, dtype=np.uint64)
    scattered = _scatter(hashes)
    at = 0
    while at < docs:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
        some = np.arange(at, end)[np.diff(offsets[at:end + 1]) > 0]
        for low in range(int(offsets[at]), int(offsets[end]), 4 * _CHUNK):  # a long document in parts
            high = min(low + 4 * _CHUNK, int(offsets[end]))
            part = scattered[low:high]
            here = some[(offsets[some] < high) & (offsets[some + 1] > low)]
            starts = np.maximum(offsets[here] - low, 0)
            for k in range(size):
                out[here, k] = np.minimum(out[here, k], np.minimum.reduceat(mix(part + np.uint64(k)), starts))
        at = end
    return out


_FIELDS = [T.StructField("n", T.LongType()), T.StructField("fp1", T.LongType()), T.StructField("fp2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _summary(shingle: int):
    def compute(column: pa.Array) -> list[pa.Array]:
        hashes, offsets = distinct_sets(*shingles(column, shingle))
        sizes = np.diff(offsets)
        coordinates = signature(hashes, offsets, BANDS * ROWS).reshape(len(sizes), BANDS, ROWS)
        keys = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for r in range(ROWS):
            keys = mix(keys ^ coordinates[:, :, r])
        total = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(np.stack([mix(hashes), mix(~hashes)], axis=1), axis=0, dtype=np.uint64)])
        prints = total[offsets[1:]] - total[offsets[:-1]]  # sums do not depend on order
        filled = sizes > 0
        bounds = np.concatenate([[0], np.cumsum(np.where(filled, BANDS, 0))]).astype(np.int32)
        return [pa.array(sizes), _signed(prints[:, 0]), _signed(prints[:, 1]), pa.ListArray.from_arrays(pa.array(bounds), _signed(keys[filled].reshape(-1)))]
    return compute


def _set_rows(shingle: int):
    """(text, doc) -> one row (h, doc) per distinct shingle."""
    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            hashes, offsets = distinct_sets(*shingles(batch.column(0), shingle))
            docs = np.repeat(np.asarray(batch.column(1)), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([_signed(hashes), pa.array(docs)], names=["h", "doc"])
    return process


def _verify(shingle: int, percent: int):
    """(text1, text2, a, b) -> pairs (a, b) whose full sets reach the threshold."""
    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, "text1", 2 << 20), "text2", 2 << 20):
            one, two = (distinct_sets(*shingles(batch.column(i), shingle)) for i in (0, 1))
            ok = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (s[o[i]:o[i + 1]] for s, o in (one, two))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both) and both > 0
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[2:]], names=["a", "b"])
    return process


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the least node reachable. Alternating star steps."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.*").where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def _with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members, with their component and their bucket's largest one, of buckets with several components."""
    placed = _with_components(members, found)
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    return placed.join(largest.select("key", F.col("top.component").alias("top")), "key")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id",
                    keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with n_shingles, component_id (least doc_id reachable) and kept (doc_id is that)."""
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_shingles", "component_id", "kept")]
    base = written(with_columns(plain, "text", _FIELDS, _summary(shingle), keep=["doc"]), "sets")
    sized = base.where("n > 0 and doc is not null")
    classes = written(sized.groupBy("fp1", "fp2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "classes")
    firsts = classes.select("fp1", "fp2", F.col("first").alias("doc"))
    copies = sized.join(classes.where("first < last"), ["fp1", "fp2"]).select(F.col("doc").alias("a"), F.col("first").alias("b")).where("a <> b")

    # buckets of two classes or more
    banded = sized.join(firsts, ["fp1", "fp2", "doc"], "left_semi").select("doc", "n", F.explode("bands").alias("key")).distinct()
    shared = banded.groupBy("key").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("key")
    buckets = written(banded.join(shared, "key", "left_semi"), "buckets")
    release(spark)
    candidates = buckets.select("doc").distinct()
    texts = written(plain.join(candidates, "doc", "left_semi").distinct(), "texts")
    release(spark)

    # 1. shingles that two candidates hold
    rows = texts.select("text", "doc").mapInArrow(_set_rows(shingle), "h long, doc long")
    met = rows.groupBy("h").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("h")
    common = rows.join(met, "h", "left_semi").groupBy("doc").agg(F.count("*").alias("m"))
    members = written(buckets.join(common, "doc").where(100 * F.col("m") >= percent * F.col("n")), "members")
    release(spark)

    def links(pairs: DataFrame) -> DataFrame:
        one = texts.select(F.col("doc").alias("a"), F.col("text").alias("text1"))
        two = texts.select(F.col("doc").alias("b"), F.col("text").alias("text2"))
        return pairs.join(one, "a").join(two, "b").select("text1", "text2", "a", "b").mapInArrow(_verify(shingle, percent), "a long, b long")

    def possible(n1: str, m1: str, n2: str, m2: str):
        overlap = F.least(F.col(m1), F.col(m2))
        return 100 * overlap >= percent * (F.col(n1) + F.col(n2) - overlap)

    # 2. every member against its bucket's hub
    rank = F.struct(F.col("m") / F.col("n"), F.xxhash64("doc"), F.col("doc"), F.col("n"), F.col("m"))
    hubs = members.groupBy("key").agg(F.max(rank).alias("hub")).select("key", F.col("hub.doc").alias("a"), F.col("hub.n").alias("na"), F.col("hub.m").alias("ma"))
    stars = members.join(hubs, "key").where((F.col("doc") != F.col("a")) & possible("n", "m", "na", "ma")).select("a", F.col("doc").alias("b")).distinct()
    first = written(links(stars), "links")
    found = components(first)
    release(spark)

    # 3. in buckets with several components: a member of the largest one, another in each bucket, against the others
    placed = _open(members, found)
    pick = F.when(F.col("component") == F.col("top"), F.struct(F.xxhash64("doc", "key"), F.col("doc"), F.col("n"), F.col("m")))
    others = placed.groupBy("key").agg(F.max(pick).alias("hub")).select("key", F.col("hub.doc").alias("a"), F.col("hub.n").alias("na"), F.col("hub.m").alias("ma"))
    again = placed.where(F.col("component") != F.col("top")).join(others, "key").where(possible("n", "m", "na", "ma"))
    first = written(first.unionByName(links(again.select("a", F.col("doc").alias("b")).distinct())), "links")
    found = components(first)
    release(spark)

    # 4. what is left: pairs across components by prefix filtering
    placed = written(_open(members, found).select("doc", "n", "component").distinct(), "open")
    left = texts.join(placed.select("doc"), "doc", "left_semi")
    rows = written(left.select("text", "doc").mapInArrow(_set_rows(shingle), "h long, doc long"), "shingles")
    frequency = rows.groupBy("h").agg(F.count("*").alias("df"))
    order = Window.partitionBy("doc").orderBy("df", "h")  # a document's shingles, rarest first
    prefix = rows.join(frequency, "h").join(placed, "doc").withColumn("at", F.row_number().over(order) - 1)
    prefix = written(prefix.where((F.col("df") > 1) & (100 * (F.col("n") - F.col("at")) >= percent * F.col("n"))), "prefixes")
    discard(rows)
    release(spark)
    top = prefix.groupBy("h", "component").agg(F.count("*").alias("size")).groupBy("h").agg(
        F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("h", F.col("top.component").alias("top"))
    both = prefix.join(top, "h")
    minor = both.where(F.col("component") != F.col("top")).select("h", F.col("doc").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("at").alias("pa"))
    major = both.select("h", F.col("doc").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("pb"), (F.col("component") == F.col("top")).alias("is_top"))
    need = percent * (F.col("na") + F.col("nb"))  # the overlap needed, times 100 + percent
    across = minor.join(major, (minor["h"] == major["h"]) & (F.col("ca") != F.col("cb")) & (F.col("is_top") | (F.col("a") < F.col("b")))
                        & ((100 + percent) * (F.col("na") - F.col("pa")) >= need) & ((100 + percent) * (F.col("nb") - F.col("pb")) >= need))
    second = links(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    every = written(components(first.unionByName(second).unionByName(copies)), "components")
    discard(texts, buckets, members, placed, prefix)
    release(spark)

    if set(kept) <= {doc_id}:
        out = base.join(every.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component_id", F.coalesce("component", "doc"))
        return out.select(*[F.col("doc").alias(c) for c in kept], F.col("n").alias("n_shingles"), "component_id", (F.col("doc") == F.col("component_id")).alias("kept"))
    node, found = unused(docs, "node"), unused(docs, "found")
    sized_docs = with_columns(docs.withColumn(node, F.col(f"`{doc_id}`").cast("long")), text, [T.StructField("n_shingles", T.LongType())],
                              lambda column: [pa.array(np.diff(distinct_sets(*shingles(column, shingle))[1]))], [*kept, node])
    out = sized_docs.join(every.select(F.col("node").alias(node), F.col("component").alias(found)), node, "left")
    component = F.coalesce(F.col(found), F.col(node))
    return out.select(*kept, "n_shingles", component.alias("component_id"), (F.col(node) == component).alias("kept"))
