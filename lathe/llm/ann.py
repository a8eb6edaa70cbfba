"""Largest inner products by shifted space-filling curves.

Inner-product search becomes nearest-neighbour search with one more coordinate: a candidate x has
sqrt(M^2 - |x|^2) there (M: the largest norm), a query is scaled to norm M and has 0. Each curve projects onto a
few directions (random turns of the sample's main axes), shifts the grid at random and orders the points by
Hilbert index. The orders are cut into ranges of equal size; a query meets the candidates of its own range and
of both neighbours in every curve, exact products rerank them, and the curves' lists are merged.

The index is fitted on bounded samples: axes and range borders on `sample_rows` rows, and the number of ranges on
`sample_queries` queries answered exactly over all rows: the most ranges whose recall on them is `target` or more.
With vectors that have no close neighbours this goes down to few ranges. Every row is indexed. A range's
candidates and queries, equal rows taken once, are dealt into chunks by id and vector, so a group's size is bounded however
many equal vectors there are or rows an id has.

Defined results: vectors that are null, empty, zero, hold a null, NaN or infinite component, or have not the usual
number of components, take no part, as queries or candidates; a null id likewise; rows sharing an id are one candidate with
the best of their products, and a query's own id is no candidate; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .text import mix

CURVES, AXES, BITS = 8, 6, 10
SAMPLE_ROWS, SAMPLE_QUERIES, TARGET = 8_192, 256, 0.95
CHUNK_ROWS, CHUNK_QUERIES = 8_192, 2_048
MAX_RANGES = 1_024


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (rows x axes, `bits` bits each; at most 62 bits in all)."""
    x = cells.astype(np.int64).T.copy()
    axes, top = len(x), 1 << (bits - 1)
    step = top
    while step > 1:  # undo the turns and mirrorings, from the coarsest level on
        low = step - 1
        for i in range(axes):
            far = (x[i] & step) != 0
            swap = np.where(far, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(far, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        step >>= 1
    for i in range(1, axes):  # Gray code
        x[i] ^= x[i - 1]
    parity = np.zeros_like(x[0])
    step = top
    while step > 1:
        parity = np.where(x[-1] & step, parity ^ (step - 1), parity)
        step >>= 1
    x ^= parity
    key = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curves:
    """Projections, shifts and grids of all curves, and the borders of their ranges."""

    def __init__(self, sample: np.ndarray, norm: float, curves: int = CURVES, axes: int = AXES, bits: int = BITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.norm, self.bits = norm, bits
        points = self.candidates(sample)
        _, values, turn = np.linalg.svd(points - points.mean(axis=0), full_matrices=False)
        self.axes = min(axes, points.shape[1])
        self.turns, self.low, self.span = [], [], []
        for _ in range(curves):
            mixed = np.linalg.qr(rng.normal(size=(turn.shape[0], turn.shape[0])))[0]
            turned = (turn.T @ mixed)[:, :self.axes]
            seen = points @ turned
            low, high = seen.min(axis=0), seen.max(axis=0)
            width = np.maximum(high - low, 1e-12)
            self.turns.append(turned)
            self.low.append(low - rng.random(turned.shape[1]) * width)
            self.span.append(2 * width)
        self.borders: np.ndarray | None = None

    def candidates(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.norm ** 2 - (x * x).sum(axis=1, keepdims=True), 0))], axis=1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x * (self.norm / np.sqrt((x * x).sum(axis=1, keepdims=True))), np.zeros((len(x), 1))], axis=1)

    def keys(self, points: np.ndarray) -> np.ndarray:
        """Curves x points."""
        top = (1 << self.bits) - 1
        return np.stack([hilbert(np.clip((points @ t - low) / span * top, 0, top), self.bits) for t, low, span in zip(self.turns, self.low, self.span)])

    def ranges(self, keys: np.ndarray, borders: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, k, "right") for b, k in zip(borders, keys)])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, product) of each query's k best others in a block, each id with the best of its rows, ties to smaller ids."""
    by = np.argsort(ids, kind="stable")
    ids, vectors = ids[by], vectors[by]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    room = 1e-9 * max(1.0, float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1])
    for at in range(0, len(queries), 256):
        products = queries[at:at + 256] @ vectors.T
        products[query_ids[at:at + 256, None] == ids[None, :]] = -np.inf
        best = np.maximum.reduceat(products, first, axis=1) if len(first) < len(ids) else products
        least = np.partition(best, len(first) - min(k, len(first)), axis=1)[:, len(first) - min(k, len(first))] - room
        near = (products >= least[:, None]) & np.isfinite(products)
        if len(first) < len(ids):
            near &= products >= best[:, owner] - room
        q, c = np.nonzero(near)
        exact = (queries[at + q] * vectors[c]).sum(axis=1)  # one order of summation, whatever the block
        if len(first) < len(ids):
            order = np.lexsort((-exact, owner[c], q))
            q, c, exact = q[order], c[order], exact[order]
            new = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[c[1:]] != ids[c[:-1]])]) if len(q) else np.zeros(0, bool)
            q, c, exact = q[new], c[new], exact[new]
        order = np.lexsort((ids[c], -exact, q))
        q, c, exact = q[order], c[order], exact[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        out.append((query_ids[at + q[top]], ids[c[top]], exact[top]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _merge(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_FOUND = "query_id long, vec_id long, score double"


def _batch(q: np.ndarray, c: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(s)], names=["query_id", "vec_id", "score"])


def exact_search(rows: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """The k largest products of a few queries (sent to all tasks) over all `rows` (vec_id, vec)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch(*_best(queries, query_ids, _matrix(batch.column(1)), np.asarray(batch.column(0)), k))

    return _merge(rows.select("vec_id", "vec").mapInArrow(run, _FOUND), k)


def _nearest(rows: DataFrame, truth: pd.DataFrame, queries: np.ndarray) -> DataFrame:
    """(query_id, vec_id, vec) of the rows that reach the products in `truth` (vec_id, place in `queries`, query_id, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column(1))
            met = pd.DataFrame({"vec_id": np.asarray(batch.column(0)), "row": np.arange(batch.num_rows)}).merge(truth, on="vec_id")
            for at in range(0, len(met), 1 << 16):
                some = met.iloc[at:at + (1 << 16)]
                products = (queries[some["place"].to_numpy()] * points[some["row"].to_numpy()]).sum(axis=1)
                some = some[products >= some["score"].to_numpy() - 1e-9 * np.maximum(1, np.abs(some["score"].to_numpy()))]
                yield pa.RecordBatch.from_arrays([pa.array(some["query_id"].to_numpy()), pa.array(some["vec_id"].to_numpy()), batch.column(1).take(pa.array(some["row"].to_numpy()))],
                                                 names=["query_id", "vec_id", "vec"])

    return rows.select("vec_id", "vec").mapInArrow(run, "query_id long, vec_id long, vec array<double>")


def _hashes(ids: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of ids with their vectors."""
    bits = np.ascontiguousarray(points + 0.0).view(np.uint64)
    odd = mix(np.arange(1, bits.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    return mix(mix(ids.astype(np.int64).view(np.uint64)) + (mix(bits) * odd).sum(axis=1, dtype=np.uint64))


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    plain = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vec")).where(
        "vec_id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")
    usual = plain.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return plain.where(F.size("vec") == (usual["n"] if usual else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", curves: int = CURVES,
           target: float = TARGET, sample_rows: int = SAMPLE_ROWS, sample_queries: int = SAMPLE_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that `is_query` (over vec_id) names, the k largest inner products found."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, vec_id, vector).distinct(), "vectors")
    total, longest = rows.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def sample(df: DataFrame, n: int, most: int) -> DataFrame:
        share = int(min(1.0, most / max(n, 1)) * (1 << 40))
        return df.where(F.pmod(F.xxhash64("vec_id", "vec", F.lit(3)), F.lit(1 << 40)) < share)  # about `most` rows

    picked = sample(rows, total, sample_rows).limit(2 * sample_rows).select("vec").toArrow()
    picked = picked if picked.num_rows else rows.limit(1).select("vec").toArrow()
    index = Curves(_matrix(picked["vec"].combine_chunks()), float(np.sqrt(longest)), curves)
    sampled_keys = np.sort(index.keys(index.candidates(_matrix(picked["vec"].combine_chunks()))), axis=1)

    def borders(n: int) -> np.ndarray:
        at = (np.arange(1, n) * sampled_keys.shape[1]) // n
        return sampled_keys[:, at]

    asked = rows.where(is_query)
    n_queries = asked.count()
    tried = sample(asked, n_queries, sample_queries).limit(2 * sample_queries).dropDuplicates(["vec_id"]).toArrow()
    n = 1
    if tried.num_rows:
        ids, points = np.asarray(tried["vec_id"]), _matrix(tried["vec"].combine_chunks())
        place = {int(i): p for p, i in enumerate(ids)}
        truth = exact_search(rows, points, ids, k).toPandas()  # sample_queries x k rows
        truth["place"] = truth["query_id"].map(place).astype("int64")
        near = _nearest(rows, truth[["vec_id", "place", "query_id", "score"]], points).dropDuplicates(["query_id", "vec_id"]).select("query_id", "vec").toArrow()
        if near.num_rows:
            which = np.array([place[int(i)] for i in np.asarray(near["query_id"])])
            asked_keys = index.keys(index.queries(points))[:, which]
            near_keys = index.keys(index.candidates(_matrix(near["vec"].combine_chunks())))
            n = min(MAX_RANGES, max(1, sampled_keys.shape[1] // 8))
            while n > 1:
                cut = borders(n)
                met = (np.abs(index.ranges(asked_keys, cut) - index.ranges(near_keys, cut)) <= 1).any(axis=0)
                if met.mean() >= target:
                    break
                n = n * 3 // 4
            n = max(n, 1)
    cut = borders(n)
    parts = curves if n > 3 else 1  # up to three ranges, one curve's middle range sees everything
    row_chunks = max(1, -(-total // (n * CHUNK_ROWS)))
    query_chunks = max(1, -(-3 * n_queries // (n * CHUNK_QUERIES)))
    if n <= 3:
        cut, row_chunks, query_chunks, n = borders(1), max(1, -(-total // CHUNK_ROWS)), max(1, -(-n_queries // CHUNK_QUERIES)), 1

    def dealt(of_queries: bool):
        """Rows -> (grp, chunks, vec_id, vec): one row per curve and range met, and per chunk of the other side."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, points = np.asarray(batch.column(0)), _matrix(batch.column(1))
                spot = index.ranges(index.keys(index.queries(points) if of_queries else index.candidates(points))[:parts], cut)
                own, other = (query_chunks, row_chunks) if of_queries else (row_chunks, query_chunks)
                mine = (_hashes(ids, points) % np.uint64(own)).astype(np.int64)
                for curve in range(parts):
                    for step in ((-1, 0, 1) if of_queries and n > 1 else (0,)):
                        there = spot[curve] + step
                        ok = np.flatnonzero((there >= 0) & (there < n))
                        for c in range(other):
                            a, b = (mine[ok], np.full(len(ok), c)) if of_queries else (np.full(len(ok), c), mine[ok])
                            group = ((curve * n + there[ok]) * query_chunks + a) * row_chunks + b
                            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int64)), batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok))],
                                                             names=["grp", "vec_id", "vec"])
        return run

    kind = "grp long, vec_id long, vec array<double>"
    left = asked.select("vec_id", "vec").mapInArrow(dealt(True), kind)
    right = rows.select("vec_id", "vec").mapInArrow(dealt(False), kind)

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(c) == 0:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        found = _best(np.stack(q["vec"].to_numpy()), q["vec_id"].to_numpy(), np.stack(c["vec"].to_numpy()), c["vec_id"].to_numpy(), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    found = left.groupBy("grp").cogroup(right.groupBy("grp")).applyInPandas(meet, _FOUND)
    return _merge(found, k)
