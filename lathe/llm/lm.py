"""Language-model scoring: an interpolated modified Kneser-Ney bigram model counted in Spark.

Tokens are words (A-Z folded) and one end per text; the first token's context is a begin mark. The model is a folder
of sorted arrays in the shared folder, which workers memory-map:

- `vocabulary-*`: word hashes in ascending order, and their counts; a word's id is its place among all parts;
- `pairs-*`: by shard, the pairs (context id, word id) as ascending 64-bit keys, and their counts;
- `words-*`: by range of ids, what the pairs say about a word: count as a context, successors seen once, twice and more often, and
  the number of different words before it.

Texts are cut into chunks of about CHUNK tokens and read twice. To count, a chunk sends each shard (a hash range of pairs)
its different training pairs once, with their counts, packed; these are merged by FAN chunks at a time until one group a shard
is left, which stores its arrays. What shards say about words is merged likewise, SPREAD shards at a time. So a pair counts once
a chunk in a group, however frequent it is. To score, a chunk sends its pairs with the documents they occur in to their shard's
rows, which are read as a stream; pairs that occur often in a chunk go by shard and a salt of the chunk, so that their documents
are split. Sums return by chunk. Counts cover all training texts; nothing is pruned. The number of shards grows with the tokens,
and no group's memory does.

Discounts come from the counts of counts (Chen and Goodman); where those are too few, 0.5, 1 and 1.5. The lowest order
mixes continuation counts with the uniform distribution over the known words and one unknown, so each context's probabilities sum to one.

Defined results: null and empty texts are one token, the end; texts that `learn` leaves null do not train; without
training texts, every token has probability 1 / (known words + 1) = 1; repeated rows are scored, and counted, each.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, mounted, release, written
from .text import Words, buffers, mix, owners, pieces

CHUNK = 1_500_000  # tokens sorted together by a task
SHARD = 2_000_000  # tokens of a shard
RANGE = 1 << 18  # word ids of a file of word statistics
FAN = 1024  # chunks whose counts of a shard are merged at once
SPREAD = 64  # shards whose word statistics of a range are merged at once
SALTED = 16  # chunks that share a salt; pairs seen less often in a chunk are never salted
SHARE = 256  # a pair that is so large a part of a chunk is salted
END = -6148914691236517206  # hash of the end token
_U = np.uint64


def _save(path: str, array: np.ndarray) -> None:
    """Write an array under its final name at once, so that retried and duplicate tasks do no harm."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{path}.npy")


def _pack(array: np.ndarray) -> bytes:
    """Integers as compressed byte planes (their upper planes are mostly zeros)."""
    width = array.dtype.itemsize
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").reshape(-1)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different values, how many of each) of a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.concatenate([first, [len(ordered)]]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (h, n): training words of a slice."""
    for batch in pieces(batches, "text", 8 << 20):
        words = Words(*buffers(batch.column(0)), lower=True)
        kinds, counts = _runs(np.sort(words.hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kinds, END)), pa.array(np.append(counts, batch.num_rows))], names=["h", "n"])


class Vocabulary:
    """Memory-mapped word hashes and counts."""

    def __init__(self, path: str, parts: list[tuple[int, int, int]]):
        """`parts`: (number, words, first hash) in order."""
        self.hashes = [np.load(f"{path}/vocabulary-{p}-hash.npy", mmap_mode="r") for p, _, _ in parts]
        self.counts = [np.load(f"{path}/vocabulary-{p}-count.npy", mmap_mode="r") for p, _, _ in parts]
        self.before = np.concatenate([[0], np.cumsum([n for _, n, _ in parts])]).astype(np.int64)
        self.first = np.array([h for _, _, h in parts], dtype=np.int64)

    def look_up(self, hashes: np.ndarray, unknown: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of signed hashes."""
        kinds, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(kinds), unknown, dtype=np.int64), np.zeros(len(kinds), dtype=np.int64)
        part = np.searchsorted(self.first, kinds, "right") - 1
        edges = np.searchsorted(part, np.arange(len(self.first) + 1))
        for p in range(len(self.first)):
            some = kinds[edges[p]:edges[p + 1]]
            if len(some):
                at = np.minimum(np.searchsorted(self.hashes[p], some), len(self.hashes[p]) - 1)
                hit = self.hashes[p][at] == some
                ids[edges[p]:edges[p + 1]] = np.where(hit, self.before[p] + at, unknown)
                counts[edges[p]:edges[p + 1]] = np.where(hit, self.counts[p][at], 0)
        return ids[back], counts[back]


_OPEN: dict = {}


def _vocabulary(path: str, parts: list) -> Vocabulary:
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Vocabulary(path, parts)
    return _OPEN[path]


PACKED = "grp long, kind int, chunk string, salt long, payload array<binary>"
COUNTED = "grp long, kind int, bucket long, payload array<binary>"
PAIRS, DOCS, STATS, COUNTS = range(4)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()),
                                       pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.list_(pa.binary()))], names=["grp", "kind", "chunk", "salt", "payload"])


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                                       pa.array(columns[3], pa.list_(pa.binary()))], names=["grp", "kind", "bucket", "payload"])


def _small(array: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them."""
    return array.astype(np.min_scalar_type(int(array.max(initial=0))))


def _pairs(vocabulary: Vocabulary, texts: pa.Array, known: int):
    """(pair of each token, the token's count, words of each text, bounds of the texts with their ends)."""
    begin, unknown = known, known + 1
    end_id, end_count = (int(x[0]) for x in vocabulary.look_up(np.array([END]), unknown)) if known else (unknown, 0)
    words = Words(*buffers(texts), lower=True)
    ids, counts = vocabulary.look_up(words.hashes.view(np.int64), unknown) if known else (np.full(len(words), unknown), np.zeros(len(words), np.int64))
    n = words.counts()
    bounds = words.offsets + np.arange(len(n) + 1)  # with an end after each text
    token, count = np.full(len(ids) + len(n), end_id, dtype=np.int64), np.full(len(ids) + len(n), end_count, dtype=np.int64)
    inner = np.arange(len(ids)) + owners(words.offsets)
    token[inner], count[inner] = ids, counts
    context = np.concatenate([[begin], token[:-1]])
    context[bounds[:-1]] = begin
    return context.astype(_U) * _U(known + 2) + token.astype(_U), count, n, bounds


def _by_shard(kinds: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of ascending pairs by shard, each shard's edges in it)."""
    shard = (mix(kinds) % _U(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    return by, np.searchsorted(shard[by], np.arange(shards + 1))


def _pair_counts(path: str, parts: list, known: int, shards: int, buckets: int, chunk: int):
    """(text) -> packed counts of each chunk's different pairs, by shard and bucket of chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, parts)
        held: list[np.ndarray] = []
        size, number = 0, 0

        def flush():
            nonlocal held, size, number
            kinds, counts = _runs(np.sort(np.concatenate(held)))
            by, edges = _by_shard(kinds, shards)
            kinds, counts = kinds[by], counts[by]
            bucket = zlib.crc32(f"{TaskContext.get().partitionId()}-{number}".encode()) % buckets
            rows = []
            for s in np.flatnonzero(np.diff(edges)).tolist():
                at = slice(edges[s], edges[s + 1])
                rows.append((s, PAIRS, bucket, [_pack(np.diff(kinds[at], prepend=_U(0))), _pack(_small(counts[at]))]))
            held, size, number = [], 0, number + 1
            return _counted(rows)

        for batch in pieces(batches, "text"):
            held.append(_pairs(vocabulary, batch.column(0), known)[0])
            size += len(held[-1])
            if size >= chunk:
                yield flush()
        if held:
            yield flush()
    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ascending pairs, counts) of packed counts."""
    found = [x.as_py() for x in table.column("payload")]
    key, count = np.concatenate([np.cumsum(_unpack(x[0])) for x in found]), np.concatenate([_unpack(x[1]).astype(np.int64) for x in found])
    order = np.argsort(key)
    kinds, sizes = _runs(key[order])
    return kinds, np.add.reduceat(count[order], np.cumsum(sizes) - sizes)


def _merge_counts(fan: int):
    """Counts of one shard and bucket -> one row, for the bucket of `fan` buckets."""
    def run(table: pa.Table) -> pa.Table:
        kinds, counts = _merged(table)
        return pa.Table.from_batches([_counted([(table.column("grp")[0].as_py(), PAIRS, table.column("bucket")[0].as_py() // fan,
                                                 [_pack(np.diff(kinds, prepend=_U(0))), _pack(_small(counts))])])])
    return run


def _collect_shard(path: str, known: int, spread: int):
    """All counts of a shard -> its arrays (stored), and what they say about words."""
    def run(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        kinds, total = _merged(table)
        _save(f"{path}/pairs-{grp}-key", kinds)
        _save(f"{path}/pairs-{grp}-count", _small(total))
        context, word = (kinds // _U(known + 2)).astype(np.int64), (kinds % _U(known + 2)).astype(np.int64)
        rows = [(grp, COUNTS, 0, [np.array([(total == k).sum() for k in (1, 2, 3, 4)], dtype=np.int64).tobytes()])]
        ids, where = np.unique(np.concatenate([context, word]), return_inverse=True)
        as_context, as_word = where[:len(context)], where[len(context):]
        columns = [np.bincount(as_context, weights=total, minlength=len(ids)), *(np.bincount(as_context[m], minlength=len(ids)) for m in (total == 1, total == 2, total > 2)),
                   np.bincount(as_word, minlength=len(ids))]
        edges = np.searchsorted(ids, np.arange(0, (known + 2) // RANGE + 2) * RANGE)
        for r in np.flatnonzero(np.diff(edges)).tolist():
            at = slice(edges[r], edges[r + 1])
            rows.append((r, STATS, grp // spread, [_pack((ids[at] - r * RANGE).astype(np.uint32)), *(_pack(_small(c[at].astype(np.uint64))) for c in columns)]))
        return pa.Table.from_batches([_counted(rows)])
    return run


def _dense(table: pa.Table) -> np.ndarray:
    """Sums of packed word statistics of one range."""
    dense = np.zeros((5, RANGE), dtype=np.int64)
    for payload in (x.as_py() for x in table.column("payload")):
        ids = _unpack(payload[0])
        for i in range(5):
            dense[i, ids] += _unpack(payload[i + 1]).astype(np.int64)
    return dense


def _merge_range(spread: int):
    """Statistics of one range and bucket of shards -> one row, for the bucket of `spread` buckets."""
    def run(table: pa.Table) -> pa.Table:
        dense = _dense(table)
        ids = np.flatnonzero(dense.any(axis=0))
        return pa.Table.from_batches([_counted([(table.column("grp")[0].as_py(), STATS, table.column("bucket")[0].as_py() // spread,
                                                 [_pack(ids.astype(np.uint32)), *(_pack(_small(d[ids])) for d in dense)])])])
    return run


def _collect_range(path: str):
    """All statistics of one range of word ids -> one array (stored) and sums over its words."""
    def run(table: pa.Table) -> pa.Table:
        dense = _dense(table)
        _save(f"{path}/words-{table.column('grp')[0].as_py()}", dense)
        before = dense[4]
        return pa.table({"total": pa.array([int(before.sum())]), **{f"n{k}": pa.array([int((before == k).sum())]) for k in (1, 2, 3, 4)},
                         "more": pa.array([int((before > 2).sum())])})
    return run


def _chunks(path: str, parts: list, known: int, tokens: int, shards: int, chunk: int):
    """(doc_id, text, train) -> packed pairs by shard with their documents, and a row of the documents of each chunk."""
    many = max(1, tokens // chunk)  # chunks, about
    often, salts = SHARD // 8 // many, max(SHARE, many // SALTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, parts)
        held: list[tuple] = []
        size, number = 0, 0

        def flush():
            nonlocal held, size, number
            key, doc = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            name = f"{TaskContext.get().partitionId()}-{number}"
            salt = zlib.crc32(name.encode())
            docs = [np.concatenate([h[i] for h in held]) for i in range(2, 8)]
            order = np.argsort(key)
            kinds, counts = _runs(key[order])
            doc = doc[order].astype(np.uint32)
            starts = np.cumsum(counts) - counts
            rows = [(-1 - salt, DOCS, name, 0, [np.ascontiguousarray(x).tobytes() for x in docs])]
            for hot in (False, True):
                some = np.flatnonzero((counts >= max(SALTED, min(often, len(doc) // SHARE))) == hot)
                by, edges = _by_shard(kinds[some], shards)
                some = some[by]
                sizes = counts[some]
                upto = np.concatenate([[0], np.cumsum(sizes)])
                at = doc[np.repeat(starts[some] - upto[:-1], sizes) + np.arange(upto[-1])]
                for s in np.flatnonzero(np.diff(edges)).tolist():
                    a, b = edges[s], edges[s + 1]
                    rows.append((s, PAIRS, name, 1 + salt % salts if hot else 0, [_pack(np.diff(kinds[some[a:b]], prepend=_U(0))), _pack(_small(sizes[a:b])), _pack(at[upto[a]:upto[b]])]))
            held, size, number = [], 0, number + 1
            return _record(rows)

        for batch in pieces(batches, "text"):
            key, count, n, bounds = _pairs(vocabulary, batch.column(1), known)
            base = np.add.reduceat(np.log10((count + 0.5) / (tokens + 0.5 * (known + 1))), bounds[:-1])
            seen = np.concatenate([[0], np.cumsum(count > 0)])
            first = sum(len(h[2]) for h in held)
            doc_ids = batch.column(0)
            held.append((key, np.repeat(first + np.arange(len(n)), n + 1), np.asarray(doc_ids.fill_null(0)), np.asarray(doc_ids.is_valid()).astype(np.uint8), n + 1,
                         seen[bounds[1:]] - seen[bounds[:-1]], base, np.asarray(batch.column(2)).astype(np.uint8)))
            size += len(key)
            if size >= chunk:
                yield flush()
        if held:
            yield flush()
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(float(min(max(d, 0.0), k)) for k, d in enumerate(found, 1)) if min(found) > 0 else (0.5, 1.0, 1.5)


def _less(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts, not below 0."""
    return np.maximum(count - np.select([count <= 0, count == 1, count == 2], [0.0, d[0], d[1]], d[2]), 0)


def _score(path: str, known: int, high: tuple, low: tuple, total: int, spread: float):
    """Packed pairs, ordered by shard -> (chunk, documents, sums of log10 probabilities); rows of documents as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, np.ndarray] = {}

        def about(ids: np.ndarray) -> np.ndarray:
            out = np.zeros((5, len(ids)), dtype=np.float64)
            for r in np.unique(ids // RANGE).tolist():
                if r not in ranges:
                    name = f"{path}/words-{r}.npy"
                    ranges[r] = np.load(name, mmap_mode="r") if os.path.exists(name) else np.zeros((5, RANGE), dtype=np.int64)
                at = np.flatnonzero(ids // RANGE == r)
                out[:, at] = ranges[r][:, ids[at] - r * RANGE]
            return out

        opened, stored, counts = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                grp, kind, chunk, payload = (batch.column(c)[i].as_py() for c in ("grp", "kind", "chunk", "payload"))
                if kind == DOCS:
                    yield _record([(0, DOCS, chunk, 0, payload)])
                    continue
                kinds, sizes, doc = np.cumsum(_unpack(payload[0])), _unpack(payload[1]).astype(np.int64), _unpack(payload[2]).astype(np.int64)
                if grp != opened:  # rows come by shard; one without training pairs has no arrays
                    there = os.path.exists(f"{path}/pairs-{grp}-key.npy")
                    stored, counts = (np.load(f"{path}/pairs-{grp}-{x}.npy", mmap_mode="r") if there else np.zeros(0, _U) for x in ("key", "count"))
                    opened = grp
                count = np.zeros(len(kinds), dtype=np.float64)
                if len(stored):
                    at = np.minimum(np.searchsorted(stored, kinds), len(stored) - 1)
                    count = np.where(stored[at] == kinds, counts[at], 0).astype(np.float64)
                context, word = (kinds // _U(known + 2)).astype(np.int64), (kinds % _U(known + 2)).astype(np.int64)
                of, one, two, more, _ = about(context)
                before = about(word)[4]
                lower = (_less(before, low) / total if total else 0.0) + spread / (known + 1)
                share = (high[0] * one + high[1] * two + high[2] * more) / np.maximum(of, 1)
                p = np.where(of > 0, _less(count, high) / np.maximum(of, 1) + share * lower, lower)
                sums = np.bincount(doc, weights=np.repeat(np.log10(p), sizes))
                docs = np.flatnonzero(np.bincount(doc))
                yield _record([(0, PAIRS, chunk, 0, [docs.astype("<u4").tobytes(), sums[docs].astype("<f8").tobytes()])])
    return run


def _finish(table: pa.Table) -> pa.Table:
    """A chunk's documents and all its shards' sums -> rows."""
    docs, parts = None, []
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload")):
        if kind == DOCS:
            docs = payload.as_py()
        else:
            parts.append(payload.as_py())
    ids, valid, n, seen, base, train = (np.frombuffer(x, dtype=t) for x, t in zip(docs, ("<i8", "u1", "<i8", "<i8", "<f8", "u1")))
    score = np.zeros(len(ids))
    for at, sums in parts:
        score[np.frombuffer(at, "<u4")] += np.frombuffer(sums, "<f8")
    return pa.table({"doc_id": pa.array(ids, mask=valid == 0), "n_tokens": n, "n_known": seen, "base_score": base, "score": score, "learned": pa.array(train != 0)})


def score_texts(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK, shard: int = SHARD,
                fan: int = FAN, spread: int = SPREAD) -> DataFrame:
    """Fit on the texts `learn` names and score all: doc_id, n_tokens, n_known, train_tokens, base_score, score, learned.

    base_score is the additive unigram model's log10 probability, score the Kneser-Ney model's."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))
    path = mounted(spark, "lm")

    counted = rows.where("train").select("text").mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = written(counted, "words")
    known, tokens = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if got:
            part = TaskContext.get().partitionId()
            hashes, counts = (np.concatenate(x) for x in zip(*got))
            _save(f"{path}/vocabulary-{part}-hash", hashes)
            _save(f"{path}/vocabulary-{part}-count", counts)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(hashes)]), pa.array([int(hashes[0])])], names=["part", "n", "first"])

    n_parts = max(1, -(-known // RANGE))
    parts = counted.repartitionByRange(n_parts, "h").sortWithinPartitions("h").mapInArrow(store, "part long, n long, first long")
    parts = [tuple(r) for r in sorted(parts.collect())]  # a row per RANGE words
    discard(counted)
    release(spark)

    shards = max(1, -(-int(tokens * 1.3) // shard))
    buckets = max(1, -(-int(tokens) // (chunk * fan)))
    pairs = rows.where("train").select("text").mapInArrow(_pair_counts(path, parts, known, shards, buckets, chunk), COUNTED)
    while buckets > 1:
        pairs = pairs.groupBy("grp", "bucket").applyInArrow(_merge_counts(fan), COUNTED)
        buckets = -(-buckets // fan)
    stored = written(pairs.groupBy("grp").applyInArrow(_collect_shard(path, known, spread), COUNTED), "word-stats")
    release(spark)
    n = [0, 0, 0, 0]
    for r in stored.where(F.col("kind") == COUNTS).select("payload").toLocalIterator():  # four numbers a shard
        n = [a + int(b) for a, b in zip(n, np.frombuffer(r["payload"][0], np.int64))]
    stats = stored.where(F.col("kind") == STATS)
    buckets = -(-shards // spread)
    while buckets > 1:
        stats = stats.groupBy("grp", "bucket").applyInArrow(_merge_range(spread), COUNTED)
        buckets = -(-buckets // spread)
    sums = stats.groupBy("grp").applyInArrow(_collect_range(path), "total long, n1 long, n2 long, n3 long, n4 long, more long")
    got = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "n1", "n2", "n3", "n4", "more")]).first()
    discard(stored)
    high, low = discounts(*n), discounts(got["n1"], got["n2"], got["n3"], got["n4"])
    total = got["total"]
    spread_mass = (low[0] * got["n1"] + low[1] * got["n2"] + low[2] * got["more"]) / total if total else 1.0
    release(spark)

    packed = rows.mapInArrow(_chunks(path, parts, known, tokens, shards, chunk), PACKED).repartition("grp", "salt").sortWithinPartitions("grp")
    scored = packed.mapInArrow(_score(path, known, high, low, total, spread_mass), PACKED)
    out = scored.select("chunk", "kind", "payload").groupBy("chunk").applyInArrow(_finish, "doc_id long, n_tokens long, n_known long, base_score double, score double, learned boolean")
    return out.withColumn("train_tokens", F.lit(int(tokens)).cast("long"))
