"""Phrase collocations from n-gram counts in counting quotient filters.

Texts (A-Z folded) are cut into pieces at punctuation and line ends, pieces into words. Within a language, a candidate is a phrase of
2 to 4 words that occurs `least` times or more. Its parts occur at least as often, so only words seen `least` times need ids:

1. Spark counts all words by language. Those seen often enough are sorted by a 128-bit hash of language and word; their place is their
   id. Sorted hashes are files in the shared folder, which workers memory-map; nothing that grows with the corpus is broadcast.
2. A task packs the ids of each n-gram into two halves, permutes these invertibly (a Feistel network) and counts a chunk of about
   CHUNK n-grams in a counting quotient filter: the leading bits, the quotient, are kept as run lengths, one bit a slot and
   one an entry; the rest, the full remainder, as whole bytes; a counter is a byte, larger ones follow. As permuted keys are a bijection
   of the n-grams, counts are exact, and as they are uniform, every filter falls into shards of like size by its first bits.
3. Sorted filters are merged by shard: RADIX bits at a time, FAN chunks at once, until each shard is one filter of about SHARD n-grams,
   whose frequent entries are permuted back. An n-gram counts once a chunk, however frequent it is.
4. Parts, scores, containment and ranks are joins and aggregates on the frequent n-grams. Scores are exact decimals.

Defined results: a null language is `und`; null and empty texts have no words; repeated rows count each; phrases that tie are ordered by
their bytes; without candidates, and for an empty table, there are no rows; other columns are not looked at. Nothing is pruned or
sampled: n-grams with a rarer word cannot be frequent, and they alone are left out.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .held import held
from .store import discard, mounted, release, written
from .text import Words, buffers, mix, owners, pieces
from .trie import _find

LONGEST = 4
CHUNK = 1_000_000  # n-grams of a chunk; counting takes about 60 bytes each in every worker
SHARD = 1_000_000  # n-grams of a shard, about
RADIX = 9  # bits of a shard dealt in a round
SLICE = 1 << 20  # bytes of text handled at once
FAN = 256  # chunks merged at once, about
VOCABULARY = 1 << 20  # words of a file
_U = np.uint64
_CUT = np.zeros(256, dtype=bool)  # bytes that end a piece
_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _CUT.copy()
_GAP[[32, 9]] = True
_ROUNDS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5)]


def _hashes(words: Words, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word with its text's language."""
    kinds = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
    salt = np.array([np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=16).digest(), dtype="<u8") for lang in kinds], dtype=_U).reshape(-1, 2)
    which = np.repeat(np.array([kinds[lang] for lang in langs], dtype=np.int64), words.counts())
    return mix(words.hashes ^ salt[which, 0]).view(np.int64), mix(words.second ^ salt[which, 1]).view(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> the different words of a slice by language, with counts."""
    for batch in pieces(batches, "text"):
        data, offsets = buffers(batch.column(0))
        words = Words(data, offsets, lower=True, second=True, gap=_GAP)
        langs = batch.column(1).to_pylist()
        h1, h2 = _hashes(words, langs)
        order = np.lexsort((h2, h1))
        new = np.flatnonzero(_new(h1[order], h2[order]))
        some, counts = order[new], np.diff(np.concatenate([new, [len(order)]]))
        text = data.tobytes().lower()
        found = [text[a:b] for a, b in zip(words.starts[some].tolist(), words.ends[some].tolist())]
        owner = owners(words.offsets)[some]
        yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in owner.tolist()], pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(h1[some]), pa.array(h2[some]), pa.array(counts)],
                                         names=["lang", "word", "h1", "h2", "n"])


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    if not len(columns[0]):
        return np.zeros(0, dtype=bool)
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _store_words(path: str):
    """A sorted range of words -> a file of their hashes, and the rows with part and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))]))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number), pa.int32()), pa.array(np.arange(at, at + n)), *batch.columns], names=["part", "place", *batch.schema.names])
            at += n
        if at:
            part = f"{path}/{number}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                np.save(f, np.concatenate(held, axis=1))
            os.replace(part, f"{path}/{number}.npy")  # a repeated task stores the same once more
    return run


class Vocabulary:
    """Memory-mapped sorted hashes; ids begin at 1."""

    def __init__(self, path: str, parts: list[tuple[int, int, int]]):
        """`parts`: (number, words, first hash) in order."""
        self.files = [np.load(f"{path}/{p}.npy", mmap_mode="r") for p, _, _ in parts]
        self.before = np.concatenate([[0], np.cumsum([n for _, n, _ in parts])]).astype(np.int64)
        self.first = np.array([h for _, _, h in parts], dtype=np.int64)

    def ids(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Ids of words, 0 for others."""
        kinds, back = np.unique(h1, return_inverse=True)
        second = np.zeros(len(kinds), dtype=np.int64)
        second[back] = h2
        out = self._look_up(kinds, second)[back]
        twins = np.flatnonzero(second[back] != h2)  # first hashes alike, second ones not
        out[twins] = self._look_up(h1[twins], h2[twins])
        return out

    def _look_up(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), dtype=np.int64)
        part = np.searchsorted(self.first, h1, "right") - 1
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(len(self.files) + 1))
        for p, file in enumerate(self.files):
            some = order[edges[p]:edges[p + 1]]
            if len(some):
                at = _find(file[0], file[1], h1[some], h2[some])
                out[some] = np.where(at >= 0, at + self.before[p] + 1, 0)
        return out


def _vocabulary(path: str, parts: list) -> Vocabulary:
    return held(("phrases", path), lambda: Vocabulary(path, parts))


def permute(a: np.ndarray, b: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """An invertible scrambling of pairs of `half`-bit numbers."""
    mask = _U((1 << half) - 1)
    for i in (0, 2):
        a = a ^ (mix(b + _ROUNDS[i]) & mask)
        b = b ^ (mix(a + _ROUNDS[i + 1]) & mask)
    return a, b


def restore(a: np.ndarray, b: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    mask = _U((1 << half) - 1)
    for i in (2, 0):
        b = b ^ (mix(a + _ROUNDS[i + 1]) & mask)
        a = a ^ (mix(b + _ROUNDS[i]) & mask)
    return a, b


class Chunk:
    """Permuted keys of n-grams, gathered until they are counted; a key that fits into 64 bits is held as one number."""

    def __init__(self, half: int):
        self.half, self.size = half, 0
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append(((a << _U(self.half)) | b,) if 2 * self.half <= 64 else (a, b))
        self.size += len(a)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.size = [], 0
        if len(columns) == 2:
            return counted(*columns, np.ones(len(columns[0]), np.int64), self.half)
        key = columns.pop()
        key.sort()
        new = np.flatnonzero(_new(key))
        counts = np.diff(np.concatenate([new, [len(key)]]))
        key = key[new]
        return key >> _U(self.half), key & _U((1 << self.half) - 1), counts


def counted(a: np.ndarray, b: np.ndarray, counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Permuted keys in order, each once, with its counts added up."""
    order = np.argsort((a << _U(half)) | b, kind="stable") if 2 * half <= 64 else np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(_new(a, b))
    return a[new], b[new], np.add.reduceat(counts[order], new) if len(new) else counts[:0]


def _bytes(values: np.ndarray, bits: int) -> bytes:
    width = -(-bits // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _numbers(data: bytes, bits: int, n: int) -> np.ndarray:
    width = -(-bits // 8)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(n, width)
    return out.view("<u8").reshape(-1)


def pack_filter(a: np.ndarray, b: np.ndarray, counts: np.ndarray, known: int, half: int) -> list[bytes]:
    """A counting quotient filter of sorted keys whose first `known` bits are alike.

    [number of entries, run lengths, remainders, counters, large counters]"""
    n = len(a)
    q = min(max(n.bit_length() - 1, 0), half - known)
    low = half - known - q
    quotient = ((a >> _U(low)) & _U((1 << q) - 1)).astype(np.int64)
    runs = np.zeros(n + (1 << q), dtype=bool)  # an entry is 1, the end of a quotient's run 0
    runs[quotient + np.arange(n)] = True
    large = counts >= 255
    counters = np.where(large, 255, counts).astype(np.uint8)
    shrink = zstandard.ZstdCompressor(level=1).compress
    rest = a & _U((1 << low) - 1)
    rest = _bytes((rest << _U(half)) | b, low + half) if low + half <= 64 else _bytes(rest, low) + _bytes(b, half)
    return [n.to_bytes(8, "little"), np.packbits(runs).tobytes(), rest, shrink(counters.tobytes()), shrink(counts[large].astype("<u8").tobytes())]


def open_filter(parts: list[bytes], prefix: int, known: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first halves, second halves, counts) of a filter, in order."""
    n = int.from_bytes(parts[0], "little")
    q = min(max(n.bit_length() - 1, 0), half - known)
    low = half - known - q
    runs = np.unpackbits(np.frombuffer(parts[1], dtype=np.uint8), count=n + (1 << q)).astype(bool)
    quotient = (np.flatnonzero(runs) - np.arange(n)).astype(_U)
    if low + half <= 64:
        rest = _numbers(parts[2], low + half, n)
        rest, b = rest >> _U(half) if low else np.zeros(n, _U), rest & _U((1 << half) - 1)
    else:
        border = n * -(-low // 8)
        rest, b = _numbers(parts[2][:border], low, n), _numbers(parts[2][border:], half, n)
    a = (quotient << _U(low)) | rest
    if known:
        a |= _U(prefix) << _U(half - known)
    grow = zstandard.ZstdDecompressor().decompress
    counts = np.frombuffer(grow(parts[3]), dtype=np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(grow(parts[4]), dtype="<u8")
    return a, b, counts


FILTERS = "prefix long, chunk long, filter array<binary>"


def _dealt(a, b, counts, known: int, more: int, half: int, chunk: int) -> pa.RecordBatch:
    """A filter for each value of the next `more` bits."""
    prefix = a >> _U(half - known - more) if known + more else np.zeros(len(a), _U)
    edges = np.flatnonzero(_new(prefix)).tolist()
    rows = [(int(prefix[i]), pack_filter(a[i:j], b[i:j], counts[i:j], known + more, half)) for i, j in zip(edges, [*edges[1:], len(a)])]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array([f for _, f in rows], pa.list_(pa.binary()))],
                                      names=["prefix", "chunk", "filter"])


def _count_grams(path: str, parts: list, bits: int, more: int, chunk: int):
    """(text, lang) -> filters of chunks."""
    half = 2 * bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, number = _vocabulary(path, parts), Chunk(half), 0

        def flush():
            nonlocal number
            number += 1
            return _dealt(*held.counted(), 0, more, half, zlib.crc32(f"{TaskContext.get().partitionId()}-{number}".encode()))

        for batch in pieces(batches, "text", SLICE):
            data, offsets = buffers(batch.column(0))
            words = Words(data, offsets, lower=True, second=True, gap=_GAP)
            ids = vocabulary.ids(*_hashes(words, batch.column(1).to_pylist())).astype(_U)
            cuts = np.concatenate([[0], np.cumsum(_CUT[data])])
            piece = cuts[words.starts] + owners(words.offsets)  # both only grow, so the sum changes wherever one does
            for k in range(2, LONGEST + 1):
                n = len(ids) - k + 1
                if n <= 0:
                    continue
                ok = piece[:n] == piece[k - 1:]
                for j in range(k):
                    ok &= ids[j:j + n] > 0
                at = np.flatnonzero(ok)
                first, second = (ids[at] << _U(bits)) | ids[at + 1], np.zeros(len(at), _U)
                if k > 2:
                    second |= ids[at + 2] << _U(bits)
                if k > 3:
                    second |= ids[at + 3]
                held.add(*permute(first, second, half))
            if held.size >= chunk:
                yield flush()
        if held.size:
            yield flush()
    return run


def _merge(known: int, more: int, half: int):
    """Filters of a prefix and group of chunks -> one filter for each value of the next bits."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        prefix, group = key[0].as_py(), key[1].as_py()
        a, b, counts = _opened(table, prefix, known, half)
        return pa.Table.from_batches([_dealt(*counted(a, b, counts, half), known, more, half, group)])
    return run


def _opened(table: pa.Table, prefix: int, known: int, half: int):
    return (np.concatenate(x) for x in zip(*(open_filter(f, prefix, known, half) for f in table.column("filter").to_pylist())))


def _frequent(known: int, bits: int, least: int):
    half = 2 * bits

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b, counts = counted(*_opened(table, key[0].as_py(), known, half), half)
        some = counts >= least
        a, b = restore(a[some], b[some], half)
        mask, shift = _U((1 << bits) - 1), _U(bits)
        words = [a >> shift, a & mask, b >> shift, b & mask]
        return pa.table({**{f"w{i + 1}": pa.array(w.astype(np.int64)) for i, w in enumerate(words)}, "f": pa.array(counts[some])})
    return run


def count_phrases(docs: DataFrame, least: int, chunk: int = CHUNK, shard: int = SHARD, radix: int = RADIX, fan: int = FAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words by language: lang, n), (vocabulary: id, lang, word, n), (frequent phrases: w1..w4, f) of `docs` (text, lang)."""
    spark = docs.sparkSession
    words = written(docs.mapInArrow(_count_words, "lang string, word string, h1 long, h2 long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.min("h1").alias("h1"), F.min("h2").alias("h2")), "words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    often = words.where(F.col("n") >= least)
    about = often.agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).first()
    if about.words >= 1 << 32:
        raise ValueError("ids of frequent words take more than 32 bits")
    path = mounted(spark, "vocabulary")
    ranged = often.select("h1", "h2", "lang", "word", "n").repartitionByRange(about.words // VOCABULARY + 1, "h1", "h2").sortWithinPartitions("h1", "h2")
    placed = written(ranged.mapInArrow(_store_words(path), "part int, place long, h1 long, h2 long, lang string, word string, n long"), "placed")
    parts = [tuple(r) for r in placed.groupBy("part").agg(F.count("*"), F.min("h1")).orderBy("part").collect()]  # a row for each VOCABULARY words
    before, base = 0, []
    for p, n, _ in parts:
        base.append((p, before))
        before += n
    vocabulary = placed.join(F.broadcast(spark.createDataFrame(base, "part int, before long")), "part").select((F.col("place") + F.col("before") + 1).alias("id"), "lang", "word", "n")

    bits = max(before.bit_length(), 1)
    deep = min((3 * (about.tokens or 0) // shard).bit_length(), 2 * bits)
    known, chunks, stored = min(radix, deep), 3 * (about.tokens or 0) // chunk + 1, []
    filters = docs.mapInArrow(_count_grams(path, parts, bits, known, chunk), FILTERS) if parts else spark.createDataFrame([], FILTERS)
    while known < deep:  # deal the next bits, from fewer chunks at each round
        more, chunks = min(radix, deep - known), -(-chunks // fan)
        grouped = filters.withColumn("chunk", F.pmod("chunk", F.lit(chunks)))  # a group's columns need names of their own, so not in groupBy
        merged = grouped.groupBy("prefix", "chunk").applyInArrow(_merge(known, more, 2 * bits), FILTERS)
        filters, known = written(merged, "filters", "none"), known + more
        release(spark)
        discard(*stored)
        stored = [filters]
    phrases = written(filters.groupBy("prefix").applyInArrow(_frequent(known, bits, least), "w1 long, w2 long, w3 long, w4 long, f long"), "phrases")
    release(spark)
    discard(*stored)
    return totals, vocabulary, phrases


def _part(words: list, first: int, size: int) -> list:
    return [words[first + j] if j < size else F.lit(0).cast("long") for j in range(LONGEST)]


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, percent: int = 80, top: int = 2000, **limits) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    plain = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))
    totals, vocabulary, phrases = count_phrases(plain, least, **limits)
    names = ["w1", "w2", "w3", "w4"]
    words = [F.col(n) for n in names]
    size = sum((F.col(n) > 0).cast("int") for n in names)
    phrases = phrases.withColumn("size", size)
    zero = F.lit(0).cast("long")
    counts = phrases.select(*names, "f").unionByName(vocabulary.select(F.col("id").alias("w1"), zero.alias("w2"), zero.alias("w3"), zero.alias("w4"), F.col("n").alias("f")))
    named = lambda part, as_: F.struct(*[p.alias(f"{as_}{j + 1}") for j, p in enumerate(part)])
    cuts = [F.struct(F.lit(k).alias("k"), named(_part(words, 0, k), "l"), named(_part(words, k, s - k), "r")) for s in range(2, LONGEST + 1) for k in range(1, s)]
    at = [(s, k) for s in range(2, LONGEST + 1) for k in range(1, s)]
    chosen = None
    for s in range(2, LONGEST + 1):
        of = F.array(*[c for c, (t, _) in zip(cuts, at) if t == s])
        chosen = F.when(F.col("size") == s, of) if chosen is None else chosen.when(F.col("size") == s, of)
    cut = phrases.select(*names, "f", F.explode(chosen).alias("cut"))
    cut = cut.select(*names, "f", "cut.k", *[F.col("cut")[f"col{i}"][f"{c}{j + 1}"].alias(f"{c}{j + 1}") for i, c in ((2, "l"), (3, "r")) for j in range(LONGEST)])
    for c in "lr":
        part = counts.select(*[F.col(n).alias(f"{c}{j + 1}") for j, n in enumerate(names)], F.col("f").alias(c))
        cut = cut.join(part, [f"{c}{j + 1}" for j in range(LONGEST)])
    score = F.expr("cast(2000000 as decimal(20,0)) * cast(f as decimal(18,0)) div cast(l + r as decimal(20,0))")
    weakest = cut.select(*names, "f", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy(*names, "f").agg(F.min("cut").alias("cut"))

    inner = [(s, t, i) for s in range(3, LONGEST + 1) for t in range(2, s) for i in range(s - t + 1)]
    held = F.filter(F.array(*[F.when(F.col("size") == s, named(_part(words, i, t), "v")) for s, t, i in inner]), lambda x: x.isNotNull())
    within = phrases.where("size > 2").select("f", F.explode(held).alias("v")).groupBy(*[F.col(f"v.v{j + 1}").alias(n) for j, n in enumerate(names)]).agg(F.max("f").alias("longer"))
    left = weakest.join(within, names, "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * percent))

    ids = vocabulary.select("id", "lang", "word")
    best = left.select(*names, F.col("f").alias("a"), "cut.l", "cut.r", "cut.score").join(ids.select(F.col("id").alias("w1"), "lang"), "w1")
    order = [F.desc("score"), F.desc("a")]
    best = best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place")
    spelled = best.select("*", F.posexplode(F.filter(F.array(*names), lambda w: w > 0)).alias("at", "id")).join(ids.select("id", "word"), "id") \
        .groupBy("lang", *names, "a", "l", "r", "score").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
