"""Token-id files: canonical length-limited Huffman codes in independent blocks.

Ids of all documents, in ascending doc_id order (nulls first, repeated ids side by side), form one
sequence. Code lengths come from the global counts (package-merge, at most `max_length` bits) and define the
canonical codes, so the stored code table is one length per id. The file format is a folder of Parquet tables:

- `codes`: id, bits - the canonical code table;
- `blocks`: one row per block of whole documents: part, block, start (within the part), n_ids, doc_ids,
  lengths, checkpoints (bit offset of every STEP-th id of each document, from its first, uint64) and payload
  (big-endian bit stream, documents begin at whole bytes);
- `parts`: part, start - ids of all parts before; parts are in doc_id order.

A block is decoded by table look-ups on its own; all its checkpoints advance together, so decoding
is vectorised. The only data that meet on the driver are the counts and lengths by id, bounded by the vocabulary
(`MAX_VOCABULARY`, checked). Null and empty texts are documents of just the end id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import with_columns
from .text import buffers, ints, pieces
from .tokens import encoder

MAX_LENGTH = 20
MAX_VOCABULARY = 1 << 19
STEP = 512  # ids between checkpoints
BLOCK_IDS = 1 << 18  # a block ends with the document that reaches it


def tokenize(docs: DataFrame, tokenizer: str, end: int | None, text: str = "text", keep: list[str] | None = None, width: int = 4) -> DataFrame:
    """`docs` (or its columns `keep`) with `ids` (little-endian unsigned, `width` bytes each: 2 or 4) and `n_tokens`."""
    def compute(column: pa.Array) -> list[pa.Array]:
        ids, offsets = encoder(tokenizer, end).encode(column)
        if int(ids.max(initial=0)) >> 8 * width:
            raise ValueError(f"id {ids.max()} needs more than {width} bytes")
        return [_binary(ids.astype(f"<u{width}"), offsets * width), pa.array(np.diff(offsets))]

    return with_columns(docs, text, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], compute, keep)


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for positive counts (package-merge)."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, dtype=np.uint8)
    if n == 1:
        return np.ones(1, dtype=np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes over {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    leaf_masks = []
    level = weights
    mask = np.ones(n, dtype=bool)
    for _ in range(limit):
        leaf_masks.append(mask)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        rank = np.argsort(merged, kind="stable")
        level, mask = merged[rank], rank < n
    lengths = np.zeros(n, dtype=np.uint8)
    take = 2 * n - 2
    for mask in reversed(leaf_masks):
        leaves = int(mask[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (min(take, len(mask)) - leaves)
    out = np.zeros(n, dtype=np.uint8)
    out[order] = lengths
    return out


class Codes:
    """Canonical codes: by (length, id), each code follows the one before."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.width = int(self.bits[-1]) if len(ids) else 1
        spans = np.left_shift(1, self.width - self.bits)
        self.codes = np.right_shift(np.concatenate([[0], np.cumsum(spans)[:-1]]), self.width - self.bits) if len(ids) else self.ids
        top = int(self.ids.max()) + 1 if len(ids) else 1
        self.code_of, self.bits_of = np.zeros(top, dtype=np.uint32), np.zeros(top, dtype=np.uint8)
        self.code_of[self.ids], self.bits_of[self.ids] = self.codes, self.bits
        self.spans = spans if len(ids) else np.zeros(0, np.int64)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """By the next `width` bits: place among `ids` and length in one number (place * 32 + length); the ids."""
        look = np.ones(1 << self.width, dtype=np.uint32)
        filled = int(self.spans.sum())
        look[:filled] = np.repeat(np.arange(len(self.ids)) << 5 | self.bits, self.spans)
        return look, np.append(self.ids, 0).astype(np.uint32)


def encode_bits(codes: Codes, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bit offset of every id within its document, byte offsets of the documents); `offsets`: ids of the documents."""
    bits = codes.bits_of[ids]
    ends = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(bits, out=ends[1:])
    first = ends[offsets[:-1]]
    sizes = (ends[offsets[1:]] - first + 7) // 8
    byte = np.concatenate([[0], np.cumsum(sizes)])
    inner = ends[:-1] - np.repeat(first, np.diff(offsets))
    words = np.zeros(int(byte[-1]) // 4 + 2, dtype=np.uint64)
    if len(ids):
        at = ends[:-1] + np.repeat(8 * byte[:-1] - first, np.diff(offsets))
        place, shift = at >> 5, (64 - (at & 31) - bits).astype(np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        # 64 bits from word `place` on; codes don't overlap, so sums are unions
        wide, place = np.add.reduceat(codes.code_of[ids] << shift, begin), place[begin]
        words[place] += wide >> np.uint64(32)
        words[place + 1] += wide & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").view(np.uint8)[: int(byte[-1])], inner, byte


def stretches(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among all ids, number of ids) of each stretch of at most STEP ids, document by document."""
    per = -(-lengths // STEP)
    inner = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(np.cumsum(lengths) - lengths, per) + inner * STEP
    return begin, np.minimum(STEP, np.repeat(lengths, per) - inner * STEP)


def decode_bits(table: tuple[np.ndarray, np.ndarray], width: int, payload: np.ndarray, checkpoints: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids of a block; all stretches between checkpoints advance together."""
    look, ids = table
    begin, size = stretches(lengths)
    order = np.argsort(-size, kind="stable")  # those that still run come first
    begin, size, at = begin[order], size[order], checkpoints.astype(np.int64)[order]
    out = np.zeros(int(lengths.sum()), dtype=np.uint32)
    data = np.concatenate([payload, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    # 32 bits from every byte on hold 7 spent bits and a code of up to 25
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    spare, mask = 32 - width, (1 << width) - 1
    running = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # stretches longer than i
    for count in running.tolist():
        now, place = at[:count], begin[:count]
        entry = look.take(window.take(now >> 3) >> (spare - (now & 7)) & mask)
        out[place] = entry
        now += entry & 31
        place += 1
    return ids.take(out >> 5)


BLOCK = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("checkpoints", T.BinaryType()), T.StructField("payload", T.BinaryType()),
])


def _count(width: int):
    """Stage ids -> (id, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in pieces(batches, "ids"):
            got = np.bincount(np.frombuffer(buffers(batch.column(0))[0], dtype=f"<u{width}"))
            if len(got) > len(counts):
                got[:len(counts)] += counts
                counts = got
            else:
                counts[:len(got)] += got
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], names=["id", "n"])
    return run


def _encode(lengths: np.ndarray, symbols: np.ndarray, bounds: np.ndarray, width: int):
    """Stage (doc_id, ids) -> (doc_id, n, checkpoints, payload, part); `bounds`: the last doc_id of each part but the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(symbols, lengths)
        for batch in pieces(batches, "ids", width << 18):
            data, off = buffers(batch.column(1))
            offsets = off // width
            payload, inner, byte = encode_bits(codes, np.frombuffer(data, dtype=f"<u{width}"), offsets)
            sizes = np.diff(offsets)
            begin, _ = stretches(sizes)
            marks = np.concatenate([[0], np.cumsum(-(-sizes // STEP))]) * 8
            keys = batch.column(0)
            part = np.searchsorted(bounds, ints(keys))
            part[np.asarray(keys.is_null())] = 0  # nulls come first
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes), _binary(inner[begin].astype("<u8"), marks), _binary(payload, byte), pa.array(part.astype(np.int32))],
                                             names=["doc_id", "n", "checkpoints", "payload", "part"])
    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coded documents in order -> blocks."""
    part, block, start = None, 0, 0
    doc_ids, sizes, marks, chunks, held, base = [], [], [], [], 0, 0

    def flush():
        nonlocal block, start, doc_ids, sizes, marks, chunks, held, base
        row = {"part": part, "block": block, "start": start, "n_ids": held, "doc_ids": doc_ids, "lengths": sizes,
               "checkpoints": np.concatenate(marks).astype("<u8").tobytes(), "payload": b"".join(chunks)}
        block, start = block + 1, start + held
        doc_ids, sizes, marks, chunks, held, base = [], [], [], [], 0, 0
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([
            ("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())]))

    for batch in batches:
        for key, n, points, payload, own in zip(*(c.to_pylist() for c in batch.columns)):
            if own != part:
                if doc_ids:
                    yield flush()
                part, block, start = own, 0, 0
            doc_ids.append(key)
            sizes.append(n)
            marks.append(np.frombuffer(points, dtype="<u8") + np.uint64(8 * base))
            chunks.append(payload)
            held, base = held + n, base + len(payload)
            if held >= BLOCK_IDS:
                yield flush()
    if doc_ids:
        yield flush()


def write_ids(tokens: DataFrame, path: str, doc_id: str = "doc_id", max_length: int = MAX_LENGTH, parts: int | None = None, width: int = 4) -> None:
    """Write the ids of `tokens` (doc_id, ids of `width` bytes each) in ascending doc_id order as a folder in the format above.

    `tokens` is read three times (counts, range bounds, blocks), so pass a stored table. Documents travel coded."""
    spark = tokens.sparkSession
    counted = tokens.select("ids").mapInArrow(_count(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counted.orderBy("id").limit(MAX_VOCABULARY + 1).collect()  # one row per id of the vocabulary
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} different ids")
    symbols = np.array([r["id"] for r in rows], dtype=np.int64)
    lengths = code_lengths(np.array([r["n"] for r in rows], dtype=np.int64), max_length)
    spark.createDataFrame([(int(s), int(b)) for s, b in zip(symbols, lengths)], "id long, bits int").write.mode("overwrite").parquet(f"{path}/codes")
    # ranges of doc_id from the ids alone, so that coding runs once
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tokens = tokens.select(F.col(doc_id).cast("long").alias("doc_id"), "ids")
    bounds = sorted(set(tokens.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    coded = tokens.mapInArrow(_encode(lengths, symbols, np.array(bounds), width), "doc_id long, n long, checkpoints binary, payload binary, part int")
    blocks = coded.repartition(n, "part").sortWithinPartitions("part", "doc_id", "payload").mapInArrow(_blocks, BLOCK)
    blocks.write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")
    totals = spark.read.schema(BLOCK).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part file
    totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.mode("overwrite").parquet(f"{path}/parts")


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents of a folder that `write_ids` wrote: doc_id, start, n_tokens, ids_crc32 and, unless `ids` is False, ids."""
    table = spark.read.schema("id long, bits int").parquet(f"{path}/codes").limit(MAX_VOCABULARY).collect()
    symbols = np.array([r["id"] for r in table], dtype=np.int64)
    lengths = np.array([r["bits"] for r in table], dtype=np.int64)
    out = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(symbols, lengths)
        look = codes.table()
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                sizes = np.array(row["lengths"], dtype=np.int64)
                got = decode_bits(look, codes.width, np.frombuffer(row["payload"], dtype=np.uint8), np.frombuffer(row["checkpoints"], dtype="<u8"), sizes)
                ends = np.cumsum(sizes)
                raw = got.astype("<u4")
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                columns = [pa.array(np.full(len(sizes), row["part"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - sizes),
                           pa.array(sizes), pa.array(crcs, pa.int64())]
                if ids:
                    columns.append(_binary(raw, np.concatenate([[0], ends]) * 4))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    docs = spark.read.schema(BLOCK).parquet(f"{path}/blocks").mapInArrow(decode, out)
    parts = spark.read.schema("part int, start long").parquet(f"{path}/parts").select("part", F.col("start").alias("before"))
    joined = docs.join(F.broadcast(parts), "part")  # one row per part file
    return joined.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
