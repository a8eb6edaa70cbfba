"""Benchmark decontamination: one Aho-Corasick automaton over all benchmark windows.

Texts are normalised (A-Z folded, every other ASCII character a separator) to words joined by
one blank. Each run of `window` item words, blanks around it, is a pattern, and an item of fewer words is a
single pattern, so one pass over a document finds every occurrence. Word positions are mapped back to
character offsets of the original text.

Benchmarks are small beside the corpus, but their size is checked: the item texts are cut into
slices of at most `slice_bytes` (one slice, hence one automaton, up to there), a worker holds the automaton
of one slice at a time, and texts over `max_bytes` in all are refused rather than broadcast.

Defined results: a null or empty text has no words and no hits; an item without words matches
nothing; repeated documents or items each get the same answer (an item_id is listed once);
a null item_id is not listed but its windows hit; extra columns of `docs` are kept.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import with_columns
from .text import buffers

WINDOW = 13
SLICE_BYTES = 256 << 10
MAX_BYTES = 256 << 20

_KEEP = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
NORMALISE = bytes((b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in _KEEP else 32 for b in range(256))

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _words(text: bytes) -> list[bytes]:
    return text.translate(NORMALISE).split()


def _automaton(items: list[tuple[str | None, str]], window: int) -> ahocorasick.Automaton | None:
    found: dict[str, list] = defaultdict(lambda: [0, set()])
    for item_id, text in items:
        words = _words(text.encode())
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            entry = found[" " + b" ".join(words[i:i + size]).decode("latin-1") + " "]
            entry[0] = size
            entry[1].add(item_id)
    if not found:
        return None
    automaton = ahocorasick.Automaton()
    for pattern, (size, ids) in found.items():
        automaton.add_word(pattern, (size, tuple(ids)))
    automaton.make_automaton()
    return automaton


def _scan(words: list[bytes], automaton: ahocorasick.Automaton | None) -> tuple[np.ndarray | None, set]:
    """(mask of hit words, item ids) of one document."""
    if automaton is None or not words:
        return None, set()
    ends, sizes, ids = [], [], set()
    for end, (size, items) in automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
        ends.append(end)
        sizes.append(size)
        ids.update(items)
    if not ends:
        return None, ids
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    after = np.cumsum(lengths + 1)  # place of the blank after each word
    past = np.searchsorted(after, np.array(ends)) + 1
    change = np.bincount(past - np.array(sizes), minlength=len(words) + 1) - np.bincount(past, minlength=len(words) + 1)
    return np.cumsum(change[:-1]) > 0, ids


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character ranges of the original text."""
    raw = np.frombuffer(text.translate(NORMALISE), dtype=np.uint8)
    word = np.concatenate([[False], raw != 32, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    flag = np.concatenate([[False], hit, [False]])
    change = np.flatnonzero(flag[1:] != flag[:-1])
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in zip(change[::2], change[1::2])]


_CACHE: dict = {}


def _scanner(shared, window: int):
    name = uuid.uuid4().hex

    def compute(column: pa.Array) -> list[pa.Array]:
        data, off = buffers(column)
        raw = data.tobytes()
        n = len(off) - 1
        hits: list = [None] * n
        ids: list[set] = [set() for _ in range(n)]
        counts = np.zeros(n, dtype=np.int64)
        for i, items in enumerate(shared.value):
            if _CACHE.get("key") != (name, i):
                _CACHE.clear()  # one automaton at a time
                _CACHE.update(key=(name, i), automaton=_automaton(items, window))
            for row in range(n):
                words = _words(raw[off[row]:off[row + 1]])
                counts[row] = len(words)
                mask, found = _scan(words, _CACHE["automaton"])
                if found:
                    hits[row] = mask if hits[row] is None else hits[row] | mask
                    ids[row] |= found
        return [
            pa.array(counts),
            pa.array([0 if h is None else int(h.sum()) for h in hits], pa.int64()),
            pa.array([sorted(x for x in s if x is not None) for s in ids], pa.list_(pa.string())),
            pa.array([[] if h is None else _spans(raw[off[r]:off[r + 1]], h) for r, h in enumerate(hits)], pa.list_(_SPAN)),
        ]
    return compute


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_text: str = "text",
                       item_id: str = "item_id", keep: list[str] | None = None, slice_bytes: int = SLICE_BYTES,
                       max_bytes: int = MAX_BYTES) -> DataFrame:
    """`docs` (or its columns `keep`) with n_words, n_hit, item_ids and spans.

    `spans` are character ranges of the original text covered by occurring windows."""
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > max_bytes:
        raise ValueError(f"benchmark texts of {total} bytes; at most {max_bytes} are broadcast")
    slices: list[list] = [[]]
    room = slice_bytes
    for row in items.orderBy("id", "text").toLocalIterator():  # at most max_bytes in all, checked above
        size = len(row["text"].encode())
        if size > room and slices[-1]:
            slices.append([])
            room = slice_bytes
        slices[-1].append((row["id"], row["text"]))
        room -= size
    shared = docs.sparkSession.sparkContext.broadcast(slices)
    return with_columns(docs, text, FIELDS, _scanner(shared, window), keep)


def contaminated() -> F.Column:
    """The contamination rule: at least one hit word, and hits in a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
