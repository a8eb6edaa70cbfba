"""Vectorised word splitting and hashing over Arrow string buffers (NumPy inside Spark tasks).

Words are found in the raw UTF-8 buffer of a whole Arrow batch, so no Python string is made
per word. Hashes are 64-bit: bytes map through a fixed random table into a polynomial modulo
2^64 (prefix sums give every word in one pass) and the result is mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1  # odd, so invertible modulo 2^64
_Q = 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return lower, space


LOWER, SPACE = _byte_tables()
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, size=256, dtype=np.int64).astype(_U)
_BYTE_VALUES_2 = np.random.Generator(np.random.PCG64(77003)).integers(1, 1 << 63, size=256, dtype=np.int64).astype(_U)


class _Powers:
    """Growing tables of base^i and base^-i modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=_U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (self._table(b, size) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=_U)
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTE_POWERS, _WORD_POWERS = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift multiply)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def _slices(data: np.ndarray, gap: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about `limit` that never cut a word."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + limit, n)
        while end < n and not gap[data[end]]:
            step = np.flatnonzero(gap[data[end:end + 4096]])
            end = end + int(step[0]) if len(step) else min(end + 4096, n)
        yield at, end
        at = end


class Words:
    """Words of a batch: byte ranges, hashes, and the range of words of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, second: bool = False,
                 gap: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()):
        """`gap`: which bytes separate words; `prefixes`: also hash the first so many bytes of longer words."""
        starts, ends, hashes, others, begun = [], [], [], [], []
        fold = LOWER if lower else np.arange(256, dtype=np.uint8)
        values, values2 = _BYTE_VALUES[fold], _BYTE_VALUES_2[fold]
        borders = np.unique(offsets)
        for a, b in _slices(data, gap, SLICE_BYTES):
            part = data[a:b]
            word = ~gap[part]
            begin, stop = word.copy(), word.copy()
            begin[1:] &= ~word[:-1]
            stop[:-1] &= ~word[1:]
            inner = borders[np.searchsorted(borders, a, "right"):np.searchsorted(borders, b, "left")] - a
            if len(inner):  # a document border ends a word and begins one
                begin[inner] = word[inner]
                stop[inner - 1] = word[inner - 1]
            s, e = np.flatnonzero(begin), np.flatnonzero(stop)
            up, down = _BYTE_POWERS.upto(len(part) + 1)
            hashes.append(self._hash(values[part], up, down, s, e))
            if second:
                others.append(self._hash(values2[part], up, down, s, e))
            if prefixes:
                begun.append(np.stack([np.where(e - s >= p, self._hash(values[part], up, down, s, np.minimum(s + p - 1, e)), _U(0)) for p in prefixes], axis=1))
            starts.append(s + a)
            ends.append(e + a + 1)
        empty = np.zeros(0, np.int64)
        self.starts = np.concatenate(starts) if starts else empty
        self.ends = np.concatenate(ends) if ends else empty
        self.hashes = np.concatenate(hashes) if hashes else empty.astype(_U)
        self.second = np.concatenate(others) if others else (empty.astype(_U) if second else None)
        self.prefixes = np.concatenate(begun) if begun else np.zeros((len(self.starts), len(prefixes)), _U)
        self.offsets = np.searchsorted(self.starts, offsets).astype(np.int64)

    @staticmethod
    def _hash(values: np.ndarray, up: np.ndarray, down: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, dtype=_U)
        np.cumsum(values * up[:len(values)], out=total[1:])
        return mix((total[e + 1] - total[s]) * down[s])

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries (positions 0 .. n-k, borders not minded)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=_U)
    up, down = _WORD_POWERS.upto(n + 1)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[k:] - total[:n - k + 1]) * down[:n - k + 1] + _U(k))


def spans(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of hashes[start:start + size] for each pair."""
    n = len(hashes)
    up, down = _WORD_POWERS.upto(n + 1)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[starts + sizes] - total[starts]) * down[starts] + sizes.astype(_U))


def inside(offsets: np.ndarray, n: int, k: int) -> np.ndarray:
    """Mask over window starts 0 .. n-k: the window lies inside one document."""
    ok = np.ones(max(n - k + 1, 0), dtype=bool)
    for j in range(1, k):  # starts less than k before a border cross it
        cut = offsets[1:-1] - j
        cut = cut[(cut >= 0) & (cut < len(ok))]
        ok[cut] = False
    return ok


def owners(offsets: np.ndarray) -> np.ndarray:
    """Document index of every word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into row ranges holding about `limit` bytes of `column` (bounds task memory)."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(column)))
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            end = min(end, n)
            yield batch.slice(at, end - at)
            at = end


def ints(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(0))
