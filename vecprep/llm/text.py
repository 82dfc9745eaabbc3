"""Vectorised work on UTF-8 text: words, their 64-bit hashes and compact arrays for shuffles.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D); A-Z count as a-z. Words are told
apart by a 64-bit polynomial hash over random byte values, finished by a bijective mixer; the chance that any two of
n words collide is about n**2 / 2**65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: freed arrays of 1 MB and more go back to the system at once
    pa.set_memory_pool(pa.system_memory_pool())
except (OSError, AttributeError):
    _LIBC = None


def give_memory_back() -> None:
    """Python workers outlive many stages: return what is free to the system."""
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


_PIECE = 1 << 19
_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int = _PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` + 1 powers of the base and of its inverse modulo 2**64, or more; kept unless ``n`` is large."""
    if _POWERS and n <= _PIECE:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(max(n, _PIECE) + 1, base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= _PIECE:
        _POWERS.extend(made)
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher (the one of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not pa.types.is_string(column.type) and not pa.types.is_binary(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of segments that span at most ``_PIECE`` bytes; a longer segment stands alone."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        yield i, j
        i = j


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of each byte range; ranges ascend and don't overlap."""
    table, (power, inverse) = _FOLDED if fold else _VALUE, _powers()
    out = np.empty(len(starts), np.uint64)
    for i, j in pieces(starts, ends):
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a <= _PIECE:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(table[data[a:b]] * power[: b - a], out=sums[1:])
            s = starts[i:j] - a
            out[i:j] = (sums[ends[i:j] - a] - sums[s]) * inverse[s]
        else:
            total, shift = 0, 1
            for x in range(a, b, _PIECE):
                part = data[x : min(x + _PIECE, b)]
                total += shift * int(np.sum(table[part] * power[: len(part)], dtype=np.uint64))
                shift = shift * pow(_BASE, _PIECE, 2**64) % 2**64
            out[i] = np.uint64(total % 2**64)
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text where its words begin (n + 1)."""
    solid = ~_SPACE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, solid[:-1]
        cut = offsets[:-1][offsets[:-1] < len(data)]
        before[cut] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1], after[:-1] = False, solid[1:]
        cut = offsets[1:][(offsets[1:] > 0)] - 1
        after[cut] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a string column, and for each text where its words begin (n + 1)."""
    data, offsets = string_buffers(column)
    starts, ends, at = word_ranges(data, offsets)
    return segment_hashes(data, starts, ends), at


def byte_runs(column: pa.Array, limit: int = 32 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (one row at least), to bound memory whatever the batch holds."""
    _, offsets = string_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
        give_memory_back()


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Integers or floats as bytes: differences if asked, byte planes, then Zstandard."""
    values = np.ascontiguousarray(values)
    if delta and len(values):
        values = np.concatenate([values[:1], values[1:] - values[:-1]])
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(values.dtype.str.encode().ljust(8) + bytes([delta]) + planes)


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind, delta = np.dtype(raw[:8].strip().decode()), raw[8]
    planes = np.frombuffer(raw, np.uint8, offset=9).reshape(kind.itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if delta else values


def pack_many(*arrays: np.ndarray, delta: tuple[int, ...] = ()) -> bytes:
    """Several arrays as one value; those at the places in ``delta`` ascend."""
    parts = [pack(a, i in delta) for i, a in enumerate(arrays)]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unpack_many(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(unpack(data[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def look_up(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value among sorted distinct keys, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)
