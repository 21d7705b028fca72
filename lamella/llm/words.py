"""Hashes of the words and shingles of whole texts, computed on Arrow buffers without Python strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer word widens the window for itself.
CHUNK = 1 << 20
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Odd, so it has an inverse modulo 2 ** 64.
POWER = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * M3)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_VALUES = _byte_values()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES = [_powers(POWER, CHUNK + 1), _powers(pow(POWER, -1, 1 << 64), CHUNK + 1)]


def _tables(n: int) -> list[np.ndarray]:
    return _TABLES if n <= CHUNK else [_powers(POWER, n + 1), _powers(pow(POWER, -1, 1 << 64), n + 1)]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows, where each row begins, with the end); a null row is empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all rows in order, words of each row).

    Words are what ASCII white space separates, with A-Z lower-cased. A hash is a sum of a value for
    each byte times a power for its place, from running sums over the whole buffer.
    """
    data, offsets = _bytes_of(column)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, hashes, lo = [], [], 0
    while lo < len(data):
        hi, width = len(data), CHUNK
        while lo + width < len(data):
            cut = np.flatnonzero(_SPACE[data[lo : lo + width]] | edge[lo + 1 : lo + width + 1])
            if len(cut):
                hi = lo + int(cut[-1]) + 1
                break
            width *= 2
        part, rows = data[lo:hi], edge[lo : hi + 1]
        inside = ~_SPACE[part]
        at = np.flatnonzero(inside & (rows[:-1] | np.r_[True, ~inside[:-1]]))
        end = np.flatnonzero(inside & (rows[1:] | np.r_[~inside[1:], True])) + 1
        power, inverse = _tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * power[: len(part)], out=sums[1:])
        hashes.append(mix((sums[end] - sums[at]) * inverse[at] + (end - at).astype(np.uint64) * M3))
        starts.append(at + lo)
        lo = hi
    every = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.diff(np.searchsorted(every, offsets))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its shingles of ``width`` words; of its whole word sequence if that is shorter."""
    h, n = hashed_words(column)

    def joined(words: np.ndarray, k: int) -> np.ndarray:
        out = np.full(max(0, len(words) - k + 1), k, np.uint64)
        for i in range(k):
            out = (out ^ words[i : len(words) - k + 1 + i]) * M3
            out ^= out >> np.uint64(29)
        return mix(out)

    full = joined(h, width)
    out, at = [], 0
    for k in n.tolist():
        out.append(_distinct(full[at : at + k - width + 1]) if k >= width else joined(h[at : at + k], k) if k else h[:0])
        at += k
    return out


def narrow(x: np.ndarray) -> bytes:
    """Numbers by their bytes' places, compressed; of close or small numbers little is left."""
    x = np.ascontiguousarray(x)
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True) if x.size else b""


def wide(data: bytes, n: int, kind=np.int64) -> np.ndarray:
    """The ``n`` numbers that ``narrow`` packed."""
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=size * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def rising(x: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers by their differences."""
    return narrow(np.diff(x, prepend=np.uint64(0)))


def risen(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(wide(data, n, np.uint64))
