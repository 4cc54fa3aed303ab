"""Word and shingle hashes of whole texts, computed in numpy on Arrow buffers.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return; A-Z count as a-z.  Every word gets a 64-bit
polynomial hash over a whole buffer at once (prefix sums times inverse powers),
so no Python code runs per word.  Memory is bounded by ``SEGMENT`` bytes of text
at a time; a longer text is cut at white space and its hashes are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text at a time; hashing takes some 25 times as much at once.
SEGMENT = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240501))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_VALUE[65:91] = _VALUE[97:123]
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, SEGMENT)
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(32))


def _hash(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a buffer and the byte position at which each word begins."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    power, inverse = _powers(n)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[firsts] = True
    cut[[0, n]] = True
    begin = cut[:n].copy()
    begin[1:] |= space[:-1]
    begin &= ~space
    end = cut[1:].copy()
    end[:-1] |= space[1:]
    end &= ~space
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed(h + (ends - starts).astype(np.uint64)), starts


class Runs:
    """Maximal runs of letters (ASCII letters and all bytes from 128) of a buffer.

    ``also`` gives further bytes that count as the letter they stand for.
    """

    def __init__(self, data: np.ndarray, firsts: np.ndarray, also: dict[str, str] | None = None):
        n = len(data)
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = letter[128:] = True
        value = _VALUE.copy()
        for sign, meant in (also or {}).items():
            letter[ord(sign)], value[ord(sign)] = True, value[ord(meant)]
        self.power, self.inverse = _powers(n + 1)
        inside = letter[data]
        cut = np.zeros(n + 1, bool)
        cut[firsts] = True
        cut[[0, n]] = True
        begin, end = inside & cut[:n], inside & cut[1:]
        begin[1:] |= inside[1:] & ~inside[:-1]
        end[:-1] |= inside[:-1] & ~inside[1:]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.sums = np.zeros(n + 1, np.uint64)
        placed = value[data]
        placed *= self.power[:n]
        np.cumsum(placed, out=self.sums[1:])
        self.bounds = np.append(np.searchsorted(self.starts, firsts), len(self.starts))

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Hash of each run, or of its first bytes (0 if it is not longer than that)."""
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        h = (self.sums[ends] - self.sums[self.starts]) * self.inverse[self.starts]
        h = mixed(h + (ends - self.starts).astype(np.uint64) + _U((longest or 0) << 32))
        return h if longest is None else np.where(self.ends - self.starts > longest, h, _U(0))


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text that is longer than a segment."""
    parts, at, n = [], 0, len(data)
    while at < n:
        stop = min(at + SEGMENT, n)
        while stop < n and not _SPACE[data[stop]]:
            ahead = np.flatnonzero(_SPACE[data[stop : stop + SEGMENT]])
            stop = stop + int(ahead[0]) if len(ahead) else min(stop + SEGMENT, n)
        parts.append(_hash(data[at:stop], np.zeros(1, np.int64))[0])
        at = stop
    return np.concatenate(parts)


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` (SEGMENT) bytes together, or one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + (most or SEGMENT), "right")) - 1
        stop = min(max(stop, at + 1), n)
        yield at, stop
        at = stop


def hashed(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (index of the first text, word hashes, bounds of each text's words)."""
    data, offsets = buffers(texts)
    for at, stop in slices(offsets):
        part = data[offsets[at] : offsets[stop]]
        if stop == at + 1 and len(part) > SEGMENT:
            h = _long(part)
            yield at, h, np.array([0, len(h)])
        else:
            firsts = offsets[at:stop] - offsets[at]
            h, starts = _hash(part, firsts)
            yield at, h, np.append(np.searchsorted(starts, firsts), len(h))


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Hashes of each text's word k-grams in order, repeated ones included.

    A text of fewer words has its whole sequence as one; without words, none.
    """
    m = len(h) - k + 1
    grams = np.empty(0, np.uint64)
    if m > 0:
        total = h[:m] * _PLACE[0]
        for i in range(1, k):
            total = total + h[i : m + i] * _PLACE[i]
        grams = mixed(total + _U(k))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            yield grams[a : b - k + 1]
        elif b > a:
            few = (h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + _U(b - a)
            yield mixed(np.array([few], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]
