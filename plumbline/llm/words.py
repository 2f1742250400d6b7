"""Words of whole texts as arrays: places, counts per text and 64-bit hashes.

A word is a run of bytes other than the blank and 0x09-0x0D, so it never cuts a
UTF-8 character. All work is done on whole slices of an Arrow column, about
a megabyte at a time; a longer text makes a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each unsigned 64-bit value with its bits spread over all places (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, count: int, step: int) -> np.ndarray:
    out, x, by = np.empty(count, dtype=np.uint64), 1, pow(base, step, 1 << 64)
    for i in range(count):
        out[i] = x
        x = x * by % (1 << 64)
    return out


_LOW = {b: _powers(b, 4096, 1) for b in (_BASE, _BACK)}
_HIGH: dict[int, np.ndarray] = {}


def _power(base: int, places: np.ndarray, most: int) -> np.ndarray:
    """base ** places modulo 2 ** 64, by two short tables."""
    need = (most >> 12) + 1
    if len(_HIGH.get(base, ())) < need:
        _HIGH[base] = _powers(base, max(need, 2048), 4096)
    return _HIGH[base][places >> 12] * _LOW[base][places & 4095]


class Words:
    """``first[i]:first[i + 1]`` are the words of text i; ``starts``/``ends`` their bytes
    in ``data``, ``texts`` the bytes at which texts begin, ``hashes`` one per word."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        data = raw[at[0] : at[-1]]
        self.data = _LOWER[data] if lower else data
        self.texts = at - at[0]
        space = _SPACE[self.data]
        fresh = np.zeros(len(space) + 1, dtype=bool)
        fresh[self.texts] = True
        fresh[0] = fresh[-1] = True
        fresh[1:-1] |= space[:-1]
        word = ~space
        self.starts = np.flatnonzero(word & fresh[:-1])
        fresh[1:-1] &= ~space[:-1]
        fresh[:-1] |= space
        self.ends = np.flatnonzero(word & fresh[1:]) + 1
        self.first = np.searchsorted(self.starts, self.texts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.texts) - 1), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, np.arange(n), n), out=sums[1:])
    got = (sums[ends] - sums[starts]) * _power(_BACK, starts, n)
    return mixed(got ^ (ends - starts).astype(np.uint64))


def release() -> None:
    """Give memory of freed arrays back; a worker process outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(place, part) of consecutive parts of about ``limit`` bytes or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(sizes), 0
    while begin < len(texts):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end
    release()


_ODD = (_powers(0xD1342543DE82EF95, 512, 1) | np.uint64(1))[1:]


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; the last places are left out."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _ODD[k]
    return mixed(out)


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``size`` words each; a shorter
    text's words make one shingle, a text without words has none."""
    hashes = words.hashes
    all_grams = grams(hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            got = np.sort(all_grams[a : b - size + 1])
            out.append(got[np.concatenate(([True], got[1:] != got[:-1]))])
        elif b > a:
            out.append(mixed(grams(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
