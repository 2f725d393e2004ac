"""Words, shingles and lines of whole Arrow batches of texts, with numpy.

A batch is cut into slices of a few megabytes, so memory depends on the slice
(or on one very long text), not on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE_BYTES = 2 << 20
#: Bytes hashed at once; each takes a few 64-bit numbers meanwhile.
HASH_BYTES = 128 << 10

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NO_TERM = np.ones(256, bool)
_NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: 0 white space, 1 letters, digits and characters above ASCII, 2 all else.
_KIND = np.where(_ASCII_SPACE, 0, np.where(_NO_TERM, 2, 1)).astype(np.int8)
_LINE_BREAK = np.zeros(256, bool)
_LINE_BREAK[0x0A] = True
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class Local(dict):
    """Values kept by a process; functions that travel to executors take it along empty."""

    def __reduce__(self):
        return Local, ()


_powers = Local()


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Row slices of at most ``size`` bytes of text, or of a single row; unused memory goes back at the end."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + size, "right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop
    _release()


def _release() -> None:
    """Give back memory that a worker no longer uses: it lives on while others work."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # that of numpy, too


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets; a null text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, HASH_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


@dataclass
class Runs:
    """Maximal runs of bytes (words or lines) of a slice of texts.

    ``first[d] : first[d + 1]`` are the runs of text ``d``; ``start`` and
    ``end`` are byte positions in the slice; ``hash`` is the same for equal
    bytes wherever they stand.
    """

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _run_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray):
    filled = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = filled.copy()
    starts[1:] &= ~filled[:-1] | edge[1:-1]
    ends = filled.copy()
    ends[:-1] &= ~filled[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte ranges through one running sum per block."""
    out = np.empty(len(start), np.uint64)
    done = 0
    while done < len(start):
        low = start[done]
        stop = max(int(np.searchsorted(end, low + HASH_BYTES, "right")), done + 1)
        block = data[low : end[stop - 1]].astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(block * _power(_BASE, len(block)), out=total[1:])
        a, b = start[done:stop] - low, end[done:stop] - low
        value = (total[b] - total[a]) * _power(_BASE_INVERSE, len(block))[a]
        out[done:stop] = mix(value + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        done = stop
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Runs:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts, A-Z lower-cased on request."""
    if lower:
        data = _LOWER[data]
    start, end = _run_bounds(data, offsets, _ASCII_SPACE)
    return Runs(_hash_runs(data, start, end), start, end, np.searchsorted(start, offsets))


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Where characters of scripts without spaces, and those beyond U+FFFF, begin."""
    then = np.append(data[1:], np.uint8(0))
    found = (data >= 0xE3) & (data <= 0xE9) | (data >= 0xF0)
    found |= (data == 0xE0) & (then >= 0xB8) | (data == 0xEF) & (then >= 0xA4) & (then <= 0xAB)
    found |= (data == 0xE1) & ((then >= 0x80) & (then <= 0x82) | (then == 0x9E) | (then == 0x9F))
    found |= (data == 0xE2) & (then >= 0xBA)
    return np.flatnonzero(found)


def tokens(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """Runs of word characters, runs of other visible ones, and single characters of unspaced scripts."""
    kind = _KIND[data]
    fresh = np.zeros(len(data) + 5, bool)
    fresh[offsets] = True
    lead = _unspaced(data)
    fresh[lead] = True
    fresh[lead + np.where(data[lead] >= 0xF0, 4, 3)] = True
    fresh[1 : len(data)] |= kind[1:] != kind[:-1]
    fresh[len(data)] = True
    filled = kind != 0
    start = np.flatnonzero(fresh[: len(data)] & filled)
    end = np.flatnonzero(fresh[1 : len(data) + 1] & filled) + 1
    return Runs(_hash_runs(data, start, end), start, end, np.searchsorted(start, offsets))


def term_runs(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """Runs of digits, letters and characters above ASCII, A-Z lower-cased."""
    data = _LOWER[data]
    start, end = _run_bounds(data, offsets, _NO_TERM)
    return Runs(_hash_runs(data, start, end), start, end, np.searchsorted(start, offsets))


def lines(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """Non-empty lines of the texts, without their line breaks."""
    start, end = _run_bounds(data, offsets, _LINE_BREAK)
    return Runs(_hash_runs(data, start, end), start, end, np.searchsorted(start, offsets))


def shingles(runs: Runs, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words that stay within a text, and where each starts."""
    n = len(runs.hash) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value = np.zeros(n, np.uint64)
    for j in range(width):
        value = value * np.uint64(0x9DDFEA08EB382D69) + runs.hash[j : j + n]
    text = runs.text_of()
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    return mix(value[at]), at
