"""Words of whole Arrow string columns as 64-bit hashes, by array operations on their UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D; continuation bytes of UTF-8 are never
among those, so bytes and characters agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import memo

SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_values() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of each byte, the same with A-Z as a-z, and which bytes are white space."""
    held = memo("byte codes")
    if not held:
        codes = np.arange(256, dtype=np.uint64)
        lowered = codes.copy()
        lowered[65:91] = codes[97:123]
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        held["all"] = codes, lowered, space
    return held["all"]


def _power(base: int, n: int) -> np.ndarray:
    held = memo("powers")
    have = held.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT + 1), np.uint64(base))
        have[0] = 1
        held[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _segments(raw: np.ndarray, first: int, last: int, space: np.ndarray):
    """Cut [first, last) at white space into pieces of about SEGMENT bytes; a word stays whole."""
    while last - first > SEGMENT:
        cut = first + SEGMENT
        while cut < last and not space[raw[cut]]:
            cut += 1
        yield first, cut
        first = cut
    yield first, last


def _hash_words(raw: np.ndarray, edges: np.ndarray, lower: bool):
    """Word hashes, word starts and ends of raw, where a new document begins at each edge. A word's hash is the sum of a mixed value
    for each (byte, place in the word), mixed again with its length: no two places have values that depend on each other, as the
    powers of a polynomial do."""
    codes, lowered, space = _byte_values()
    n = len(raw)
    solid = ~space[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    total = np.zeros(len(starts) + 1, np.uint64)
    np.cumsum(lengths, out=total[1:])
    place = np.arange(int(total[-1]), dtype=np.uint64) - np.repeat(total[:-1], lengths)
    values = mix(((lowered if lower else codes)[raw[solid]] | place << np.uint64(8)) * np.uint64(_BASE) + np.uint64(1))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    at = total.astype(np.int64)
    return mix(sums[at[1:]] - sums[at[:-1]] + lengths.astype(np.uint64) * np.uint64(_STEP[1])), starts, ends


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of an Arrow string array; null is empty."""
    texts = pa.array(texts).cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def hashed_words(texts: pa.Array, lower: bool = False):
    """Yield (row, hashes, starts, ends) for each text; starts and ends are byte positions in the text."""
    raw, offsets = text_buffers(texts)
    space = _byte_values()[2]
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = row + 1
        while stop < rows and offsets[stop + 1] - offsets[row] <= SEGMENT:
            stop += 1
        first, last = int(offsets[row]), int(offsets[stop])
        if last == first:
            for r in range(row, stop):
                yield r, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        elif stop - row == 1:
            parts = [(h, s + a - first, e + a - first) for a, b in _segments(raw, first, last, space) if b > a
                     for h, s, e in [_hash_words(raw[a:b], np.zeros(1, np.int64), lower)]]
            yield row, *(np.concatenate(x) for x in zip(*parts))
        else:
            edges = offsets[row:stop] - first
            h, s, e = _hash_words(raw[first:last], edges[edges < last - first], lower)
            cuts = np.searchsorted(s, np.append(edges, last - first))
            for i, r in enumerate(range(row, stop)):
                a, b = cuts[i], cuts[i + 1]
                yield r, h[a:b], s[a:b] - edges[i], e[a:b] - edges[i]
        row = stop


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text is one run, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mix(sum((words[i:i + 1] * _STEP[i % 5] for i in range(n)), np.full(1, np.uint64(n))))
    return np.unique(mix(runs(words, width)))


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive words."""
    n = len(words) - width + 1
    if width == 5:
        h = words[:n] * _STEP[0]
        for i in range(1, 5):
            h += words[i:i + n] * _STEP[i]
        return h
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(_BASE, len(words)), out=total[1:])
    return mix((total[width:] - total[:-width]) * _power(_INVERSE, len(words))[:n])
