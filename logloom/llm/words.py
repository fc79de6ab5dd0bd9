"""Words of many texts at once, as flat arrays over the texts' bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and return.
Its 64-bit hash is a polynomial in its bytes, A-Z counted as a-z; differences of running sums
give the hashes of all words of a segment in a few array operations. Segments end between
words, so a long text costs no more memory than many short ones.

Texts have no nulls; an empty text, or one of separators only, has no words. Bytes beyond ASCII are part of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from logloom.llm.common import SPACES, mixed

SEGMENT_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[ord(c) for c in SPACES]] = True
LOWERED = np.arange(256, dtype=np.uint64) + np.uint64(1)
LOWERED[ord("A") : ord("Z") + 1] += np.uint64(32)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_powers = [powers(BASE, SEGMENT_BYTES), powers(pow(BASE, -1, 2**64), SEGMENT_BYTES)]


def power_tables(n: int) -> list[np.ndarray]:
    if n > len(_powers[0]):  # one word of more than a segment
        return [powers(BASE, n), powers(pow(BASE, -1, 2**64), n)]
    return _powers


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # of each word in `data`
    ends: np.ndarray
    firsts: np.ndarray  # number of the first word of each text, and of all words at the end
    offsets: np.ndarray  # of each text in `data`, and their end

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))


def words_of(texts: pa.Array) -> Words:
    """`texts` has no nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    space = IS_SPACE[data]
    begins, stops = ~space, ~space
    begins[1:] &= space[:-1]
    stops[:-1] &= space[1:]
    full = np.flatnonzero(np.diff(offsets))
    begins[offsets[full]] = ~space[offsets[full]]
    stops[offsets[full + 1] - 1] = ~space[offsets[full + 1] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], for starts and ends in order."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + SEGMENT_BYTES, "right")))
        size = int(ends[j - 1] - first)
        up, down = power_tables(size)
        with np.errstate(over="ignore"):
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(LOWERED[data[first : first + size]] * up[:size], out=sums[1:])
            at, stop = starts[i:j] - first, ends[i:j] - first
            raw = (sums[stop] - sums[at]) * down[np.minimum(at, size - 1)]
            out[i:j] = mixed(raw ^ (stop - at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of values[i : i + size] at each i, with zeros behind the end."""
    padded = np.concatenate([values, np.zeros(size - 1, np.uint64)])
    out = np.zeros(len(values), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ padded[k : k + len(values)]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
    return mixed(out)
