"""Minimiser segments: which parts of texts can hold a window that stands elsewhere too.

A text is a row of units (words or bytes). A window is ``length`` units in a row; its minimiser is the leftmost of its
``gram``-unit substrings whose hash is least in its upper bits. Equal windows have equal minimisers at equal places. Windows in a row with
one minimiser make a segment, so each window lies in exactly one segment, and equal windows lie in segments with the same
minimiser hash.
"""

from __future__ import annotations

import numpy as np

from sievemill.llm.url_filter import mix

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, mod 2^64."""
    if len(_POW.get("up", ())) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", inverse)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _POW[name] = np.multiply.accumulate(x)
    return _POW["up"][:n], _POW["down"][:n]


class Prefix:
    """Hashes of any range of units in constant time."""

    def __init__(self, units: np.ndarray) -> None:
        n = len(units)
        up, self.down = powers(n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * up[:n], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * self.down[a])


#: A random value for each byte.
BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(0xABCDEF))


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where each text's words begin, with the end): texts are data[offsets[i]:offsets[i + 1]]."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = Prefix(BYTES[data]).of(begin, end)
    return hashes, np.searchsorted(begin, offsets)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values the place of its leftmost least one, by the upper bits of the values: the lower ones
    give way to the place, so that one minimum finds both."""
    bits = np.uint64(max(20, len(values).bit_length()))
    out, span = values >> bits << bits | np.arange(len(values), dtype=np.uint64), 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return (out & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def segments(units: np.ndarray, starts: np.ndarray, length: int, gram: int, reach: int) -> tuple[np.ndarray, ...]:
    """(text, first, windows, size, h, s): text's number, first unit in it, number of windows, number of units, minimiser
    hash, content hash. A segment's units end where a window of ``reach`` units from its last place would, or with the text."""
    none = np.empty(0, np.int64)
    if len(units) < length:
        return (none,) * 6
    prefix = Prefix(units)
    at = np.arange(len(units) - gram + 1)
    grams = prefix.of(at, at + gram)
    best = least(grams, length - gram + 1)
    text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    i = np.flatnonzero(text_of[: len(best)] == text_of[length - 1 :])
    if not len(i):
        return (none,) * 6
    m = best[i]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(i) > 1) | (np.diff(m) != 0)]))
    windows = np.diff(np.append(new, len(i)))
    first = i[new]
    h = grams[m[new]].view(np.int64)
    text = text_of[first]
    end = np.minimum(first + windows - 1 + reach, starts[text + 1])
    s = prefix.of(first, end).view(np.int64)
    return text, first - starts[text], windows, end - first, h, s
