"""Byte n-grams of texts as integers: a text's stream is its lower-cased words, joined by one space, and an end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The longest context; a gram is the context and the byte that follows, in 48 bits.
ORDER = 5
#: Before and after each stream; no word holds this byte.
EDGE = b"\n"
BLOCK = 1 << 20


def streams(words: list[list[bytes]]) -> list[bytes]:
    return [b" ".join(w) + EDGE for w in words]


def grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, where each part's grams begin): every byte of every part with the ORDER bytes before it (edges at first)."""
    sizes = np.array([len(p) for p in parts], np.int64)
    pad = EDGE * ORDER
    flat = np.frombuffer(pad + pad.join(parts), np.uint8)
    out = np.zeros(len(flat) - ORDER, np.int64)
    for j in range(ORDER + 1):
        out |= flat[ORDER - j : len(flat) - j].astype(np.int64) << (8 * j)
    begins = np.cumsum(sizes) - sizes
    keep = np.ones(len(out), bool)
    for j in range(ORDER):
        gaps = begins[1:] + ORDER * np.arange(len(parts) - 1) + j
        keep[gaps[gaps < len(out)]] = False
    return out[keep], begins


def blocks(parts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of parts of about limit bytes each; a longer part makes a range of its own."""
    start, size = 0, 0
    for i, p in enumerate(parts):
        if size and size + len(p) > limit:
            yield start, i
            start, size = i, 0
        size += len(p)
    if start < len(parts):
        yield start, len(parts)


def counted(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and their counts."""
    found = [np.unique(grams(parts[a:b])[0], return_counts=True) for a, b in blocks(parts)]
    return merged(found)


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(found) == 1:
        return found[0][0], found[0][1].astype(np.int64)
    keys = np.concatenate([k for k, _ in found])
    counts = np.concatenate([c for _, c in found]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return merged([(keys, counts), (keys[:0], counts[:0])])


def looked_up(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of keys in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys
