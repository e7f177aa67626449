"""Suffix sorting in numpy by Larsson-Sadakane refinement; common prefixes from its rounds' ranks, or in Kasai's manner."""

from __future__ import annotations

import numpy as np


#: Ranks of shards below this size fit three to a sort key.
SMALL = (1 << 21) - 2


def suffix_array(first: np.ndarray, width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, tied): suffixes in the order of their first ``depth`` units or more; by place, whether the suffix is still
    equal to the one before it. first: ranks of the suffixes by their first ``width`` units."""
    order, levels = refined(first, width, depth, None)
    rank = levels[-1][1]
    tied = np.zeros(len(first), bool)
    tied[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    return order, tied


def refined(first: np.ndarray, width: int, depth: int, places: np.ndarray | None) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(order, levels): the suffixes at ``places`` (None: all) in the order of their first ``depth`` units or more, and for
    each round (width, ranks by that width), the least first.

    Every round triples the width (doubles it, from ``SMALL`` places on); only groups of suffixes that are still equal are
    sorted again, by the ranks of what follows. Which places a round must rank follows from the rounds after it: the last
    one ranks the chosen places only, the one before also those that its keys look at. Ranks of other places mean nothing."""
    n = len(first)
    times = 3 if n < SMALL else 2
    bits = 21 if times == 3 else 31
    widths = [width]
    while widths[-1] < depth:
        widths.append(widths[-1] * times)
    need: list[np.ndarray | None] = [None] * len(widths)
    if places is not None:
        mine = np.zeros(n, bool)
        mine[places] = True
        for k in range(len(widths) - 1, 0, -1):
            need[k] = mine
            mine = mine.copy()
            for j in range(1, times):
                if (step := j * widths[k - 1]) < min(n, depth):
                    mine[step:] |= need[k][:-step]
            if mine.mean() > 0.8:
                break
    if times == 3 and n and int(first.max()) < 1 << 42:
        # a sort of numbers that end with the place is much faster than one that gives the places
        ordered = np.sort(first << bits | np.arange(n))
        order, ordered = ordered & ((1 << bits) - 1), ordered >> bits
    else:
        order = np.argsort(first)
        ordered = first[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    ranks = group_ends(ordered)
    rank[order] = ranks
    todo = open_groups(ranks)
    levels = [(width, rank)]
    for wide, chosen in zip(widths[1:], need[1:], strict=True):
        rank = rank.copy()
        if chosen is not None:
            order = order[chosen[order]]
            ranks = group_ends(rank[order])
            at = rank.copy()
            at[order] = ranks
            todo = open_groups(ranks)
        else:
            at = rank
        rows = order[todo]
        key = at[rows]
        for j in range(1, times):
            key = key << bits | rank[np.minimum(rows + j * width, n)] + 1
        # stable: the groups are in order already, and often more than that
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        order[todo] = rows
        # the end of a refined group is the place of its last member
        last = np.concatenate([key[1:] != key[:-1], [True]])[: len(key)]
        size = np.diff(np.flatnonzero(np.concatenate([[True], last])))
        at[rows] = np.repeat(todo[last], size)
        todo = todo[np.repeat(size > 1, size)]
        rank, width = at, wide
        levels.append((width, rank))
    return order, levels


def shared(words: np.ndarray, levels: list[tuple[int, np.ndarray]], order: np.ndarray, most: int) -> np.ndarray:
    """By text place: the longest common prefix, up to ``most`` (the depth of ``refined``), of a suffix in the order with its
    neighbours there; 0 elsewhere. Equal ranks of a round are that round's width in common: the widest first, then what
    follows by the next, and the last bytes by words."""
    n = len(levels[0][1]) - 1
    out = np.zeros(n, np.int64)
    if len(order) < 2:
        return out
    a, b = order[:-1], order[1:]
    length = np.zeros(len(a), np.int64)
    for (width, rank), (wider, _) in zip(levels[-2::-1], levels[:0:-1], strict=True):
        live = np.flatnonzero(length < most)
        for _ in range(wider // width - 1):
            x, y = a[live] + length[live], b[live] + length[live]
            live = live[(np.maximum(x, y) < n) & (rank[np.minimum(x, n)] == rank[np.minimum(y, n)]) & (length[live] < most)]
            length[live] += width
    live = np.flatnonzero(length < most)
    x, y = a[live] + length[live], b[live] + length[live]
    length[live] += 8 - STEPS.searchsorted(words[x] ^ words[y], side="right")
    length = np.minimum(length, most)
    out[b] = length
    out[a] = np.maximum(out[a], length)
    return out


def group_ends(ordered: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(np.concatenate([ordered[1:] != ordered[:-1], [True]])[: len(ordered)])
    return np.repeat(ends, np.diff(ends, prepend=-1))


def open_groups(ranks: np.ndarray) -> np.ndarray:
    """Places of suffixes that share their rank with another."""
    alone = np.diff(ranks, prepend=-1) > 0
    alone[:-1] &= alone[1:]
    return np.flatnonzero(~alone)


def packed(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` (at most 7) bytes from each place on, read as one number; zeros follow the end."""
    long = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.zeros(len(data), np.int64)
    for j in range(width):
        out = out << 8 | long[j : j + len(data)]
    return out


def words8(data: np.ndarray, extra: int) -> np.ndarray:
    """Eight bytes from each place on, big-endian; zeros follow the end, for extra places more."""
    long = np.concatenate([data, np.zeros(extra + 8, np.uint8)])
    n = len(long) - 8
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | long[j : j + n]
    return out


#: The least 64-bit words with 1, 2, ... 8 bytes from the first that isn't zero.
STEPS = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)


def common(words: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix from places a and b on, of which ``known`` bytes are known, up to ``most``."""
    last = len(words) - 1
    x, y = a + known, b + known
    same = 8 - STEPS.searchsorted(words[x] ^ words[y], side="right")
    out = known + same
    on = np.flatnonzero((same == 8) & (out < most))
    if len(on):
        # few are left as a rule, with long prefixes: all their words at once
        ahead = 8 * np.arange(1, -(-most // 8) + 1)
        differ = words[np.minimum(x[on, None] + ahead, last)] ^ words[np.minimum(y[on, None] + ahead, last)]
        stop = (differ != 0).argmax(axis=1)
        word = differ[np.arange(len(on)), stop]
        out[on] += np.where(word == 0, most, 8 * stop + 8 - STEPS.searchsorted(word, side="right"))
    return np.minimum(out, most)


def kasai(words: np.ndarray, order: np.ndarray, tied: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """By text place: the common prefix with the suffix before it in the order, up to ``most``.

    Kasai's bound (a place's common prefix is at least its left neighbour's less one) is used along all the pieces that
    begin at ``starts`` at once, one place of each at a time. It needs a strict order: behind a suffix that is tied with the
    one before it, it holds just for the place that follows that same suffix; else it starts at 0."""
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    sizes = np.diff(np.append(starts, n))
    by = np.argsort(-sizes, kind="stable")
    heads, sizes = starts[by], sizes[by]
    held, past, loose = np.zeros(len(heads), np.int64), np.full(len(heads), -1, np.int64), np.zeros(len(heads), bool)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, -t, side="left"))
        at = heads[:k] + t
        prev = before[at]
        low = np.maximum(held[:k] - 1, 0)
        low[(prev < 0) | loose[:k] & (prev != past[:k] + 1)] = 0
        length = np.zeros(k, np.int64)
        ok = np.flatnonzero(prev >= 0)
        length[ok] = common(words, at[ok], prev[ok], low[ok], most)
        out[at] = length
        held[:k], past[:k], loose[:k] = length, prev, tied[at]
    return out


def only(order: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The suffixes at some places, in order."""
    mine = np.zeros(len(order), bool)
    mine[places] = True
    return order[mine[order]]


def among(prefix: np.ndarray, order: np.ndarray, places: np.ndarray) -> np.ndarray:
    """By text place: the longest common prefix with any other of the suffixes at ``places``, for these; 0 elsewhere.

    prefix: common prefixes with the suffix before. Two suffixes share what all between them share with their neighbours,
    and of the chosen ones the nearest on either side share most."""
    out = np.zeros(len(order), np.int64)
    mine = np.zeros(len(order), bool)
    mine[places] = True
    rank = np.flatnonzero(mine[order])
    if len(rank) > 1:
        shared = np.minimum.reduceat(prefix[order[: rank[-1] + 1]], rank[:-1] + 1)
        chosen = order[rank]
        out[chosen[1:]] = shared
        out[chosen[:-1]] = np.maximum(out[chosen[:-1]], shared)
    return out


def find_equal(words: np.ndarray, order: np.ndarray, other: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes (a multiple of 8) of another text from each place on start a suffix of this one.

    words, other: eight-byte words of the two texts; order: this text's suffixes. All binary searches go on at once."""
    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(order), np.int64)
    found = np.zeros(len(places), bool)
    live = np.arange(len(places))
    while len(live):
        middle = (low[live] + high[live]) // 2
        side = np.zeros(len(live), np.int64)
        rows = np.arange(len(live))
        for t in range(0, size, 8):
            x, y = other[places[live[rows]] + t], words[order[middle[rows]] + t]
            side[rows[x < y]] = -1
            side[rows[x > y]] = 1
            rows = rows[x == y]
            if not len(rows):
                break
        found[live[side == 0]] = True
        low[live] = np.where(side > 0, middle + 1, low[live])
        high[live] = np.where(side < 0, middle, high[live])
        live = live[(side != 0) & (low[live] < high[live])]
    return found
