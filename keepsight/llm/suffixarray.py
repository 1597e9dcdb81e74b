"""Suffix arrays of byte shards by induced sorting, and their permuted common prefixes.

The first level sorts bytes bucket by bucket: within a bucket, suffixes are
induced a wave at a time (a wave is what the wave before it has put into the
same bucket), so each suffix is touched once, in numpy. Names of leftmost-smaller
substrings have an alphabet of any size; that reduced problem, about a third of
the shard, is sorted by the same rule suffix by suffix.
"""

from __future__ import annotations

import numpy as np


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix of s is smaller than the next one; s ends in a unique smallest value."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    after = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal values ends
    return np.append(step[after] > 0, True)


def leftmost(types: np.ndarray) -> np.ndarray:
    return np.flatnonzero(types[1:] & ~types[:-1]) + 1


def induce(s: np.ndarray, types: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller suffixes in order."""
    count = np.bincount(s, minlength=size)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(len(s), -1, np.int64)
    c = s[seeds]
    by = np.argsort(c, kind="stable")
    n_seeds = np.bincount(c, minlength=size)
    seed_start = np.cumsum(n_seeds) - n_seeds
    sa[(end - n_seeds)[c[by]] + np.arange(len(seeds)) - seed_start[c[by]]] = seeds[by]

    def put(block: np.ndarray, smaller: bool, free: np.ndarray) -> None:
        j = block[block > 0] - 1
        j = j[types[j] == smaller]
        if not len(j):
            return
        x = s[j]
        order = np.argsort(x, kind="stable")
        x, j = x[order], j[order]
        values, first, n = np.unique(x, return_index=True, return_counts=True)
        rank = np.arange(len(x)) - np.repeat(first, n)
        if smaller:
            sa[free[x] - 1 - rank] = j
            free[values] -= n
        else:
            sa[free[x] + rank] = j
            free[values] += n

    head, used = start.copy(), np.flatnonzero(count)
    for c in used.tolist():
        at = int(start[c])
        while at < head[c]:
            wave = int(head[c])
            put(sa[at:wave], False, head)
            at = wave
        if n_seeds[c]:
            put(sa[end[c] - n_seeds[c] : end[c]].copy(), False, head)
    tail = end.copy()
    for c in used[::-1].tolist():
        at = int(end[c])
        while at > tail[c]:
            wave = int(tail[c])
            put(sa[wave:at][::-1], True, tail)
            at = wave
        if head[c] > start[c]:
            put(sa[start[c] : head[c]][::-1].copy(), True, tail)
    sa[0] = len(s) - 1  # the end, which nothing precedes in order
    return sa


def substring_names(s: np.ndarray, places: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings at places, by their order; and how many there are."""
    length = np.zeros(len(s), np.int64)
    length[places[:-1]] = np.diff(places) + 1
    a, b = ordered[:-1], ordered[1:]
    same = (length[a] == length[b]) & (length[a] > 0)
    left, k = np.flatnonzero(same), 0
    while len(left):
        differs = s[a[left] + k] != s[b[left] + k]
        same[left[differs]] = False
        left = left[~differs]
        k += 1
        left = left[length[a[left]] > k]
    name = np.zeros(len(s), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[places], int(len(ordered) - same.sum())


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """The order of the suffixes of s, of values below size; the last value is a unique 0."""
    types = smaller_types(s)
    places = leftmost(types)
    if not len(places):
        return np.concatenate([[len(s) - 1], np.argsort(s[:-1], kind="stable")[::-1]]) if len(s) < 2 else induce(s, types, np.array([len(s) - 1]), size)
    sa = induce(s, types, places, size)
    marked = np.zeros(len(s), bool)
    marked[places] = True
    ordered = sa[marked[sa]]
    names, n = substring_names(s, places, ordered)
    if n < len(places):
        ordered = places[np.array(induced_by_value(names.tolist(), n), np.int64)]
    return induce(s, types, ordered, size)


def induced_by_value(s: list[int], size: int) -> list[int]:
    """suffix_array() for an alphabet of any size, a suffix at a time."""
    n = len(s)
    if n == size:
        out = [0] * n
        for i, x in enumerate(s):
            out[x] = i
        return out
    arr = np.array(s, np.int64)
    types_of = smaller_types(arr)
    places = leftmost(types_of)
    types = types_of.tolist()
    ends = np.cumsum(np.bincount(arr, minlength=size))
    starts = np.concatenate([[0], ends[:-1]])

    def run(seeds: list[int]) -> list[int]:
        sa = [-1] * n
        free = ends.tolist()
        for i in reversed(seeds):
            x = s[i]
            free[x] -= 1
            sa[free[x]] = i
        free = starts.tolist()
        for i in sa:
            if i > 0 and not types[i - 1]:
                x = s[i - 1]
                sa[free[x]] = i - 1
                free[x] += 1
        free = ends.tolist()
        for k in range(n - 1, -1, -1):
            i = sa[k]
            if i > 0 and types[i - 1]:
                x = s[i - 1]
                free[x] -= 1
                sa[free[x]] = i - 1
        return sa

    if not len(places):
        return run([n - 1])
    sa = np.array(run(places.tolist()), np.int64)
    marked = np.zeros(n, bool)
    marked[places] = True
    ordered = sa[marked[sa]]
    names, found = substring_names(arr, places, ordered)
    if found < len(places):
        ordered = places[np.array(induced_by_value(names.tolist(), found), np.int64)]
    return run(ordered.tolist())


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number; data is padded at its end."""
    w = np.concatenate([data, np.zeros(7, data.dtype)]).astype(np.uint64)
    for bits in (8, 16, 32):
        step = bits // 8
        w = w[:-step] | (w[step:] << np.uint64(bits))
    return w


def common_prefixes(words: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each suffix of order (all at least limit long), how many of its first limit bytes it shares with the one before it in order; the first shares none."""
    out = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    k = 0
    while len(left) and k < limit:
        take = min(8, limit - k)
        x = words[order[left] + k] ^ words[order[left - 1] + k]
        x &= np.uint64((1 << 8 * take) - 1) if take < 8 else np.uint64(0xFFFFFFFFFFFFFFFF)
        lowest = x & (~x + np.uint64(1))
        out[left] += np.where(x == 0, take, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
        left = left[x == 0]
        k += 8
    return out


def equal_windows(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, group) of all windows of width bytes; windows are equal when their groups are.

    The strings stand in one shard, each behind a separator. Its suffix array is
    kept to the windows; a window's common prefix with the one before it in that
    order says whether it opens a group, and stands at the window's place in the
    shard (permuted), where it is read in text order.
    """
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    lengths = np.array([len(x) for x in strings], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    s = data.astype(np.int64) + 2
    s[ends] = 1
    sa = suffix_array(np.append(s, 0), 258)
    owner = np.repeat(np.arange(len(strings)), lengths + 1)
    whole = np.append(np.arange(len(data)) + width <= ends[owner], False)
    order = sa[whole[sa]]
    permuted = np.zeros(len(data), np.int64)
    permuted[order] = common_prefixes(words_at(data), order, width)
    group = np.zeros(len(data), np.int64)
    group[order] = np.cumsum(permuted[order] < width)
    places = np.flatnonzero(whole[:-1])
    return owner[places], places - (ends - lengths)[owner[places]], group[places]
