"""Suffix arrays by induced sorting, and permuted longest common prefixes, in NumPy.

Suffixes are classified as L (larger than the next suffix) or S; the leftmost S suffixes are sorted by their substrings
up to the next of them and, where these repeat, recursively over the substrings' ranks; all others are induced in two scans. Over bytes a
scan runs one bucket at a time: all entries of a bucket induce at once, in waves where a letter repeats. Over ranks
(deeper levels, large alphabets) it runs entry by entry.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

_SMALL_ALPHABET = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that follows (the end counts as smaller than all)."""
    n = len(s)
    smaller = np.zeros(n, bool)
    if n > 1:
        step = np.sign(s[1:] - s[:-1])
        at = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n))
        at = np.minimum.accumulate(at[::-1])[::-1]
        smaller[:-1] = np.where(at < n, step[np.minimum(at, n - 2)] > 0, False)
    return smaller


def _scatter(at: np.ndarray, letters: np.ndarray, edge: np.ndarray, sa: np.ndarray, down: bool) -> None:
    """Append ``at`` to their letters' buckets in the order given, upward from heads or downward from tails."""
    order = np.argsort(letters.astype(np.uint16), kind="stable")
    letters, at = letters[order], at[order]
    first = np.ones(len(letters), bool)
    first[1:] = letters[1:] != letters[:-1]
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(letters)))
    rank = np.arange(len(letters)) - np.repeat(begin, size)
    own = letters[begin]
    if down:
        sa[edge[letters] - 1 - rank] = at
        edge[own] -= size
    else:
        sa[edge[letters] + rank] = at
        edge[own] += size


def _induce_buckets(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The array induced from ``lms`` (in order within each bucket), bucket by bucket."""
    n, k = len(s), len(starts) - 1
    sa = np.full(n, -1, np.int32)
    head = starts[:-1].copy()
    sorted_lms = lms[np.argsort(s[lms], kind="stable")]
    lms_start = np.searchsorted(s[sorted_lms], np.arange(k + 1))
    _scatter(np.asarray([n - 1]), s[n - 1 :].astype(np.int64), head, sa, False)
    for c in range(k):
        done = starts[c]
        while done < head[c]:
            wave = sa[done : head[c]]
            done = head[c]
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _scatter(before, s[before].astype(np.int64), head, sa, False)
        own = sorted_lms[lms_start[c] : lms_start[c + 1]]
        before = own[own > 0] - 1
        if len(before):
            _scatter(before, s[before].astype(np.int64), head, sa, False)
    tail = starts[1:].copy()
    for c in range(k - 1, -1, -1):
        done = starts[c + 1]
        while done > tail[c]:
            wave = sa[tail[c] : done][::-1]
            done = tail[c]
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _scatter(before, s[before].astype(np.int64), tail, sa, True)
        wave = sa[starts[c] : head[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _scatter(before, s[before].astype(np.int64), tail, sa, True)
    return sa


def _induce_entries(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The same, entry by entry."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    letters, tail = s[lms], starts[1:].copy()
    order = np.argsort(letters, kind="stable")
    upto = np.searchsorted(letters[order], letters[order], "right")
    sa[tail[letters[order]] - upto + np.arange(len(lms))] = lms[order]
    sa[starts[s[n - 1]]] = n - 1
    head = starts[:-1].tolist()
    head[int(s[n - 1])] += 1
    # the letter before each position where the suffix there is induced by this one, else -1 (also for the empty entry, -1)
    before = np.full(n + 1, -1, np.int64)
    before[1:n] = np.where(smaller[:-1], -1, s[:-1])
    letter, out = before.tolist(), sa.tolist()
    for j in out:  # entries are set ahead of where the loop stands
        c = letter[j]
        if c >= 0:
            at = head[c]
            out[at] = j - 1
            head[c] = at + 1
    before[1:n] = np.where(smaller[:-1], s[:-1], -1)
    letter, tail = before.tolist(), starts[1:].tolist()
    out.reverse()  # an entry at ``i`` from the end
    tail = [n - x for x in tail]
    for j in out:
        c = letter[j]
        if c >= 0:
            at = tail[c]
            out[at] = j - 1
            tail[c] = at + 1
    return np.asarray(out[::-1], np.int32)


def _sorted_substrings(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """Ranks of the substrings from each leftmost-smaller position to the next (both included); equal ones have equal ranks.

    Letters are compared with their types (a larger suffix's before a smaller one's), packed several to a word; only
    substrings that are still equal and longer go on to the next word.
    """
    bits = int(2 * alphabet + 2).bit_length()
    per = 63 // bits
    letters = np.concatenate([(s.astype(np.int64) << 1) + smaller + 1, np.zeros(per, np.int64)])
    size = np.diff(np.append(lms, len(s) - 1)) + 1
    rank, live, at = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(live):
        key, here = np.zeros(len(live), np.int64), lms[live] + at
        left = size[live] - at
        for k in range(per):
            key = (key << bits) | np.where(k < left, letters[np.minimum(here + k, len(s))], 0)
        order = np.argsort(key)
        if at:
            order = order[np.argsort(rank[live[order]], kind="stable")]
        key, live = key[order], live[order]
        group = rank[live]
        first = np.ones(len(live), bool)  # of equal rank so far
        first[1:] = group[1:] != group[:-1]
        new = first.copy()
        new[1:] |= key[1:] != key[:-1]
        # a rank is the number of substrings that are smaller
        begin = np.flatnonzero(new)
        within = begin - np.flatnonzero(first)[np.cumsum(first)[begin] - 1]
        count = np.diff(np.append(begin, len(live)))
        rank[live] = group + np.repeat(within, count)
        at += per
        live = live[np.repeat(count > 1, count) & (size[live] > at)]
    return rank


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Starts of the suffixes of ``s`` (integers below ``alphabet``) in ascending order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.int32)
    smaller = _types(s)
    starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=alphabet))])
    induce = _induce_buckets if alphabet <= _SMALL_ALPHABET else _induce_entries
    is_lms = smaller.copy()
    is_lms[1:] &= ~smaller[:-1]
    is_lms[0] = False
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        rank = _sorted_substrings(s, smaller, lms, alphabet)
        order = np.argsort(rank)
        new = np.ones(len(lms), bool)
        new[1:] = rank[order[1:]] != rank[order[:-1]]
        if new.all():
            lms = lms[order]
        else:
            names = np.empty(len(lms), np.int32)
            names[order] = np.cumsum(new) - 1
            lms = lms[suffix_array(names, int(new.sum()))]
    return induce(s, smaller, lms, starts)


def permuted_lcp(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the length of the common prefix with the suffix before it in ``sa``.

    Only irreducible positions (whose left neighbours differ) are compared, eight letters at a time; every other value is
    its left neighbour's less one.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=np.int32)
    left_same = np.zeros(n, bool)
    left_same[1:] = (before[1:] > 0) & (data[:-1] == data[before[1:] - 1])
    irreducible = np.flatnonzero(~left_same)
    value = np.zeros(len(irreducible), np.int32)
    live = np.flatnonzero(before[irreducible] >= 0)
    block = sliding_window_view(np.concatenate([data, np.zeros(8, data.dtype)]), 8)
    while len(live):
        i, j = irreducible[live] + value[live], before[irreducible[live]] + value[live]
        inside = (i < n) & (j < n)
        live, i, j = live[inside], i[inside], j[inside]
        same = (block[i] == block[j]).cumprod(axis=1).sum(axis=1)
        same = np.minimum(same, n - np.maximum(i, j))
        value[live] += same
        live = live[same == 8]
    last = np.zeros(n, np.int32)
    last[irreducible] = np.arange(len(irreducible))
    last = np.maximum.accumulate(last)
    return np.maximum(value[last] - (at - irreducible.astype(np.int32)[last]), 0)
