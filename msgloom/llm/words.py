"""Word and shingle hashes of many texts at once.

A word is a longest run of ASCII letters, digits, underscores and bytes of non-ASCII characters; callers lower-case.
Only :func:`word_windows` takes words between white space.
"""

from __future__ import annotations

import numpy as np

from msgloom.llm.pieces import span_hashes

_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * _A
    h ^= h >> np.uint64(29)
    h *= _B
    return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of texts ``data[offsets[i]:offsets[i+1]]``, and how many each text has."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    word = _WORD[data[lo:hi]]
    edge = np.zeros(len(word) + 1, bool)
    edge[offsets - lo] = True
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]])
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets - lo))
    return starts + lo, ends + lo, counts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and how many words each text has."""
    starts, ends, counts = word_spans(data, offsets)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return (span_hashes(data[lo:hi], starts - lo, ends - lo) if len(starts) else np.zeros(0, np.uint64)), counts


def shingles(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words (a shorter text: of all its words), and how many each text has."""
    ends = np.cumsum(counts)
    end = np.repeat(ends, counts)
    at = np.arange(len(words))
    wide = np.concatenate([words, np.zeros(size, np.uint64)])
    h = np.zeros(len(words), np.uint64)
    for j in range(size):
        h = h * _A + np.where(at + j < end, wide[j : j + len(words)], np.uint64(0))
    first = np.repeat(ends - counts, counts) == at
    kept = (at + size <= end) | (first & (end - at < size))
    return mix(h[kept]), np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)


def weighted(items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different items in ascending order, how often each occurs, and how many there are in each text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((items, doc))
    items, doc = items[order], doc[order]
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return items[at], np.diff(np.append(at, len(items))), np.bincount(doc[at], minlength=len(counts))


def _spaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of UTF-8 ``data`` are white space, and which are of characters that scripts write without any between words."""
    space = _SPACE[data]
    alone = np.zeros(len(data), bool)
    wide = np.concatenate([data, np.zeros(2, np.uint8)])
    at = np.flatnonzero(data == 0xC2)
    at = at[np.isin(wide[at + 1], (0x85, 0xA0))]
    space[at] = space[at + 1] = True
    at = np.flatnonzero((data >= 0xE0) & (data <= 0xE9))
    c = (wide[at].astype(np.int32) & 15) << 12 | (wide[at + 1].astype(np.int32) & 63) << 6 | wide[at + 2] & 63
    blank = at[(c >= 0x2000) & (c <= 0x200A) | np.isin(c, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
    # Thai and Lao, Burmese, Khmer, kana and Han
    own = at[(c >= 0xE00) & (c < 0xF00) | (c >= 0x1000) & (c < 0x10A0) | (c >= 0x1780) & (c < 0x1800) | (c >= 0x3040) & (c < 0x3130) | (c >= 0x3400) & (c < 0xA000)]
    for mask, found in ((space, blank), (alone, own)):
        for k in range(3):
            mask[np.minimum(found + k, len(data) - 1)] = True
    return space, alone


def word_windows(data: np.ndarray, sizes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all runs of ``words`` words of UTF-8 texts laid end to end.

    Words stand between white space; a character of a script without spaces is a word by itself. A run takes
    ``2 * words - 1`` bytes at least.
    """
    ends = np.cumsum(sizes)
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[ends] = True
    space, alone = _spaced(data)
    before = np.concatenate([[True], space[:-1]])
    joint = alone | np.concatenate([[False], alone[:-1]])
    first = ~space & (edge[:-1] | before | joint & ((data & 0xC0) != 0x80))
    last = ~space & (edge[1:] | np.concatenate([space[1:], [True]]) | np.concatenate([first[1:], [True]]))
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    a, b = a[: max(0, len(a) - words + 1)], b[words - 1 :]
    own = np.searchsorted(ends, a, "right") == np.searchsorted(ends, b - 1, "right")
    return a[own], b[own]
