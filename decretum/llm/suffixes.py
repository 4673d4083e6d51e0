"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced a bucket at a time in numpy, larger ones (names of substrings) element by element.
SMALL_ALPHABET = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last one, the sentinel, counts as smaller."""
    step = np.sign(np.diff(s))
    n = len(step)
    place = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    smaller = np.ones(len(s), bool)
    smaller[:-1] = np.append(step, 1)[nearest] > 0
    return smaller


def _scatter(sa: np.ndarray, ends: np.ndarray, chars: np.ndarray, values: np.ndarray, way: int) -> None:
    """Put ``values`` into the buckets of ``chars`` in order: upwards from ``ends`` (way 1), or downwards (way -1)."""
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    first = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    counts = np.diff(np.append(first, len(chars)))
    rank = np.arange(len(chars)) - np.repeat(first, counts)
    sa[ends[chars] + way * rank] = values[order]
    ends[chars[first]] += way * counts


def _induce_buckets(s: np.ndarray, smaller: np.ndarray, bounds: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Induce all suffixes from the sorted leftmost-smaller ones, a bucket at a time."""
    short = s.astype(np.uint16)
    sa = np.full(len(s), -1, np.int64)
    tails = bounds[1:] - 1
    _scatter(sa, tails, short[lms[::-1]], lms[::-1], -1)
    heads, used = bounds[:-1].copy(), np.flatnonzero(np.diff(bounds))

    def before(found: np.ndarray, kind: bool) -> tuple[np.ndarray, np.ndarray]:
        p = found[found > 0] - 1
        p = p[smaller[p] == kind]
        return p, short[p]

    for c in used.tolist():
        at = bounds[c]
        while at < heads[c]:
            to = int(heads[c])
            p, chars = before(sa[at:to], False)
            if len(p):
                _scatter(sa, heads, chars, p, 1)
            at = to
        p, chars = before(sa[tails[c] + 1 : bounds[c + 1]], False)
        if len(p):
            _scatter(sa, heads, chars, p, 1)
    ends = bounds[1:] - 1
    for c in used[::-1].tolist():
        at = int(bounds[c + 1]) - 1
        while at > ends[c]:
            to = int(ends[c])
            p, chars = before(sa[to + 1 : at + 1][::-1], True)
            if len(p):
                _scatter(sa, ends, chars, p, -1)
            at = to
        p, chars = before(sa[bounds[c] : heads[c]][::-1], True)
        if len(p):
            _scatter(sa, ends, chars, p, -1)
    sa[0] = len(s) - 1
    return sa


def _induce_elements(s: np.ndarray, smaller: np.ndarray, bounds: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same for large alphabets."""
    text, low, sa = s.tolist(), smaller.tolist(), [-1] * len(s)
    ends = bounds[1:].tolist()
    for j in lms[::-1].tolist():
        ends[text[j]] -= 1
        sa[ends[text[j]]] = j
    heads = bounds[:-1].tolist()
    for i in range(len(sa)):
        p = sa[i] - 1
        if p >= 0 and not low[p]:
            c = text[p]
            sa[heads[c]] = p
            heads[c] += 1
    ends = bounds[1:].tolist()
    for i in range(len(sa) - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and low[p]:
            c = text[p]
            ends[c] -= 1
            sa[ends[c]] = p
    sa[0] = len(text) - 1
    return np.array(sa, np.int64)


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the leftmost-smaller substrings, by their sorted ``order``; equal substrings get equal numbers."""
    place = np.empty(len(s), np.int64)
    place[lms] = np.arange(len(lms))
    rank = place[order]
    length = np.append(np.diff(lms) + 1, 1)[rank]
    new = np.ones(len(order), bool)
    same = np.flatnonzero(length[1:] == length[:-1]) + 1
    if len(same):
        sizes = length[same]
        offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        equal = s[np.repeat(order[same], sizes) + offset] == s[np.repeat(order[same - 1], sizes) + offset]
        new[same] = ~np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
    names = np.empty(len(lms), np.int64)
    names[rank] = np.cumsum(new) - 1
    return names


def _suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """``s`` ends with its only 0."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size))])
    induce = _induce_buckets if size <= SMALL_ALPHABET else _induce_elements
    if len(lms) > 1:
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        found = induce(s, smaller, bounds, lms)
        names = _names(s, lms, found[is_lms[found]])
        count = int(names.max()) + 1
        if count < len(names):
            lms = lms[_suffix_array(names, count)]
        else:
            ordered = np.empty(len(lms), np.int64)
            ordered[names] = lms
            lms = ordered
    return induce(s, smaller, bounds, lms)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``codes`` (whole numbers from 0) in their order.

    Suffixes are classified as smaller or larger than their successors; the substrings between
    leftmost smaller ones are sorted by induction and named; where names repeat, the
    string of names is sorted in the same way; all suffixes are then induced in linear time.
    """
    s = np.append(codes.astype(np.int64) + 1, 0)
    return _suffix_array(s, int(s.max()) + 1)[1:]


def permuted_common_prefixes(codes: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix, in text order, shares with its predecessor in ``sa``.

    A value is one less than its left neighbour's where the characters before both
    suffixes are equal; only the other ones are compared, all at once, character by character.
    """
    n = len(codes)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (phi[1:] > 0) & (codes[:-1] == codes[np.maximum(phi[1:] - 1, 0)])
    own = np.flatnonzero(~follows & (phi >= 0))
    lengths, other = np.zeros(n, np.int64), phi[own]
    while len(own):
        left, right = own + lengths[own], other + lengths[own]
        equal = (left < n) & (right < n) & (codes[np.minimum(left, n - 1)] == codes[np.minimum(right, n - 1)])
        own, other = own[equal], other[equal]
        lengths[own] += 1
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(follows, 0, at))
    return np.maximum(lengths[start] - (at - start), 0)
