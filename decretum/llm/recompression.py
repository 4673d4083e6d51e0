"""Locally consistent names of token runs and pairs, and what they say about windows of tokens."""

from __future__ import annotations

from math import ceil, log

import numpy as np

from decretum.llm.winnow import gram_digests

_A, _B, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Rounds between two that name runs; every round names pairs.
RUN_EVERY = 4
#: Window starts before a symbol that share a key: windows of one key have all but so many tokens in common.
NEAR = 8


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit names whose bits look random."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _salt(t: int) -> np.uint64:
    return np.uint64((int(_STEP) * (t + 1)) % (1 << 64))


class _Windows:
    """All windows of ``width`` tokens that do not cross a text's end, each with the symbols that its content alone decides.

    ``low, high`` bound those symbols in tokens; what stands at a window's ends could be part of a
    run or pair that begins or ends outside, so each step takes it off. When nothing is left, the window
    is marked by the longest of the (first three) symbols it had before: the highest its content decides.
    """

    def __init__(self, ends: np.ndarray, width: int):
        n = len(ends)
        crossed = np.concatenate([[0], np.cumsum(ends)])
        starts = np.arange(max(0, n - width + 1))
        self.starts = starts[crossed[starts + width] == crossed[starts]]
        self.name = np.zeros(len(self.starts), np.uint64)
        self.at = np.zeros(len(self.starts), np.int64)
        self.live, self.low, self.high = np.arange(len(self.starts)), self.starts, self.starts + width

    def step(self, low: np.ndarray, high: np.ndarray, x: np.ndarray, place: np.ndarray, index: np.ndarray) -> None:
        """Go on with ``low, high``; windows without symbols are marked by those they had (``x`` at ``place``)."""
        done = low >= high
        first, last = index[self.low[done]], index[self.high[done] - 1]
        best, size = first, place[first + 1] - place[first]
        for k in (1, 2):
            other = np.minimum(first + k, last)
            length = place[other + 1] - place[other]
            better = (length > size) | ((length == size) & (x[other] < x[best]))
            best, size = np.where(better, other, best), np.where(better, length, size)
        self.name[self.live[done]], self.at[self.live[done]] = x[best], place[best]
        stays = ~done
        self.live, self.low, self.high = self.live[stays], low[stays], high[stays]


def window_symbols(names: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, and the name and place of each one's highest symbol.

    Rounds replace runs of equal symbols, and pairs whose first symbol draws left and whose second
    draws right, by names made of their parts' names. Equal stretches get equal symbols but at their
    ends, so equal windows get the same symbol at the same distance. ``ends`` marks
    tokens that stand for the end of a text; they join nothing.
    """
    n = len(names)
    windows = _Windows(ends, width)
    x, end, place = names, ends, np.arange(n + 1)

    def index_of(place: np.ndarray) -> np.ndarray:
        begins = np.zeros(n, np.int64)
        begins[place[:-1]] = 1
        return np.cumsum(begins) - 1

    with np.errstate(over="ignore"):
        for t in range(ceil(log(max(width, 2)) / log(4 / 3))):
            if t % RUN_EVERY == 0:
                index = index_of(place)
                first = np.concatenate([[True], (x[1:] != x[:-1]) | end[1:] | end[:-1]])[: len(x)]
                at = np.flatnonzero(first)
                count = np.diff(np.append(at, len(x)))
                begins, run = np.append(place[at], n), np.cumsum(first) - 1
                windows.step(begins[run[index[windows.low]] + 1], begins[run[index[windows.high - 1]]], x, place, index)
                x = np.where(count > 1, mixed(x[at] * _STEP + count.astype(np.uint64) + _salt(t)), x[at])
                end, place = end[at], begins
            index = index_of(place)
            right = (mixed(x + _salt(t)) >> np.uint64(63)).astype(bool) & ~end
            left = ~right & ~end
            i, j = index[windows.low], index[windows.high - 1]
            windows.step(np.where(right[i], place[i + 1], windows.low), np.where(left[j], place[j], windows.high), x, place, index)
            joins = np.concatenate([left[:-1] & right[1:], [False]])[: len(x)]
            at = np.flatnonzero(~np.concatenate([[False], joins[:-1]])[: len(x)])
            after = np.minimum(at + 1, len(x) - 1)
            x = np.where(joins[at], mixed(mixed(x[at] + _salt(t)) * np.uint64(3) + x[after]), x[at])
            end, place = end[at], np.append(place[at], n)
        windows.step(windows.high, windows.low, x, place, index_of(place))
    return windows.starts, windows.name, windows.at


def window_keys(names: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keys of all windows; equal windows have equal keys, and neighbours often share one.

    A key is made of the window's highest symbol, the half of the window it stands in, and the tokens
    that all windows of that half have in common.
    """
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, name, at = window_symbols(names, ends, width)
    near = min(NEAR, width)
    half = (at - starts) // near
    core = gram_digests(names, width - near + 1)
    with np.errstate(over="ignore"):
        return starts, mixed(name + np.uint64(3) * core[at - near * half] + half.astype(np.uint64))
