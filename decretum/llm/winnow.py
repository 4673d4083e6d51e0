"""Content-chosen segments of texts: all windows that share their smallest gram digest."""

from __future__ import annotations

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Window starts that are looked at together, and at most in one segment.
BLOCK, LONGEST = 1 << 19, 1 << 10

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2**64, kept per process."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def gram_digests(codes: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial digest of each ``gram`` bytes; equal bytes, equal digests."""
    up, down = _power_table(len(codes))
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    digests = (total[gram:] - total[:-gram]) * down[: len(codes) - gram + 1]
    digests *= _MIX
    digests ^= digests >> np.uint64(29)
    digests *= BASE
    digests ^= digests >> np.uint64(32)
    return digests


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(raw: bytes, window: int, gram: int) -> list[tuple[int, int, int, int, bool]]:
    """``digest, first start, last start, content digest, repeats`` of the segments of a text.

    Every window start is in exactly one segment. Windows of equal content have the
    same smallest gram digest, wherever they stand, so they are in segments of the
    same ``digest``. ``repeats`` says that the text has that gram more than once.
    """
    starts, out = len(raw) - window + 1, []
    for at in range(0, max(starts, 0), BLOCK):
        part = raw[at : at + BLOCK + window - 1]
        digests = gram_digests(np.frombuffer(part, np.uint8), gram)
        least = sliding_min(digests, window - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        ends = np.append(first[1:], len(least))
        values = least[first]
        marks = np.zeros(1 << 16, bool)
        marks[values & np.uint64(0xFFFF)] = True
        found = digests[marks[digests & np.uint64(0xFFFF)]]
        known, counts = np.unique(found, return_counts=True)
        repeats = counts[np.searchsorted(known, values)] > 1
        if len(raw) > BLOCK:
            repeats[:] = True
        for v, a, b, twice in zip(values.view(np.int64).tolist(), first.tolist(), ends.tolist(), repeats.tolist(), strict=True):
            for s in range(a, b, LONGEST):
                e = min(b, s + LONGEST)
                out.append((v, at + s, at + e - 1, xxhash.xxh3_64_intdigest(part[s : e - 1 + window]) - (1 << 63), twice))
    return out
