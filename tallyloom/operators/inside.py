"""Sums over the points inside boxes, and what fields find among the tokens inside theirs; used in tasks that hold a part of a page."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np

from ..functions.numbers import OCR_FACTORS

#: Pairs of a field and a number or word looked at in one go, and patterns of a field that are looked for.
AT_ONCE, PATTERNS = 1 << 20, 60
SAME, SCALED = 1, 2

Pairs = Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]


def sums_inside(keys: np.ndarray, xs: np.ndarray, ys: np.ndarray, weights: np.ndarray, asked: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Sums (k, q) of weights (k, m) over the points of each asked key inside its box (top, left, bottom, right by q), edges included.

    Points in the order of key and x are parted by the bits of their rank in y, level by level (a wavelet matrix), so a box
    takes as many steps as the number of points has bits.
    """
    top, left, bottom, right = box
    m, across, down = len(xs), np.sort(xs), np.sort(ys)
    place = keys * (m + 1) + np.searchsorted(across, xs)
    order = np.argsort(place, kind="stable")
    place, rank, weights = place[order], np.searchsorted(down, ys)[order], weights[:, order]
    lo = np.searchsorted(place, asked * (m + 1) + np.searchsorted(across, left))
    hi = np.maximum(lo, np.searchsorted(place, asked * (m + 1) + np.searchsorted(across, right, "right")))
    below = np.concatenate([np.searchsorted(down, bottom, "right"), np.searchsorted(down, top)])
    lo, hi = np.tile(lo, 2), np.tile(hi, 2)
    total = np.zeros((len(weights), len(below)), np.int64)
    for bit in range(m.bit_length() - 1, -1, -1):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        order = np.argsort(one, kind="stable")
        rank, weights = rank[order], weights[:, order]
        sums = np.pad(np.cumsum(weights, 1), ((0, 0), (1, 0)))
        up, lo0, hi0 = (below >> bit & 1).astype(bool), zeros[lo], zeros[hi]
        total += np.where(up, sums[:, hi0] - sums[:, lo0], 0)
        lo, hi = np.where(up, zeros[-1] + lo - lo0, lo0), np.where(up, zeros[-1] + hi - hi0, hi0)
    # a box without an edge, or turned over, holds nothing
    return np.where((left <= right) & (top <= bottom), total[:, : len(top)] - total[:, len(top) :], 0)


def _spread(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every (i, k) with lo[i] <= k < hi[i], some AT_ONCE of them at a time."""
    size, at = hi - lo, 0
    ends = np.cumsum(size)
    while at < len(lo):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + AT_ONCE, "right")))
        n = size[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        yield i, np.repeat(lo[at:stop] - np.cumsum(n) + n, n) + np.arange(len(i))
        at = stop


def alike(target: np.ndarray, numbers: np.ndarray) -> Pairs:
    """(field, number, bit): which of the sorted numbers are a field's target (SAME), or are off by a scale or the sign (SCALED).

    The conditions are those of ``ocr_outcome`` and ``scale_or_sign``; ranges a little wider than they are say where to look.
    """
    near = lambda a, b, t: np.abs(a - b) <= np.maximum(np.abs(b), 1e-9) * t
    factors = [(g, t) for f, t in OCR_FACTORS for g in (f, 1 / f)]
    endless = np.full(len(target), np.inf)
    with np.errstate(all="ignore"):
        ranges = [(target - 0.5, target + 0.5), (-target / 0.98, -target / 1.02), *((target / (f * (1 - t)), target / (f * (1 + t))) for f, t in factors), (endless, endless), (-endless, -endless)]
        for a, b in ranges:
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            lo = np.searchsorted(numbers, lo - np.where(np.isinf(lo), 0, 1e-9 * (1 + np.abs(lo))))
            hi = np.searchsorted(numbers, hi + np.where(np.isinf(hi), 0, 1e-9 * (1 + np.abs(hi))), "right")
            for i, k in _spread(lo, np.where(np.isnan(target), lo, np.maximum(lo, hi))):
                v, x = target[i], numbers[k]
                same, scaled = np.abs(x - v) < 0.5, near(v, -x, 0.02)
                for f, t in factors:
                    scaled |= near(v / x, f, t)
                keep = same | (scaled & (x != 0))
                yield i[keep], k[keep], np.where(same, SAME, SCALED)[keep]


def patterns(words: list[str]) -> list[str]:
    """What the words of a page must hold, as lines, for a text to stand there: a word anywhere, more of them at the ends and between."""
    return words if len(words) < 2 else [words[0] + "\n", *(f"\n{w}\n" for w in words[1:-1]), "\n" + words[-1]][:PATTERNS]


def holding(wanted: list[list[str]], words: list[str]) -> Pairs:
    """(field, word, bit): which words hold pattern number i of a field's wanted ones, as bit i."""
    text, starts = "\n" + "\n".join(words) + "\n", np.cumsum([1, *(len(w) + 1 for w in words)]).tolist()
    users = defaultdict(list)
    for field, ws in enumerate(wanted):
        for i, pattern in enumerate(patterns(ws)):
            users[pattern].append((field, 1 << i))
    for pattern, by in users.items():
        found, skip = [], pattern.startswith("\n")
        at = text.find(pattern) if words else -1
        while at >= 0:
            found.append(bisect_right(starts, at + skip) - 1)
            at = text.find(pattern, starts[found[-1] + 1] - 1)
        step = max(1, AT_ONCE // max(1, len(found)))
        for i in range(0, len(by) if found else 0, step):
            part = np.array(by[i : i + step])
            yield np.repeat(part[:, 0], len(found)), np.tile(found, len(part)), np.repeat(part[:, 1], len(found))


def _gathered(pairs: Pairs) -> Pairs:
    held, n = [], 0
    for p in pairs:
        held.append(p)
        n += len(p[0])
        if n >= AT_ONCE:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def mark(hits: np.ndarray, pairs: Pairs, keys: np.ndarray, xs: np.ndarray, ys: np.ndarray, box: np.ndarray) -> None:
    """Sets the bits of pairs whose key has a point inside the field's box. Keys, xs and ys are of the points."""
    ones = np.ones((1, len(xs)), np.int64)
    for field, key, bit in _gathered(pairs):
        found = sums_inside(keys, xs, ys, ones, key, box[:, field])[0] > 0
        np.bitwise_or.at(hits, field[found], bit[found])
