"""Blockwise suffix sorting with a difference cover.

A difference cover of ``PERIOD`` is a set of residues such that any two
positions have a shift below ``PERIOD`` that brings both into the set.  The
suffixes at cover positions are ranked first.  Then the wanted suffixes are
sorted one bucket at a time: by their first ``PERIOD`` bytes, and where those
are equal by the ranks of the cover samples at the pair's shift, so a tie of
any length takes one comparison.  Memory is that of the ranks and one bucket.
"""

from __future__ import annotations

from functools import cache, cmp_to_key

import numpy as np

PERIOD, BUCKET = 32, 1 << 16


@cache
def difference_cover(period: int = PERIOD) -> tuple[int, ...]:
    """A small difference cover: residues are added while they bring the most new differences."""
    cover, seen = [0], {0}
    while len(seen) < period:
        fresh = lambda r: len({(r - c) % period for c in cover} | {(c - r) % period for c in cover} | seen)
        best = max((r for r in range(period) if r not in cover), key=lambda r: (fresh(r), -r))
        seen |= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return tuple(sorted(cover))


@cache
def shifts(period: int = PERIOD) -> np.ndarray:
    """For two residues, the smallest shift that brings both into the cover."""
    inside = np.zeros(period, bool)
    inside[list(difference_cover(period))] = True
    out = np.zeros((period, period), np.int64)
    for a in range(period):
        for b in range(period):
            out[a, b] = next(s for s in range(period) if inside[(a + s) % period] and inside[(b + s) % period])
    return out


def words_of(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks of equal keys along an order are equal."""
    new = np.zeros(len(order), np.int64)
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(text: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions by at least ``depth`` bytes; -1 elsewhere.  Ends of text count as zeros."""
    n = len(text)
    inside = np.zeros(PERIOD, bool)
    inside[list(difference_cover())] = True
    at = np.flatnonzero(inside[np.arange(n) % PERIOD])
    take = lambda p: np.where(p < n, words[np.minimum(p, n - 1)], np.uint64(0)) if n else words
    first = [take(at + 8 * k) for k in range(PERIOD // 8)]
    ranks = np.full(n + 1, -1, np.int64)
    ranks[at] = _dense(np.lexsort(first[::-1]), *first) if len(at) else 0
    known = PERIOD  # a shift by a multiple of the period stays in the cover
    while known < depth:
        own = ranks[at]
        later = ranks[np.minimum(at + known, n)] + 1
        key = own * (len(at) + 2) + later
        ranks[at] = _dense(np.argsort(key, kind="stable"), key)
        known *= 2
    return ranks


def suffix_order(text: np.ndarray, positions: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """``positions`` in the order of the suffixes there, compared by at least ``depth`` bytes."""
    if not len(positions):
        return positions
    n = len(text)
    words = words_of(text) if words is None else words
    ranks = cover_ranks(text, words, depth)
    shift = shifts()
    take = lambda p: np.where(p < n, words[np.minimum(p, n - 1)], np.uint64(0))
    heads = words[positions]
    splitters = np.sort(heads)[BUCKET :: BUCKET] if len(heads) > BUCKET else heads[:0]
    bucket_of = np.searchsorted(splitters, heads, side="right")
    by_bucket = np.argsort(bucket_of, kind="stable")
    ends = np.cumsum(np.bincount(bucket_of, minlength=len(splitters) + 1))
    out = []
    for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        p = positions[by_bucket[a:b]]
        if not len(p):
            continue
        keys = [take(p + 8 * k) for k in range(PERIOD // 8)]
        # those of one residue share a shift, so one key orders them; ties of several residues are compared in pairs below
        residue = p % PERIOD
        own = ranks[np.minimum(p + shift[residue, residue], n)]
        order = np.lexsort([own, residue, *keys[::-1]])
        p = p[order]
        tied = np.ones(len(p), bool)
        tied[0] = False
        for key in keys:
            ordered = key[order]
            tied[1:] &= ordered[1:] == ordered[:-1]
        group = np.cumsum(~tied)
        mixed = np.unique(group[1:][tied[1:] & (p[1:] % PERIOD != p[:-1] % PERIOD)])
        for g in mixed.tolist():
            lo, hi = np.searchsorted(group, [g, g + 1])
            member = p[lo:hi]

            def compare(x: int, y: int) -> int:
                s = int(shift[x % PERIOD, y % PERIOD])
                rx, ry = ranks[min(x + s, n)], ranks[min(y + s, n)]
                return int(rx > ry) - int(rx < ry)

            p[lo:hi] = sorted(member.tolist(), key=cmp_to_key(compare))
        out.append(p)
    return np.concatenate(out)


def equal_neighbours(text_len: int, words: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each suffix in order, whether it agrees with the one before it in ``width`` bytes, by direct comparison."""
    same = np.zeros(len(order), bool)
    at = np.arange(1, len(order))
    at = at[(order[at] + width <= text_len) & (order[at - 1] + width <= text_len)]
    for k in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        if not len(at):
            break
        at = at[words[order[at] + k] == words[order[at - 1] + k]]
    same[at] = True
    return same
