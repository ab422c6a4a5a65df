"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are S (smaller than the next) or L. The leftmost S ones (LMS) are sorted first: one induction sorts their
substrings, equal substrings share a name, and the string of names, at most half as long, is sorted in the same way. A
second induction then orders all suffixes. An induction takes each bucket once from left to right for L and once from
right to left for S: whole buckets at a time where values are few (entries that a bucket induces into itself follow in
waves), entry by entry where, as among names, a bucket holds little.
"""

from __future__ import annotations

import numpy as np

from palisade.llm.common import Rolling, mix

# With more values than this a bucket is not worth an array operation of its own.
FEW_VALUES = 1 << 10
_SALT = np.uint64(0xA0761D6478BD642F)


def classify(s: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last value of s must be its unique smallest."""
    step = np.sign(np.diff(s.astype(np.int32)))
    place = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(place[::-1])[::-1]
    return np.append(np.append(step, 1)[following] > 0, True)


def _deal(where: list[list[np.ndarray]], s: np.ndarray, entries: np.ndarray) -> None:
    """Append entries, in order, to the lists of their values."""
    if not len(entries):
        return
    value = s[entries]
    order = np.argsort(value, kind="stable")
    value, entries = value[order], entries[order]
    cut = np.flatnonzero(value[1:] != value[:-1]) + 1
    for v, part in zip(value[np.append(0, cut)].tolist(), np.split(entries, cut)):
        where[v].append(part)


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, values: int) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in the order given."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(values)]
    large: list[list[np.ndarray]] = [[] for _ in range(values)]
    small: list[list[np.ndarray]] = [[] for _ in range(values)]
    _deal(seeds, s, lms)
    for v in range(values):
        done: list[np.ndarray] = []
        while large[v]:
            wave = np.concatenate(large[v])
            large[v] = []
            done.append(wave)
            before = wave[wave > 0] - 1
            _deal(large, s, before[~smaller[before]])
        for wave in seeds[v]:
            before = wave[wave > 0] - 1
            _deal(large, s, before[~smaller[before]])
        large[v] = [np.concatenate(done)] if done else []
    small[0].append(np.array([len(s) - 1]))
    for v in reversed(range(values)):
        done = []
        while small[v]:
            wave = np.concatenate(small[v])
            small[v] = []
            done.append(wave)
            before = wave[wave > 0] - 1
            _deal(small, s, before[smaller[before]])
        for wave in large[v]:
            wave = wave[::-1]
            before = wave[wave > 0] - 1
            _deal(small, s, before[smaller[before]])
        small[v] = [np.concatenate(done)[::-1]] if done else []
    return np.concatenate([part for v in range(values) for part in (*large[v], *small[v])])


def induce_each(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, values: int) -> np.ndarray:
    """The same as induce, entry by entry."""
    stop = np.cumsum(np.bincount(s, minlength=values))
    text, is_small, order = s.tolist(), smaller.tolist(), [-1] * len(s)
    tail = stop.tolist()
    for p in reversed(lms.tolist()):
        tail[text[p]] -= 1
        order[tail[text[p]]] = p
    head = [0, *stop[:-1].tolist()]
    for p in order:  # grows ahead of the reader
        if p > 0 and not is_small[p - 1]:
            v = text[p - 1]
            order[head[v]] = p - 1
            head[v] += 1
    tail = stop.tolist()
    for p in reversed(order):
        if p > 0 and is_small[p - 1]:
            v = text[p - 1]
            tail[v] -= 1
            order[tail[v]] = p - 1
    return np.array(order)


def suffix_array(s: np.ndarray, values: int) -> np.ndarray:
    """Suffixes of s (whose last value is 0 and its only 0) in order."""
    smaller = classify(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induction = induce if values <= FEW_VALUES else induce_each
    order = induction(s, smaller, lms, values)
    number = np.full(len(s), -1, np.int64)
    number[lms] = np.arange(len(lms))
    ranked = number[order]
    ranked = ranked[ranked >= 0]
    rolling = Rolling(mix(s.astype(np.uint64) + _SALT))
    stop = np.append(lms[1:] + 1, len(s))
    part = rolling.of(lms, stop) + (stop - lms).astype(np.uint64) * _SALT
    name = np.empty(len(lms), np.int64)
    name[ranked] = np.append(1, np.cumsum(part[ranked][1:] != part[ranked][:-1]) + 1)
    if name.max(initial=0) < len(lms):
        ranked = suffix_array(name - 1, int(name.max()))
    return induction(s, smaller, lms[ranked], values)


def permuted_prefixes(s: np.ndarray, order: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position its predecessor in suffix order (-1: none), and their common prefix, in text order.

    A position whose left neighbour and its predecessor's are alike has one less than the position before it. Only the
    others, and those in fresh, are compared: by hashes of halving lengths, up to the power of two above most.
    """
    before = np.full(len(s), -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(len(s))
    own = before < 1
    own[0] = True
    rest = np.flatnonzero(~own)
    own[rest] = s[rest - 1] != s[before[rest] - 1]
    own[fresh] = True
    own &= before >= 0
    p = np.flatnonzero(own)
    q = before[p]
    common = np.zeros(len(p), np.int64)
    rolling = Rolling(mix(s.astype(np.uint64) + _SALT))
    step = 1 << most.bit_length()
    while step:
        a, b = p + common, q + common
        fits = np.flatnonzero(np.maximum(a, b) + step <= len(s))
        same = rolling.of(a[fits], a[fits] + step) == rolling.of(b[fits], b[fits] + step)
        common[fits[same]] += step
        step >>= 1
    value = np.zeros(len(s), np.int64)
    value[p] = common
    last = np.maximum.accumulate(np.where(own | (before < 0), at, 0))
    return before, np.maximum(0, value[last] - (at - last))
