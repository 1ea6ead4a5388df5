"""Suffix arrays by induced sorting, in numpy (inside Python tasks).

Suffixes are classified as larger (L) or smaller (S) than their successor; the substrings between
leftmost-smaller (LMS) places are sorted by one round of induction and named, the LMS suffixes are
sorted by their names, and a second round of induction places all others. Induction goes bucket by
bucket, and inside a bucket in waves of suffixes that can be placed together, so a pass takes a
linear number of steps in a few array operations per bucket.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; ``s`` ends with its smallest symbol."""
    small = np.empty(len(s), bool)
    np.less(s[:-1], s[1:], out=small[:-1])
    small[-1] = True
    equal = np.flatnonzero(s[:-1] == s[1:])
    if len(equal):  # as at the next place where the symbol changes
        change = np.flatnonzero(s[:-1] != s[1:])
        small[equal] = small[change[np.searchsorted(change, equal)]]
    return small


def _deal(sa: np.ndarray, at: np.ndarray, places: np.ndarray, symbols: np.ndarray, step: int) -> np.ndarray:
    """Put places into their symbols' buckets in order, from ``at`` on in the direction ``step``."""
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    count = np.bincount(symbols, minlength=len(at))
    nth = np.arange(len(order)) - (np.cumsum(count) - count)[sorted_symbols]
    sa[at[sorted_symbols] + step * nth] = places[order]
    at += step * count
    return count


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the LMS suffixes (given in order) induce."""
    sa = np.full(len(s), -1, np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    symbols_of_lms = s[lms]
    lms_cut = np.searchsorted(symbols_of_lms, np.arange(len(size) + 1))
    head = starts.copy()
    used = np.flatnonzero(size)
    for c in used:  # L suffixes, smallest bucket first
        done = starts[c]
        while True:
            wave = sa[done:head[c]]
            done = head[c]
            if not len(wave):
                break
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            if len(before):
                _deal(sa, head, before, s[before], 1)
        before = lms[lms_cut[c]:lms_cut[c + 1]]
        before = before[before > 0] - 1
        before = before[~small[before]]
        if len(before):
            _deal(sa, head, before, s[before], 1)
    tail = ends - 1
    tail[s[-1]] -= 1  # the last suffix stands alone in its bucket
    sa[starts[s[-1]]] = len(s) - 1
    for c in used[::-1]:  # S suffixes, largest bucket first
        done = ends[c] - 1
        while True:
            wave = sa[tail[c] + 1:done + 1][::-1]
            done = tail[c]
            if not len(wave) or c == s[-1]:
                break
            before = wave[wave > 0] - 1
            before = before[small[before]]
            if len(before):
                _deal(sa, tail, before, s[before], -1)
        large = sa[starts[c]:head[c]][::-1]
        before = large[large > 0] - 1
        before = before[small[before]]
        if len(before):
            _deal(sa, tail, before, s[before], -1)
    return sa


def _rank_by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names``, exact for the first ``depth`` names (0: for all).

    A suffix's rank is the first place of its group of suffixes that are equal so far; a round sorts only
    the members of groups of two or more, by the rank that stands ``reach`` names later.
    """
    n, reach = len(names), 1
    order = np.argsort(names)
    rank, key, places = np.empty(n, np.int64), names[order].astype(np.int64), np.arange(n)
    items = order
    while True:
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        run = np.diff(np.r_[head, len(key)])
        rank[items] = np.repeat(places[head], run)
        open_ = np.repeat(run > 1, run)
        items, places = items[open_], places[open_]
        if not len(items) or reach >= n or depth and reach >= depth:
            return order
        later = np.zeros(len(items), np.int64)
        inside = items + reach < n
        later[inside] = rank[items[inside] + reach] + 1
        key = rank[items] * (n + 2) + later
        turn = np.argsort(key)  # ties in any order: later rounds tell them apart, or nothing has to
        items, key = items[turn], key[turn]
        order[places] = items
        reach *= 2


def suffix_array(symbols: np.ndarray, depth: int = 0) -> np.ndarray:
    """Places of all suffixes in order. The last symbol must be the only one of its (smallest) kind.

    With ``depth`` the order is exact for the first ``depth`` symbols of suffixes only.
    """
    n = len(symbols)
    if n == 1:
        return np.zeros(1, np.int64)
    s = symbols.astype(np.uint16)
    small = _types(s)
    size = np.bincount(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    # one round of induction from the LMS places, in any order inside a bucket, sorts their substrings
    first = lms[np.argsort(s[lms], kind="stable")]
    order = _induce(s, small, first, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = order[is_lms[order]]
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    length = np.diff(np.append(lms, n - 1)) + 1
    length[-1] = 1
    # neighbours in order get the same name if their substrings are equal, symbol by symbol
    a, b = ordered[:-1], ordered[1:]
    len_a, len_b = length[number[a]], length[number[b]]
    same = len_a == len_b
    left, step = np.flatnonzero(same), 0
    while len(left):
        left = left[step < len_a[left]]
        differ = s[a[left] + step] != s[b[left] + step]
        same[left[differ]] = False
        left = left[~differ]
        step += 1
    names = np.empty(len(lms), np.int64)
    names[number[ordered]] = np.r_[0, np.cumsum(~same)]
    if len(lms) > 1 and names.max() < len(lms) - 1:
        # LMS places are two or more symbols apart
        ordered = lms[_rank_by_doubling(names, -(-depth // 2) + 1 if depth else 0)]
    return _induce(s, small, ordered, size)


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """For every place, the bytes (at most ``depth``) its suffix shares with the one before it in order.

    Computed in the text's order, eight bytes at a time; bytes past the end count as zero. With ``wanted``
    only where both places are wanted, elsewhere zero.
    """
    n = len(data)
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    padded = np.r_[data, np.zeros(depth + 8, np.uint8)]
    eight = np.zeros(n + depth, np.uint64)
    for k in range(8):
        eight |= padded[k:n + depth + k].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, np.int64)
    left = np.flatnonzero(before >= 0)
    if wanted is not None:
        left = left[wanted[left] & wanted[before[left]]]
    for step in range(0, depth, 8):
        differ = eight[left + step] ^ eight[before[left] + step]
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs
        shared = np.where(differ == 0, 8, (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64))
        out[left] += np.minimum(shared, depth - step)
        left = left[shared == 8]
    return out
