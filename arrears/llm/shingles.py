"""Word shingles of UTF-8 texts as sets of 64-bit hashes (inside Python tasks)."""

from __future__ import annotations

import numpy as np

from arrears.llm.common import mix64
from arrears.llm.words import prefix_hashes, span_hashes, spans

_PLACE = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                   0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], np.uint64)


def by_row(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Order by (row, value)."""
    order = np.argsort(values)
    rows = row[order]
    return order[np.argsort(rows.astype(np.uint16) if len(row) and row[-1] < 1 << 16 else rows, kind="stable")]


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row: (hashes, one offset per row and the end), ascending in a row.

    Words are runs without ASCII white space, A-Z lower case; a shingle is ``k`` words in a row, a
    text of fewer words is one shingle, a text without words has none.
    """
    lower = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    starts, ends = spans((data == 32) | (data >= 9) & (data <= 13), offsets)
    rows = len(offsets) - 1
    row = np.searchsorted(offsets, starts, "right") - 1
    words = span_hashes(prefix_hashes(lower), starts, ends)
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    n = max(0, len(words) - k + 1)
    hashes = np.full(n, k, np.uint64)
    for t in range(k):
        hashes += words[t:n + t] * _PLACE[t]
    whole = row[:n] == row[k - 1:] if n else np.zeros(0, bool)
    hashes, owner = mix64(hashes[whole]), row[:n][whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        lone = count[short].astype(np.uint64)
        for t in range(k - 1):
            has = count[short] > t
            lone[has] += words[first[short[has]] + t] * _PLACE[t]
        hashes, owner = np.concatenate([hashes, mix64(lone)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    order = by_row(owner, hashes)
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))]


def set_keys(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of every row's set (0 for the empty set); equal sets have equal keys."""
    out = []
    for salt in (0x51ED270B9F3C5D4B, 0x7FB5D329728EA185):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix64(hashes ^ np.uint64(salt)), out=total[1:])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]
