"""Words of UTF-8 text as numpy spans and 64-bit hashes (inside Python tasks)."""

from __future__ import annotations

import numpy as np

from arrears.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64 (kept while the Python worker lives, up to 16 MB)."""
    known = _powers[base]
    if len(known) < n:
        known = np.full(n, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 1 << 21:
            _powers[base] = known
    return known[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of (data[j] + 1) * base**j for j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(_BASE, len(data))
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each span; equal spans have equal hashes wherever they stand."""
    raw = (prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def spans(separator: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs without a separator that do not cross a document border: starts, ends."""
    edge = np.zeros(len(separator) + 1, bool)
    inside = ~separator
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    edge[-1] = edge[0] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    word = inside[starts] if len(starts) else np.zeros(0, bool)
    return starts[word], ends[word]
