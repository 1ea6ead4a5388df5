"""Brute-force versions and odd tables for the corpus operators."""

from __future__ import annotations

import hashlib
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, rank int, kept string"


def odd_documents(spark, extra=()):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing column names."""
    long_text = " ".join(f"word{i % 977} tail{i}" for i in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from the big bear", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog and runs away from the big bear", "en", "a"),
        (2, "The Quick brown fox jumps over the lazy dog and runs away from the big bear", "en", None),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \t\n ", None, "b"),
        (None, "a text without an id that is long enough to be cut into shingles", "en", "b"),
        (None, None, None, None),
        (6, long_text, "en", "b"),
        (7, long_text, "en", "b"),
        (8, "12345 67890 !!! ???", None, "b"),
        (9, "é 日本 語 \U0001f600 x", "xx", "c"),
        (9, "another text under an id that is used twice in this small table", "en", "c"),
        *extra,
    ]
    return spark.createDataFrame([(d, t, g, s, len(t or ""), "0.5", 1, 1, "x") for d, t, g, s in rows], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def components(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < k else [tuple(words[i:i + k]) for i in range(len(words) - k + 1)])


def jaccard_rows(rows, percent=75):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows by comparing all pairs."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    links = [(a, b) for a, s in sets for b, u in sets
             if a is not None and b is not None and s and u and 100 * len(s & u) >= percent * len(s | u)]
    low = components({d for d, _ in sets if d is not None}, links)
    return sorted(((d, len(s), low.get(d)) for d, s in sets), key=str)


def suffix_rows(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of (doc_id, text) rows by a set of all strings."""
    first = defaultdict(lambda: None)
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            if d is not None and (first[raw[i:i + length]] is None or d < first[raw[i:i + length]]):
                first[raw[i:i + length]] = d
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            low = first[raw[i:i + length]]
            if d is not None and low is not None and low < d:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)
