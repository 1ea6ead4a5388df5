"""Byte-level BPE encoding of text columns inside Python tasks.

The byte-level pattern never lets a pre-token run across a space or a line feed that stands between
two non-space characters: such a space opens a pre-token, such a line feed is one. So a text whose
white space is of this kind is encoded word by word: the words of a step are hashed, looked up in a
bounded cache of ids, and only new words go through the tokenizer, together in one call, divided by
line feeds. Any other text is encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken

from arrears.llm.common import text_views
from arrears.llm.words import prefix_hashes, span_hashes, spans

CACHE_WORDS = 1_500_000
_AFTER_FEED = np.uint64(0x5851F42D4C957F2D)  # sets words without a leading space apart
_encoders: dict[str, "WordEncoder"] = {}


def _odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with white space other than single spaces and line feeds between other characters."""
    space = (data == 32) | (data == 10)
    odd = ((data < 32) & (data != 10) & ((data >= 28) | (data >= 9) & (data <= 13)))
    odd[1:] |= space[1:] & space[:-1]
    full = offsets[:-1] < offsets[1:]
    ends = np.r_[offsets[:-1][full], offsets[1:][full] - 1]
    odd[ends] |= space[ends]
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    if len(lead):  # white space outside ASCII
        a = data[lead]
        b, c = (data[np.minimum(lead + k, len(data) - 1)] for k in (1, 2))
        wide = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
                | (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
                                 | (b == 0x81) & (c == 0x9F)) | (a == 0xE3) & (b == 0x80) & (c == 0x80))
        odd[lead[wide]] = True
    at = np.flatnonzero(odd)
    rows = np.zeros(len(offsets) - 1, bool)
    rows[np.searchsorted(offsets, at, "right") - 1] = True
    return rows


class WordEncoder:
    def __init__(self, ranks_file: str):
        import public_tokenizers

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                                     mergeable_ranks=ranks, special_tokens={})
        self.feed = ranks[b"\n"]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys, starts, ends, after_space, raw: bytes) -> None:
        joined = "".join([("\n " if s else "\n") + raw[a:b].decode()
                          for a, b, s in zip(starts.tolist(), ends.tolist(), after_space.tolist())])
        ids = np.array(self.bpe.encode_ordinary(joined), np.uint32)
        begin = np.flatnonzero(ids == self.feed) + 1
        count = np.diff(np.append(begin, len(ids) + 1)) - 1
        spot = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, spot, begin + len(self.pool))
        self.count = np.insert(self.count, spot, count)
        self.keys = np.insert(self.keys, spot, keys)
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and each row's offset in them (one more at the end)."""
        rows = len(offsets) - 1
        odd = _odd_rows(data, offsets)
        raw = data.tobytes()
        whole = {int(r): np.array(self.bpe.encode_ordinary(raw[offsets[r]:offsets[r + 1]].decode()), np.uint32)
                 for r in np.flatnonzero(odd)}
        starts, ends = spans((data == 32) | (data == 10), offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        if whole:
            plain = ~odd[row]
            starts, ends, row = starts[plain], ends[plain], row[plain]
        opens = starts == offsets[row]
        before = np.where(opens, 0, data[starts - 1])
        keys = span_hashes(prefix_hashes(data), starts, ends)
        keys[before != 32] ^= _AFTER_FEED
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self._forget()
        spot = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == distinct[inside]
        if not known.all():
            new = first[~known]
            self._learn(distinct[~known], starts[new], ends[new], before[new] == 32, raw)
            spot = np.searchsorted(self.keys, distinct)
        at, count = self.at[spot][inverse], self.count[spot][inverse]
        feed = (before == 10).astype(np.int64)
        total = np.bincount(row, count + feed, rows).astype(np.int64)
        for r, ids in whole.items():
            total[r] = len(ids)
        out_offsets = np.r_[0, np.cumsum(total)]
        out = np.empty(out_offsets[-1], np.uint32)
        # where each word's ids go: its place among the plain rows' ids, moved by the odd rows before it
        end = np.cumsum(count + feed)
        skipped = np.r_[0, np.cumsum(np.where(odd, total, 0))]
        begin = end - count + skipped[row]
        out[begin[feed > 0] - 1] = self.feed
        n = int(count.sum())
        inner = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(begin, count) + inner] = self.pool[np.repeat(at, count) + inner]
        for r, ids in whole.items():
            out[out_offsets[r]:out_offsets[r + 1]] = ids
        return out, out_offsets


def encoder(ranks_file: str) -> WordEncoder:
    """The task's encoder for this file (kept while the Python worker lives)."""
    if ranks_file not in _encoders:
        _encoders[ranks_file] = WordEncoder(ranks_file)
    return _encoders[ranks_file]


def encoded(column: pa.Array, ranks_file: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids of a string column in steps: (first row, ids, offsets). Null is the empty text."""
    enc = encoder(ranks_file)
    for first, data, offsets in text_views(column):
        ids, at = enc.encode(data, offsets)
        yield first, ids, at
