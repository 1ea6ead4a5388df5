"""Suffix-array de-duplication: remove bytes of repeated passages, first occurrence kept.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
id. Strings are judged in shards: each shard builds its suffix array by induced sorting, computes
permuted common prefixes, and finds the runs of neighbouring suffixes that share LENGTH bytes; of
each run the smallest document keeps its bytes.

Which bytes meet in a shard (exact): of the GRAM-byte strings inside a string of LENGTH bytes, the
one with the smallest hash (leftmost on a tie) is its anchor. Equal strings have equal anchors at
equal places, so strings are dealt to shards by their anchor. A document's consecutive strings with
the same anchor form a region, and only regions whose anchor stands in two or more different texts
are sent. Equal texts are folded first, equal regions wherever they meet; each is then represented
by its smallest document, as all others are removed wholly.

Scale: texts meet in groups by their hash, so equal ones are folded there and texts of two groups
differ: a group sends each of its anchors once, in order, about 3 bytes (one for each LENGTH / 3 bytes
or so), and learns which of them another group has too. Tasks exchange packed and compressed blobs:
these anchors, the texts once, the regions with shared anchors, and the spans to remove. A shard of a
large corpus stands for more text, so that blobs, one for each group and shard, stay few; it is judged
in pieces of bounded size. A text that a third of all rows share is folded to one entry per batch
before any shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import mix64, release_memory, releasing, stash, text_views
from arrears.llm.suffix_array import permuted_common_prefixes, suffix_array
from arrears.llm.words import _INVERSE, powers, prefix_hashes

LENGTH, GRAM = 50, 24
PLACE_BITS = 26  # of an anchor's place in what is scanned at once
FLUSH_BYTES = 8 << 20
GROUP_BYTES = 6 << 20
SHARD_BYTES, MOST_SHARD_BYTES = 6 << 20, 16 << 20  # of text that stands behind a shard's regions, in a GB and at most
PIECE_BYTES = 3 << 20  # of regions that are sorted at once
TOKEN_BUCKET = 2_500_000
STEP_BYTES = 1 << 16  # of texts whose anchors are found at once: arrays that fit into a core's cache
NO_ID = np.iinfo(np.int64).max


# a stretch of a text: its smallest document, the text's group and place there, the first byte, the bytes, the anchor
_REGION = np.dtype([("doc", "<i8"), ("group", "<u4"), ("ord", "<u4"), ("start", "<i8"), ("length", "u1"), ("anchor", "<u4")])
_SENT = ("anchor", "doc", "ord", "start", "length")  # with one group's regions for a shard
_SPAN = ("ord", "start", "length")  # with a shard's spans for one group


def _packed_by(key: np.ndarray, regions: np.ndarray, fields: tuple[str, ...], data: np.ndarray | None = None) -> Iterator[tuple]:
    """For each value of ``key`` (ascending): the value, how many regions, and their fields and bytes in one blob.

    Column by column, which packs better than row by row; ``data`` are the bytes of all regions in order.
    """
    if not len(key):
        return
    compressor = zstandard.ZstdCompressor(level=3)
    columns = [(np.ascontiguousarray(regions[f]).tobytes(), _REGION[f].itemsize) for f in fields]
    cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    if data is not None:
        bytes_at, raw = np.r_[0, np.cumsum(regions["length"], dtype=np.int64)][cuts].tolist(), data.tobytes()
    heads, cuts = key[cuts[:-1]].tolist(), cuts.tolist()
    for i, value in enumerate(heads):
        a, b = cuts[i], cuts[i + 1]
        parts = [column[a * size:b * size] for column, size in columns]
        if data is not None:
            parts.append(raw[bytes_at[i]:bytes_at[i + 1]])
        yield value, b - a, compressor.compress(b"".join(parts))


def _unpack_all(counts: list[int], blobs: list[bytes], fields: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Regions of all blobs one after the other, and their bytes."""
    unpacker = zstandard.ZstdDecompressor()
    parts: list[list[bytes]] = [[] for _ in range(len(fields) + 1)]
    sizes = [_REGION[f].itemsize for f in fields]
    for n, blob in zip(counts, blobs):
        raw, at = unpacker.decompress(blob), 0
        for part, size in zip(parts, sizes):
            part.append(raw[at:at + n * size])
            at += n * size
        parts[-1].append(raw[at:])
    out = np.zeros(sum(counts), _REGION)
    for f, part in zip(fields, parts):
        out[f] = np.frombuffer(b"".join(part), _REGION[f])
        part.clear()
    return out, np.frombuffer(b"".join(parts[-1]), np.uint8)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Regions of the rows: (anchor hash, row, first string, last string), places in ``data``."""
    limit = (1 << PLACE_BITS) - LENGTH
    if len(data) > limit:  # a very long text: its strings in stretches
        parts = []
        for begin in range(0, len(data), limit // 2):
            end = min(len(data), begin + limit // 2 + LENGTH - 1)
            hashes, row, low, high = anchors(data[begin:end], np.clip(offsets - begin, 0, end - begin))
            parts.append((hashes, row, low + begin, high + begin))
        return tuple(np.concatenate(x) for x in zip(*parts))
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    prefix = prefix_hashes(data)
    n = len(data) - GRAM + 1
    grams = prefix[GRAM:] - prefix[:-GRAM]
    grams *= powers(_INVERSE, len(prefix))[:n]
    hashes = mix64(grams)
    low_bits = np.uint64((1 << PLACE_BITS) - 1)
    least = hashes & ~low_bits
    least |= np.arange(n, dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    strings = len(data) - LENGTH + 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:strings], least[width - size:width - size + strings])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:strings]
    whole = np.flatnonzero(np.arange(strings) + LENGTH <= offsets[row + 1])
    if not len(whole):
        return none.astype(np.uint64), none, none, none
    place, row = (least[whole] & low_bits).astype(np.int64), row[whole]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[new[1:], len(whole)] - 1
    return hashes[place[new]], row[new], whole[new], whole[last]


def _text_key(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [hashlib.md5(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def pack_texts(docs: DataFrame, groups: int) -> DataFrame:
    """Texts of ``docs(doc_id, text)`` by group: packed rows (key = group, a, b, c) with the texts' keys,
    smallest ids with lengths, and the bytes. A group is chosen by the text's hash."""
    names, kinds = ["key", "a", "b", "c"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def packed(texts: dict[bytes, list]) -> pa.RecordBatch:
        keys = list(texts)
        short = np.frombuffer(b"".join(k[:8] for k in keys), "<u8").astype(np.uint64)
        group = (short % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(group[order])) + 1, len(order)].tolist()
        compressor = zstandard.ZstdCompressor(level=3)
        out = [[] for _ in names]
        for a, b in zip(cuts[:-1], cuts[1:]):
            mine = order[a:b].tolist()
            found = [texts[keys[i]] for i in mine]
            for column, value in zip(out, (int(group[mine[0]]), b"".join(keys[i] for i in mine),
                                           np.array([[x[0] for x in found], [len(x[1]) for x in found]], "<i8").tobytes(),
                                           compressor.compress(b"".join(x[1] for x in found)))):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for first, data, offsets in text_views(batch.column(1)):
                raw, at = data.tobytes(), offsets.tolist()
                for r, key in enumerate(_text_key(data, offsets)):
                    known = texts.get(key)
                    if known is not None:
                        known[0] = min(known[0], int(ids[first + r]))
                    else:
                        texts[key] = [int(ids[first + r]), raw[at[r]:at[r + 1]]]
                        held += at[r + 1] - at[r]
                if held > FLUSH_BYTES:
                    out = packed(texts)
                    texts, held = {}, 0
                    release_memory()
                    yield out
        if texts:
            out = packed(texts)
            texts = {}
            release_memory()
            yield out

    return docs.mapInArrow(pack_rows, "key int, a binary, b binary, c binary")


def _texts(rows: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct texts of a group: (keys, smallest ids, bytes of all, offsets), in order of keys."""
    found: dict[bytes, list] = {}
    unpacker = zstandard.ZstdDecompressor()
    for a, b, c in zip(*(rows[x].to_pylist() for x in ("a", "b", "c"))):
        ids, lengths = np.frombuffer(b, "<i8").reshape(2, -1)
        raw, at = unpacker.decompress(c), 0
        for i, (doc, length) in enumerate(zip(ids.tolist(), lengths.tolist())):
            key = a[16 * i:16 * i + 16]
            known = found.get(key)
            if known is None:
                found[key] = [doc, raw[at:at + length]]
            else:
                known[0] = min(known[0], doc)
            at += length
    keys = sorted(found)
    data = np.frombuffer(b"".join(found[k][1] for k in keys), np.uint8)
    return keys, np.array([found[k][0] for k in keys], np.int64), data, \
        np.r_[0, np.cumsum([len(found[k][1]) for k in keys])].astype(np.int64)


def _anchors_of(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`anchors` of a group's texts, without those that no document with an id has."""
    found, last = [], 0
    while last < len(ids):
        first = last
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP_BYTES, "right")) - 1)
        base = offsets[first]
        hashes, row, low, high = anchors(data[base:offsets[last]], offsets[first:last + 1] - base)
        use = ids[row + first] != NO_ID
        found.append((hashes[use], row[use] + first, low[use] + base, high[use] + base))
    return tuple(np.concatenate(x) for x in zip(*found))


def _token(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's bucket (upper half) and 32 bits of its hash; a collision only sends a region too many."""
    return ((hashes % np.uint64(buckets)) << np.uint64(32)) | (hashes >> np.uint64(32))


def _bucket_rows(tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket and tokens, of ascending :func:`_token` numbers."""
    bucket = tokens >> np.uint64(32)
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(tokens)].tolist() if len(tokens) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[a]), tokens[a:b].astype("<u4")


def shared_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """Anchors that stand in two or more groups of texts: packed rows (key = group, bucket, a = tokens)."""
    def group_tokens(rows: pa.Table) -> pa.Table:
        _, ids, data, offsets = _texts(rows)
        hashes, _, _, _ = _anchors_of(ids, data, offsets)
        compressor = zstandard.ZstdCompressor(level=1)
        out = [[], []]
        for bucket, tokens in _bucket_rows(np.unique(_token(hashes, buckets))):
            out[0].append(bucket)
            # steps from one to the next, byte plane by byte plane
            out[1].append(compressor.compress(np.diff(tokens, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()))
        return pa.table({"key": pa.array(np.full(len(out[0]), rows["key"][0].as_py()), pa.int32()),
                         "bucket": pa.array(out[0], pa.int32()), "a": pa.array(out[1], pa.binary())})

    def bucket_shared(rows: pa.Table) -> pa.Table:
        unpacker = zstandard.ZstdDecompressor()
        tokens = []
        for blob in rows["a"].to_pylist():
            steps = np.ascontiguousarray(np.frombuffer(unpacker.decompress(blob), np.uint8).reshape(4, -1).T)
            tokens.append(np.cumsum(steps.view("<u4").ravel(), dtype=np.uint32))
        every = np.sort(np.concatenate(tokens))
        several = np.unique(every[1:][every[1:] == every[:-1]])
        found = []
        for mine in tokens:
            spot = np.minimum(np.searchsorted(several, mine), max(len(several) - 1, 0))
            found.append(mine[several[spot] == mine].tobytes() if len(several) else b"")
        table = pa.table({"key": rows["key"], "bucket": rows["bucket"], "a": pa.array(found, pa.binary())})
        return table.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))

    tokens = texts.groupBy("key").applyInArrow(releasing(group_tokens), "key int, bucket int, a binary")
    return tokens.groupBy("bucket").applyInArrow(releasing(bucket_shared), "key int, bucket int, a binary")


def _in_several(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which anchors stand in two or more rows."""
    order = np.argsort(hashes, kind="stable")  # rows ascend
    heads = np.flatnonzero(np.r_[True, hashes[order[1:]] != hashes[order[:-1]]]) if len(order) else order
    run = np.diff(np.r_[heads, len(order)])
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(row[order[heads + run - 1]] != row[order[heads]], run)
    return out


def _fold(regions: np.ndarray, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal regions (bytes ``data[begin:begin + length]``) under their smallest document.

    Returns the numbers of the regions kept, and of those that a smaller document covers wholly.
    """
    prefix = prefix_hashes(data)
    length = regions["length"].astype(np.int64)
    key = mix64((prefix[begin + length] - prefix[begin]) * powers(_INVERSE, len(prefix))[begin]) ^ length.astype(np.uint64)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if len(order) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    run = np.diff(np.r_[heads, len(order)])
    several = np.flatnonzero(np.repeat(run > 1, run))  # only these have an order among themselves
    order[several] = order[several][np.lexsort((regions["start"][order[several]], regions["doc"][order[several]],
                                                sorted_key[several]))]
    head = order[np.repeat(heads, run)]
    # equal for certain: compare with the head, eight bytes at a time
    copies = ~new & (length[order] == length[head])
    check = np.flatnonzero(copies)
    eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    for step in range(0, int(length.max(initial=0)), 8):
        rest = length[order[check]] - step
        check, rest = check[rest > 0], rest[rest > 0]
        if not len(check):
            break
        a, b = (np.ascontiguousarray(eight[begin[x[check]] + step]).view("<u8").ravel() for x in (order, head))
        unused = (8 * (8 - np.minimum(rest, 8))).astype(np.uint64)  # bits past the region's end
        same = (a ^ b) << unused == 0
        copies[check[~same]] = False
        check = check[same]
    covered = copies & (regions["doc"][order] > regions["doc"][head])
    return order[~covered], order[covered]


def _bytes_of(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    return data[np.arange(length.sum()) + np.repeat(begin - np.cumsum(length) + length, length)]


def _contested(doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Places of the regions whose anchor also stands in a region of another document."""
    order = np.lexsort((doc, anchor))
    heads = np.flatnonzero(np.r_[True, anchor[order[1:]] != anchor[order[:-1]]]) if len(order) else order
    run = np.diff(np.r_[heads, len(order)])
    several = doc[order[heads + run - 1]] != doc[order[heads]]
    return np.sort(order[np.repeat(several, run)])


def spans_of_shard(regions: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Spans to remove (as regions), from regions and their bytes one after the other.

    An anchor with regions of one document only has nothing to be compared with.
    """
    length = regions["length"].astype(np.int64)
    begin = np.cumsum(length) - length
    kept, covered = _fold(regions, data, begin)
    spans = [regions[covered]]
    kept = kept[_contested(regions["doc"][kept], regions["anchor"][kept])]
    if len(kept):
        part, sizes = regions[kept], length[kept]
        # symbols: bytes + 2; 1 ends a region, 0 ends the shard
        at = np.cumsum(sizes + 1) - sizes - 1
        symbols = np.ones(int(sizes.sum()) + len(kept) + 1, np.uint16)
        source = np.arange(sizes.sum()) + np.repeat(begin[kept] - np.cumsum(sizes) + sizes, sizes)
        target = np.arange(sizes.sum()) + np.repeat(at - np.cumsum(sizes) + sizes, sizes)
        symbols[target] = data[source].astype(np.uint16) + 2
        symbols[-1] = 0
        sa = suffix_array(symbols, LENGTH)
        plain = np.zeros(len(symbols), np.uint8)
        plain[target] = data[source]
        region = np.repeat(np.arange(len(kept)), sizes + 1)
        roomy = np.append(np.repeat(at + sizes, sizes + 1) - np.arange(len(symbols) - 1) >= LENGTH, False)
        common = permuted_common_prefixes(plain, sa, LENGTH, roomy)
        sa = sa[sa < len(symbols) - 1]
        whole = roomy[sa]
        # a run: neighbours in order that share LENGTH bytes inside their regions
        joins = np.r_[False, (common[sa[1:]] >= LENGTH) & whole[1:] & whole[:-1]]
        run = np.cumsum(~joins)
        places, run = sa[whole], run[whole]
        if len(places):
            docs = part["doc"][region[places]]
            heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            least = np.repeat(np.minimum.reduceat(docs, heads), np.diff(np.r_[heads, len(run)]))
            gone = places[docs > least]
            edge = np.bincount(gone, minlength=len(symbols) + 1) - np.bincount(gone + LENGTH, minlength=len(symbols) + 1)
            cover = np.r_[0, (np.cumsum(edge) > 0).astype(np.int8), 0]
            starts, ends = np.flatnonzero(np.diff(cover) > 0), np.flatnonzero(np.diff(cover) < 0)
            which = region[starts]
            found = np.zeros(len(starts), _REGION)
            for f in ("doc", "group", "ord"):
                found[f] = part[f][which]
            found["start"], found["length"] = part["start"][which] + starts - at[which], ends - starts
            spans.append(found)
    return np.concatenate(spans)


def spans_by_pieces(regions: np.ndarray, data: np.ndarray) -> np.ndarray:
    """:func:`spans_of_shard` of pieces of about PIECE_BYTES: an anchor's regions are in one piece."""
    length = regions["length"].astype(np.int64)
    pieces = min(256, -(-len(data) // PIECE_BYTES))
    if pieces < 2:
        return spans_of_shard(regions, data)
    begin = np.cumsum(length) - length
    piece = (regions["anchor"] >> 24) * np.uint32(pieces) >> 8
    found = []
    for i in range(pieces):
        mine = np.flatnonzero(piece == i)
        found.append(spans_of_shard(regions[mine], _bytes_of(data, begin[mine], length[mine])))
    return np.concatenate(found)


def shard_count(total: int, parallel: int) -> int:
    """Shards for ``total`` bytes: more text behind each as the corpus grows, as each gets a blob from every group."""
    return max(parallel, -(-total // min(MOST_SHARD_BYTES, int(SHARD_BYTES * max(1, total / 1e9) ** 0.5))))


def repeated_spans(docs: DataFrame, with_text: bool) -> DataFrame:
    """What to remove from each distinct text of ``docs(doc_id, text)``.

    Returns text_key (md5), first_id (smallest id of the text), n_bytes, n_removed, n_spans,
    kept_sha256 and (``with_text``) the kept text, for the document ``first_id``; any other document
    of the text goes wholly. Where a removal cuts a character in two, its rest goes from the text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    groups = max(parallel, -(-total // GROUP_BYTES))
    shards = shard_count(total, parallel)
    buckets = max(parallel, -(-total // 16 // TOKEN_BUCKET))
    texts = pack_texts(docs, groups)
    shared = shared_anchors(texts, buckets)
    region_kinds = {"shard": pa.int32(), "group": pa.int32(), "n": pa.int32(), "whole": pa.bool_(), "regions": pa.binary()}

    def regions_of(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in region_kinds]
        if left.num_rows:
            group = left["key"][0].as_py()
            _, ids, data, offsets = _texts(left)
            hashes, row, low, high = _anchors_of(ids, data, offsets)
            wanted = np.zeros(0, np.uint64)
            if right.num_rows:
                wanted = np.sort(np.concatenate([np.frombuffer(x, "<u4") | np.uint64(b << 32) for b, x in zip(
                    right["bucket"].to_pylist(), right["a"].to_pylist())]))
            token = _token(hashes, buckets)
            spot = np.minimum(np.searchsorted(wanted, token), max(len(wanted) - 1, 0))
            use = np.flatnonzero((wanted[spot] == token if len(wanted) else False) | _in_several(hashes, row))
            mixed = mix64(hashes[use])
            shard, anchor = (mixed % np.uint64(shards)).astype(np.int32), (mixed >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((anchor, shard))
            use, shard, anchor = use[order], shard[order], anchor[order]
            regions = np.empty(len(use), _REGION)
            regions["doc"], regions["group"], regions["ord"], regions["anchor"] = ids[row[use]], group, row[use], anchor
            regions["start"], regions["length"] = low[use] - offsets[row[use]], high[use] - low[use] + LENGTH
            # equal regions of the group: the smallest document's goes on, the others are spans already
            kept, covered = _fold(regions, data, low[use])
            kept.sort()
            part, begin = regions[kept], low[use][kept]
            sent = _bytes_of(data, begin, part["length"].astype(np.int64))
            for which, n, blob in _packed_by(shard[kept], part, _SENT, sent):
                for column, value in zip(out, (which, group, n, False, blob)):
                    column.append(value)
            for _, n, blob in _packed_by(np.zeros(len(covered), np.int32), regions[covered], _SPAN):
                for column, value in zip(out, (group % shards, group, n, True, blob)):
                    column.append(value)
        return pa.table([pa.array(c, k) for c, k in zip(out, region_kinds.values())], list(region_kinds))

    regions = texts.groupBy("key").cogroup(shared.groupBy("key")).applyInArrow(
        releasing(regions_of, 2), "shard int, group int, n int, whole boolean, regions binary")

    def shard_spans(rows: pa.Table) -> pa.Table:
        whole = rows["whole"].to_numpy()
        done, open_ = rows.filter(pa.array(whole)), rows.filter(pa.array(~whole))
        out = [done["group"].to_pylist(), done["n"].to_pylist(), done["regions"].to_pylist()]
        counts = open_["n"].to_pylist()
        regions, data = _unpack_all(counts, open_["regions"].to_pylist(), _SENT)
        regions["group"] = np.repeat(open_["group"].to_numpy(), counts)
        spans = spans_by_pieces(regions, data)
        spans = spans[np.argsort(spans["group"], kind="stable")]
        for group, n, blob in _packed_by(spans["group"], spans, _SPAN):
            for column, value in zip(out, (group, n, blob)):
                column.append(value)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.binary()))], ["key", "n", "spans"])

    spans = regions.groupBy("shard").applyInArrow(releasing(shard_spans), "key int, n int, spans binary")
    schema = "text_key binary, first_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(7)]
        if left.num_rows:
            keys, ids, data, offsets = _texts(left)
            gone = np.zeros(len(data), bool)
            if right.num_rows:
                found, _ = _unpack_all(right["n"].to_pylist(), right["spans"].to_pylist(), _SPAN)
                begin = offsets[found["ord"]] + found["start"]
                edge = np.bincount(begin, minlength=len(data) + 1) - np.bincount(begin + found["length"], minlength=len(data) + 1)
                gone = np.cumsum(edge)[:-1] > 0
            raw = data.tobytes()
            for i, key in enumerate(keys):
                a, b = offsets[i], offsets[i + 1]
                lost = gone[a:b]
                n = int(np.count_nonzero(lost))
                kept = raw[a:b] if not n else data[a:b][~lost].tobytes()
                n_spans = int(np.count_nonzero(lost[1:] & ~lost[:-1])) + int(lost[0]) if n else 0
                for column, value in zip(out, (key, int(ids[i]), int(b - a), n, n_spans,
                                               hashlib.sha256(kept).hexdigest(),
                                               kept.decode(errors="ignore") if with_text else None)):
                    column.append(value)
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)],
                        ["text_key", "first_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.groupBy("key").cogroup(spans.groupBy("key")).applyInArrow(releasing(cut, 2), schema)


def deduplicate(docs: DataFrame, carry: list[str], with_text: bool = True) -> DataFrame:
    """The ``carry`` columns of ``docs``, with n_bytes, n_removed, n_spans, kept_sha256, and kept.

    ``kept`` is the remaining text (null unless ``with_text``). Null texts count as empty, texts
    shorter than LENGTH bytes lose nothing. A null doc_id has no place in the order: nothing is
    removed from its row, and it removes nothing. Rows that share an id do not remove from each
    other. Empty table: no rows.
    """
    cut = stash(repeated_spans(docs, with_text))
    text = F.coalesce("text", F.lit(""))
    own_text = F.when(F.col("doc_id").isNull(), text)  # rows without an id keep theirs
    keyed = docs.select(*carry, F.col("doc_id").cast("long").alias("_id"), F.unhex(F.md5(text.cast("binary"))).alias("_key"),
                        F.sha2(own_text.cast("binary"), 256).alias("_own_sha256"),
                        (own_text if with_text else F.lit(None).cast("string")).alias("_own_text"))
    out = keyed.join(cut, F.col("_key") == F.col("text_key"))
    own = F.col("_id").isNull()
    later = F.coalesce(F.col("_id") > F.col("first_id"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(*carry, "n_bytes",
                      F.when(own, 0).when(later, F.col("n_bytes")).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
                      F.when(own, 0).when(later, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
                      F.when(own, F.col("_own_sha256")).when(later, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
                      F.when(own, F.col("_own_text")).when(later & F.lit(with_text), F.lit(""))
                      .otherwise(F.col("kept")).alias("kept"))
