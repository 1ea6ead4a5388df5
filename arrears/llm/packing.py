"""Best-fit packing of documents into token sequences, improved by swap-based local search.

Documents are cut only where they exceed a sequence; full pieces are sequences of their own, the
others are packed best fit, longest first. Local search then takes the emptiest bins apart: it
moves a document, exchanges one for one, or two for one, always from the emptier to the fuller of
two underfull bins, so that the sum of squared fills grows with every step, until the bin is empty
or nothing helps.

Scale: encoding is a map over documents. Pieces are written once and dealt into shards of bounded
size by row, whatever their document, so a common id or length cannot fill a shard; each shard is
packed by one task and wastes less than one sequence against packing all shards together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.bpe import encoded
from arrears.llm.common import stash

SHARD_PIECES = 32_768


def pieces(docs: DataFrame, ranks_file: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of every row of ``docs(doc_id, text)``: its ids and ``end_id``, cut where too long.

    Returns doc_id, piece, start, length, ids_crc32. Only the first piece of a document can be
    shorter than the capacity. Null text counts as empty (one piece of one token).
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, at in encoded(batch.column(1), ranks_file):
                out = [[], [], [], []]
                rows = []
                ids = np.insert(ids, at[1:], end_id).astype("<u4").view(np.uint8)
                for r in range(len(at) - 1):
                    begin, total = int(at[r]) + r, int(at[r + 1] - at[r]) + 1
                    start, length = 0, total % capacity or capacity
                    while start < total:
                        spot = (begin + start) * 4
                        for column, value in zip(out, (len(out[0]), start, length,
                                                       zlib.crc32(ids[spot:spot + 4 * length]))):
                            column.append(value)
                        rows.append(first + r)
                        start, length = start + length, capacity
                starts = np.array(out[1])
                number = np.arange(len(rows))
                number -= np.maximum.accumulate(np.where(starts == 0, number, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(out[1], pa.int64()),
                     pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers, longest item first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where some bin has r tokens of room
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            spot = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[spot].append(item)
        else:
            room, spot = capacity, len(bins)
            bins.append([item])
        room -= size
        by_room[room].append(spot)
        if room:
            rooms |= 1 << room
    return bins


def fewest_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound: for each size a, documents above capacity - a stand alone, those above half of
    the capacity cannot share a bin, and the rest from size a on must fit into what these leave."""
    count = np.bincount(lengths, minlength=capacity + 1)
    upto, tokens = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half = capacity // 2
    a = np.arange(half + 1)
    alone = upto[capacity] - upto[capacity - a]
    paired = upto[capacity - a] - upto[half]
    room = paired * capacity - (tokens[capacity - a] - tokens[half])
    small = tokens[half] - np.where(a > 0, tokens[a - 1], 0)
    return int((alone + paired + np.maximum(0, -((room - small) // capacity))).max())


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, patience: int = 64) -> list[list[int]]:
    """Empty bins by exchanges between underfull bins.

    Stops at the lower bound, or when ``patience`` bins in a row could not be emptied.
    """
    least = fewest_bins(lengths, capacity)
    failed = 0
    fills = np.array([int(lengths[b].sum()) for b in bins])
    full = [b for b, f in zip(bins, fills) if f == capacity]
    open_bins = [b for b, f in zip(bins, fills) if f < capacity]
    order = np.argsort(-fills[fills < capacity], kind="stable")
    open_bins = [open_bins[i] for i in order]
    stuck: list[list[int]] = []
    while len(open_bins) > 1 and failed < patience and len(full) + len(stuck) + len(open_bins) > least:
        source = open_bins.pop()  # the emptiest
        where = np.repeat(np.arange(len(open_bins)), [len(b) for b in open_bins])
        items = np.concatenate([np.array(b) for b in open_bins])
        sizes = lengths[items]
        room = capacity - np.bincount(where, sizes, len(open_bins)).astype(np.int64)
        spare = room.copy()
        while source:
            own = lengths[source]
            best = (0, None, None, None)
            for k in np.argsort(-own):  # a move: the longest document some bin can take
                takes = np.flatnonzero(room >= own[k])
                if len(takes):
                    best = (int(own[k]), [int(k)], None, int(takes[np.argmin(room[takes])]))
                    break
            singles = [(int(own[k]), [int(k)]) for k in range(len(own))]
            pairs = [(int(own[a] + own[b]), [a, b]) for a in range(len(own)) for b in range(a + 1, len(own))]
            if best[1] is None:  # an exchange, one or two for one: what makes the other bin fullest
                for size, out in singles + pairs:
                    gain = size - sizes
                    gain[(gain <= 0) | (gain > room[where])] = 0
                    k = int(gain.argmax()) if len(gain) else 0
                    if len(gain) and gain[k] > best[0]:
                        best = (int(gain[k]), out, k, int(where[k]))
            gain, out, back, target = best
            if out is None:
                break
            moved = [source[k] for k in out]
            source = [x for k, x in enumerate(source) if k not in out]
            if back is not None:
                source.append(int(items[back]))
                items[back], sizes[back] = moved[0], lengths[moved[0]]
                moved = moved[1:]
            if moved:
                items = np.concatenate([items, moved])
                sizes = np.concatenate([sizes, lengths[moved]])
                where = np.concatenate([where, [target] * len(moved)])
            room[target] -= gain
        if not np.array_equal(room, spare):
            by_bin = np.argsort(where, kind="stable")
            open_bins = [x.tolist() for x in np.split(items[by_bin], np.cumsum(np.bincount(where, minlength=len(room)))[:-1])]
            order = np.argsort(room, kind="stable")
            full += [open_bins[i] for i in order if room[i] == 0]
            open_bins = [open_bins[i] for i in order if room[i] > 0]
        failed = failed + 1 if source else 0
        if source:
            stuck.append(source)
    return full + open_bins + stuck


def pack(docs: DataFrame, ranks_file: str, capacity: int = 1024, end_id: int = 2,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Packed pieces of ``docs``: the columns of :func:`pieces`, sequence_id and offset.

    Every row is packed, repeated rows and ids included. Empty table: no rows.
    """
    cut = stash(pieces(docs, ranks_file, capacity, end_id)).withColumn("row", F.monotonically_increasing_id())
    whole = cut.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("row") * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    short = cut.where(F.col("length") < capacity)
    shards = max(1, -(-short.count() // shard_pieces))

    def pack_shard(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")  # the same order whenever the task runs again
        lengths = group["length"].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        items = np.concatenate([np.array(b) for b in bins])
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        before = np.cumsum(lengths[items]) - lengths[items]
        begin = before[np.r_[0, np.flatnonzero(np.diff(number)) + 1]]
        sequence, offset = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
        sequence[items] = ((group["shard"][0].as_py() << 32) + number) * 2 + 1
        offset[items] = before - begin[number]
        return group.drop_columns(["row", "shard"]).append_column("sequence_id", pa.array(sequence)) \
            .append_column("offset", pa.array(offset))

    packed = short.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard") \
        .applyInArrow(pack_shard, whole.schema)
    return whole.unionByName(packed)
