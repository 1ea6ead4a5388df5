"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles; two link when intersection / union reaches the threshold.
Each candidate group is joined by signature trees: leaves are documents, a node holds the OR of its
documents' token bitmaps and the range of their sizes. Two trees are traversed together; a pair of
nodes is dropped when the sizes cannot reach the threshold, or when the largest possible overlap
(common bits, plus the tokens that share bits with others) is below what the smallest sizes need.
Surviving documents are decided by their exact intersection; pairs already connected are passed by,
as they cannot change a component.

How documents come together (exact, no cap): equal sets are folded first. Two sets that link share
c = ceil(t n) shingles, so with shingles in order of their hashes they share the spare s = c // 3 of
them (1 at least) among the first n - c + s of either. Those are dealt to buckets, where it shows
which of them stand in a second set of a size within reach, and in how many sets. A set with fewer
than s of these links with nothing. Of the others the rarest are kept, all but s - 1: under any
common order, two sets with s shared shingles share one that is left. Documents with a common one
and sizes within reach are chained, and the components of the chains are the candidate groups. A
group beyond a block's size (documents or shingles) is dealt into blocks, and every pair of blocks is a cell of its own. In
the cell the same is done once more with the exact frequencies there, which takes groups apart that
only common passages hold together, and the trees are built over what remains together.

Scale: shuffles carry half of the shingles (5 to 7 bytes each), of these the ones that stand in
several sets, and once all texts and those of the documents that have a candidate. A shingle is
counted by itself, in its bucket, whatever the size of the corpus: nothing is broadcast, and a
document whose own shingles are its own meets no other. No task holds more than a bucket, the shared
shingles of a batch, a block pair, or one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import components, local_roots, mix64, release_memory, releasing, stash, text_views
from arrears.llm.shingles import set_keys, shingles

BUCKET_POSTINGS = 1_000_000
BATCH_POSTINGS = 1_000_000  # that a task holds before it packs them for the buckets
BLOCK = 2048  # documents, and
BLOCK_SHINGLES = 4_000_000  # shingles of one block of a group that is dealt into blocks
GROUP_DOCS = 500  # documents, and
GROUP_SHINGLES = 400_000  # shingles that a bucket of smaller groups holds on average
STEP_TOKENS = 1 << 20  # tokens of the documents that one document is compared with at once
FANOUT = 8
SIGNATURE_BITS = 1024
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """One row (doc_id, n, key1, key2, text_hash) per row of ``docs(doc_id, text)``."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_views(batch.column(1)):
                hashes, at = shingles(data, offsets, k)
                key1, key2 = set_keys(hashes, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(key1)), pa.array(np.diff(at)), pa.array(key1), pa.array(key2),
                     batch.column(2).slice(first, len(key1))], ["doc_id", "n", "key1", "key2", "text_hash"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text")).mapInArrow(
        scan, "doc_id long, n long, key1 long, key2 long, text_hash long")


def _prefix(rank: np.ndarray, owner: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Places of each set's prefix tokens: the n - ceil(percent n / 100) + 1 of lowest rank.

    Tokens of a set ascend; stable sorts keep that order where ranks are equal.
    """
    n = np.diff(at)
    order = np.argsort(rank, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    wanted = n - -(-n * percent // 100) + 1
    return order[np.arange(len(rank)) - np.repeat(at[:-1], n) < np.repeat(wanted, n)]


def _chain(token: np.ndarray, owner: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours, by size, of the sets that have a token, where their sizes are within reach."""
    order = np.lexsort((n[owner], token))
    token, owner = token[order], owner[order]
    near = (token[1:] == token[:-1]) & (owner[1:] != owner[:-1]) & (n[owner[:-1]] * 100 >= n[owner[1:]] * percent)
    return owner[:-1][near], owner[1:][near]


def spare(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles two linked sets share among the first :func:`posted` of either (of the smaller set's
    number; neither this nor ``posted``'s rest, n - posted, falls as sets grow)."""
    return np.maximum(1, -(-n * percent // 100) // 3)


def posted(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's shingles, in order of their hashes, are dealt to buckets."""
    return np.where(n > 0, n - -(-n * percent // 100) + spare(n, percent), 0)


def _size_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(8 * np.log2(np.maximum(n, 1)), 255).astype(np.uint8)


def _pack_owners(owner: np.ndarray, mark: np.ndarray) -> bytes:
    """Ascending numbers as steps, byte plane by byte plane, and a byte of each."""
    steps = np.diff(owner, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(steps.T.tobytes() + mark.tobytes())


def _unpack_owners(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(5, n)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), dtype=np.int64), planes[4]


def _bucket_cuts(bucket: np.ndarray) -> zip:
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    return zip(cuts[:-1].tolist(), cuts[1:].tolist()) if len(bucket) else zip()


_POSTED = "batch long, bucket int, sets binary, tokens binary, owners binary"
_SET = [("key", "<i8"), ("n", "<i4")]


def prefix_postings(docs: DataFrame, buckets: int, k: int, percent: int) -> DataFrame:
    """The first :func:`posted` shingles of each set: packed rows (batch, bucket, sets, tokens, owners).

    ``tokens`` are the upper halves of the hashes, in order of ``owners``: the place of the set in its
    batch, and the class of its size. One row of a batch has ``sets`` = (key1, n) of all.
    """
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def packed(held, number: int) -> pa.RecordBatch:
        keys, sizes, tokens, owner = (np.concatenate(x) for x in held)
        _, pick, name = np.unique(keys, return_index=True, return_inverse=True)  # equal sets post once
        keep = pick[name[owner]] == owner
        pick.sort()
        sets = np.empty(len(pick), _SET)
        sets["key"], sets["n"] = keys[pick], np.minimum(sizes[pick], 2**31 - 1)
        tokens, owner = tokens[keep], np.searchsorted(pick, owner[keep])
        # the sets are part of the number: rows of two runs of a task that met others would not be taken together
        place = np.uint64((TaskContext.get().partitionId() << 32) + number)
        batch = (mix64(sets["key"].view(np.uint64) + np.arange(len(sets), dtype=np.uint64)).sum() ^ mix64(np.array([place]))[0])
        batch = int(np.uint64(batch).view(np.int64))
        bucket = (tokens % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        tokens, owner, bucket = (tokens[order] >> np.uint64(32)).astype("<u4"), owner[order], bucket[order]
        mark = _size_class(sets["n"])[owner]
        rows = [[], [], [], [], []]
        for a, b in _bucket_cuts(bucket):
            for column, value in zip(rows, (batch, int(bucket[a]), None if a else sets.tobytes(), tokens[a:b].tobytes(),
                                            _pack_owners(owner[a:b], mark[a:b]))):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds)],
                                          ["batch", "bucket", "sets", "tokens", "owners"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets, posts, number = [[], [], [], []], 0, 0, 0
        for batch in batches:
            for _, data, offsets in text_views(batch.column(0)):
                hashes, at = shingles(data, offsets, k)
                key1, _ = set_keys(hashes, at)
                n = np.diff(at)
                first = np.arange(len(hashes)) - np.repeat(at[:-1], n) < np.repeat(posted(n, percent), n)
                for column, value in zip(held, (key1, n, hashes[first], np.repeat(np.arange(sets, sets + len(n)), n)[first])):
                    column.append(value)
                sets, posts = sets + len(n), posts + len(held[2][-1])
                if posts > BATCH_POSTINGS:
                    out = packed(held, number)
                    held, sets, posts, number = [[], [], [], []], 0, 0, number + 1
                    release_memory()
                    yield out
        if posts:
            out = packed(held, number)
            held.clear()
            release_memory()
            yield out

    return docs.select("text").mapInArrow(scan, _POSTED)


def shared_postings(postings: DataFrame, percent: int) -> DataFrame:
    """Of :func:`prefix_postings` those that a set of a size within reach has too, in the same rows.

    The byte of each in ``owners`` tells in how many sets the shingle stands (eight times the binary logarithm).
    """
    reach = int(8 * np.log2(100 / percent)) + 1  # classes of sizes that may link are not further apart

    def shared(rows: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, "<u4") for x in rows["tokens"].to_pylist()]
        owner, size = zip(*(_unpack_owners(x, len(t)) for x, t in zip(rows["owners"].to_pylist(), tokens)))
        at = np.r_[0, np.cumsum([len(t) for t in tokens])]
        both = (np.concatenate(tokens).astype(np.uint64) << np.uint64(8)) | np.concatenate(size)
        order = np.argsort(both)
        both = both[order].astype(np.int64)
        new = np.r_[True, both[1:] >> 8 != both[:-1] >> 8]
        near = ~new[1:] & (both[1:] - both[:-1] <= reach)
        found = np.zeros(len(both), bool)
        found[order] = np.r_[near, False] | np.r_[False, near]
        run = np.diff(np.r_[np.flatnonzero(new), len(both)])
        level = np.empty(len(both), np.uint8)
        level[order] = np.repeat(np.minimum(8 * np.log2(run), 255).astype(np.uint8), run)
        out = [[], [], []]
        for i, (t, who) in enumerate(zip(tokens, owner)):
            some = found[at[i]:at[i + 1]]
            for column, value in zip(out, (t[some].tobytes(), _pack_owners(who[some], level[at[i]:at[i + 1]][some]), some.any())):
                column.append(value)
        table = pa.table({"batch": rows["batch"], "bucket": rows["bucket"], "sets": rows["sets"],
                          "tokens": pa.array(out[0], pa.binary()), "owners": pa.array(out[1], pa.binary())})
        return table.filter(pa.compute.or_(pa.array(out[2], pa.bool_()), table["sets"].is_valid()))

    return postings.groupBy("bucket").applyInArrow(releasing(shared), _POSTED)


def rare_postings(found: DataFrame, percent: int) -> DataFrame:
    """All but the :func:`spare` - 1 commonest of each set's shared shingles: packed rows (bucket, sets, postings)
    with sets = (key1, n) and postings = (token, set)."""
    def rare(rows: pa.Table) -> pa.Table:
        known = [x for x in rows["sets"].to_pylist() if x is not None]
        if len(known) != 1:
            raise RuntimeError("a task that was run again met its rows in another order")
        sets = np.frombuffer(known[0], _SET)
        tokens = [np.frombuffer(x, "<u4") for x in rows["tokens"].to_pylist()]
        owner, level = (np.concatenate(x) for x in zip(*(
            _unpack_owners(x, len(t)) for x, t in zip(rows["owners"].to_pylist(), tokens))))
        bucket = np.repeat(rows["bucket"].to_numpy(), [len(t) for t in tokens])
        tokens = np.concatenate(tokens)
        count = np.bincount(owner, minlength=len(sets))
        wanted = count - spare(sets["n"].astype(np.int64), percent) + 1
        some = wanted[owner] > 0
        owner, level, bucket, tokens = owner[some], level[some], bucket[some], tokens[some]
        count = np.where(wanted > 0, count, 0)
        order = np.lexsort(((bucket.astype(np.int64) << 32) | tokens, level, owner))
        order = order[np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count) < wanted[owner[order]]]
        order = order[np.argsort(bucket[order], kind="stable")]
        owner, bucket, tokens = owner[order], bucket[order], tokens[order]
        out = [[], [], []]
        for a, b in _bucket_cuts(bucket):
            who, local = np.unique(owner[a:b], return_inverse=True)
            posts = np.empty(b - a, [("token", "<u4"), ("set", "<u4" if len(who) > 65535 else "<u2")])
            posts["token"], posts["set"] = tokens[a:b], local
            for column, value in zip(out, (int(bucket[a]), sets[who].tobytes(), posts.tobytes())):
                column.append(value)
        return pa.table({"bucket": pa.array(out[0], pa.int32()), "sets": pa.array(out[1], pa.binary()),
                         "postings": pa.array(out[2], pa.binary())})

    return found.groupBy("batch").applyInArrow(releasing(rare), "bucket int, sets binary, postings binary")


def chained(postings: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all sets with a common prefix shingle and sizes within reach.

    In order of size, neighbours of one token are chained where their sizes are within reach: any
    two sets within reach are then connected. A bucket returns a star forest of its sets.
    """
    def chain(rows: pa.Table) -> pa.Table:
        keys, sizes, tokens, owner = [], [], [], []
        at = 0
        for sets, posts in zip(rows["sets"].to_pylist(), rows["postings"].to_pylist()):
            s = np.frombuffer(sets, _SET)
            wide = "<u4" if len(s) > 65535 else "<u2"
            p = np.frombuffer(posts, [("token", "<u4"), ("set", wide)])
            keys.append(s["key"])
            sizes.append(s["n"])
            tokens.append(p["token"])
            owner.append(p["set"].astype(np.int64) + at)
            at += len(s)
        distinct, first, name = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        n = np.concatenate(sizes)[first].astype(np.int64)
        token, owner = np.concatenate(tokens), name[np.concatenate(owner)]
        root = local_roots(len(distinct), *_chain(token, owner, n, percent))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([distinct[moved], distinct[root[moved]]], schema=_LINKS)

    return postings.groupBy("bucket").applyInArrow(releasing(chain), "a long, b long")


class SignatureTree:
    """Documents in order of size under nodes of up to FANOUT children.

    ``levels[0]`` is the documents; each level has bits (OR), least and most (sizes) and spare (the
    most tokens of a document that share their bit with another of its tokens).
    """

    def __init__(self, hashes: list[np.ndarray]):
        n = np.array([len(h) for h in hashes])
        self.order = np.argsort(n, kind="stable")
        bits = np.zeros((len(n), SIGNATURE_BITS), bool)
        for i, doc in enumerate(self.order):
            bits[i, (hashes[doc] >> np.uint64(20)).astype(np.int64) % SIGNATURE_BITS] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        n = n[self.order]
        self.levels = [(packed, n, n, n - bits.sum(axis=1))]
        while len(self.levels[-1][1]) > 1:
            bits_, least, most, spare = self.levels[-1]
            cut = np.arange(0, len(least), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits_, cut, axis=0), np.minimum.reduceat(least, cut),
                                np.maximum.reduceat(most, cut), np.maximum.reduceat(spare, cut)))


def _can_link(level_a, a: np.ndarray, level_b, b: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a link: by size ranges and by the largest possible overlap."""
    bits_a, least_a, most_a, spare_a = (x[a] for x in level_a)
    bits_b, least_b, most_b, spare_b = (x[b] for x in level_b)
    common = np.bitwise_count(bits_a & bits_b).sum(axis=1).astype(np.int64)
    most = np.minimum(np.minimum(most_a, most_b), common + np.minimum(spare_a, spare_b))
    return ((most_a * 100 >= least_b * percent) & (most_b * 100 >= least_a * percent)
            & (most * (100 + percent) >= percent * (least_a + least_b)))


def node_pairs(one: SignatureTree, two: SignatureTree, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal down to the nodes above the documents: the pairs that may hold a link."""
    top = max(len(one.levels), len(two.levels)) - 1
    a = b = np.zeros(1, np.int64)
    for depth in range(top, 0, -1):
        la, lb = min(depth, len(one.levels) - 1), min(depth, len(two.levels) - 1)
        keep = _can_link(one.levels[la], a, two.levels[lb], b, percent)
        a, b = a[keep], b[keep]
        if depth == 1:
            break
        if la == depth:
            width = len(one.levels[la - 1][1])
            a, b = np.repeat(a * FANOUT, FANOUT) + np.tile(np.arange(FANOUT), len(a)), np.repeat(b, FANOUT)
            a, b = a[a < width], b[a < width]
        if lb == depth:
            width = len(two.levels[lb - 1][1])
            a, b = np.repeat(a, FANOUT), np.repeat(b * FANOUT, FANOUT) + np.tile(np.arange(FANOUT), len(b))
            a, b = a[b < width], b[b < width]
        if same:
            a, b = a[a <= b], b[a <= b]
    return a, b


def _dense(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of every hash's distinct value, in ascending order, and how often each value stands there."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    dense = np.empty(len(hashes), np.int32)
    dense[order] = np.cumsum(new, dtype=np.int32) - 1
    return dense, np.diff(np.r_[np.flatnonzero(new), len(hashes)]).astype(np.int32)


def linked_groups(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> np.ndarray:
    """Component (smallest member's place) of each set over the links of a cell.

    ``side`` is None for the links among all sets, or tells two blocks apart: then only links
    between the blocks count.
    """
    sizes = np.array([len(s) for s in sets])
    at = np.r_[0, np.cumsum(sizes)]
    dense, count = _dense(np.concatenate(sets))
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    near = _prefix(count[dense], owner, at, percent)
    near = near[count[dense[near]] > 1]
    group = local_roots(len(sets), *_chain(dense[near], owner[near], sizes, percent))
    label = np.arange(len(sets))
    flags = np.zeros(len(count), bool)
    order = np.argsort(group, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(group[order])) + 1, len(order)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a == 1:
            continue
        members = order[a:b]
        if side is None:
            _join_trees(members, members, sets, dense, at, flags, label, percent)
        else:
            one, two = members[~side[members]], members[side[members]]
            if len(one) and len(two):
                _join_trees(one, two, sets, dense, at, flags, label, percent)
    return label


def _join_trees(one, two, sets, dense, at, flags, label, percent) -> None:
    """Unite in ``label`` the linked sets of the lists ``one`` and ``two`` (the same list, or two)."""
    same = one is two
    tree_a = SignatureTree([sets[i] for i in one])
    tree_b = tree_a if same else SignatureTree([sets[i] for i in two])
    nodes_a, nodes_b = node_pairs(tree_a, tree_b, percent, same)
    order = np.argsort(nodes_a, kind="stable")
    nodes_a, nodes_b = nodes_a[order], nodes_b[order]
    docs_a, docs_b = tree_a.levels[0], tree_b.levels[0]
    ids_a, ids_b = one[tree_a.order], two[tree_b.order]
    cuts = np.r_[0, np.flatnonzero(np.diff(nodes_a)) + 1, len(nodes_a)]
    for begin, end in zip(cuts[:-1], cuts[1:]):
        if begin == end:
            continue
        node = int(nodes_a[begin])
        others = (nodes_b[begin:end, None] * FANOUT + np.arange(FANOUT)).ravel()
        others = others[others < len(two)]
        for x in range(node * FANOUT, min((node + 1) * FANOUT, len(one))):
            doc = ids_a[x]
            y = others[others > x] if same else others
            y = y[label[ids_b[y]] != label[doc]]  # already connected: cannot change a component
            if len(y):
                y = y[_can_link(docs_a, np.full(len(y), x), docs_b, y, percent)]
            if not len(y):
                continue
            own = dense[at[doc]:at[doc + 1]]
            flags[own] = True
            ids, k = ids_b[y], 0
            reach = np.cumsum(at[ids + 1] - at[ids])
            while k < len(ids):
                before = reach[k - 1] if k else 0
                end_k = max(k + 1, int(np.searchsorted(reach, before + STEP_TOKENS, "right")))
                part, k = ids[k:end_k], end_k
                part = part[label[part] != label[doc]]
                if not len(part):
                    continue
                lengths = at[part + 1] - at[part]
                starts = np.cumsum(lengths) - lengths
                spots = np.arange(lengths.sum()) + np.repeat(at[part] - starts, lengths)
                overlap = np.add.reduceat(flags[dense[spots]].astype(np.int64), starts)
                linked = part[overlap * (100 + percent) >= percent * (lengths + len(own))]
                if len(linked):
                    joined = np.unique(np.r_[label[linked], label[doc]])
                    label[np.isin(label, joined)] = joined[0]
            flags[own] = False


def _sets_of(column: pa.ChunkedArray, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The set of every text and its two keys, a step of the texts at a time."""
    sets: list[np.ndarray] = []
    keys: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for _, data, offsets in text_views(column):
        hashes, at = shingles(data, offsets, k)
        sets += np.split(hashes, at[1:-1])
        keys.append(set_keys(hashes, at))
    key1, key2 = (np.concatenate(x) for x in zip(*keys))
    return sets, key1, key2


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """Components of ``docs(doc_id, text)`` under links of Jaccard similarity >= percent / 100.

    One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links,
    itself included). Texts that are null or without words have an empty set and link with nothing;
    rows with a null id link with nothing. Repeated rows and repeated ids count as documents of
    their own that share an id. Empty table: no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = stash(shingle_sets(docs, k))
    sets = scanned.select("doc_id", "n", "key1", "key2")
    full = scanned.where("n > 0 and doc_id is not null")
    # a class and the text of its smallest id
    classes = (full.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("least"))
               .select("key1", "key2", F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("text_hash"),
                       F.col("least.n").alias("n")))
    total = full.agg(F.sum("n").alias("n"), F.count("*").alias("docs")).first()
    if not total["docs"]:
        return sets.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    postings = int(posted(np.array(total["n"]), percent)) + total["docs"]
    buckets = max(1, -(-postings // BUCKET_POSTINGS), spark.sparkContext.defaultParallelism)
    first = prefix_postings(docs.where("text is not null and doc_id is not null"), buckets, k, percent)
    groups = components(stash(chained(rare_postings(shared_postings(first, percent), percent), percent)))
    members = stash(groups.join(classes, groups["node"] == classes["key1"])
                    .select("rep", "key1", "key2", "text_hash", "n", F.col("component").alias("group")))
    sized = members.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    whole = members.agg(F.count("*").alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    buckets = max(1, -(-whole["m"] // GROUP_DOCS), -(-whole["shingles"] // GROUP_SHINGLES))
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = (members.join(sized, "group").withColumn("blocks", blocks)
             .withColumn("mine", F.pmod(F.xxhash64("key1", "key2"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("rep", "key1", "key2", "text_hash", "group", "mine", F.least("mine", "other").alias("low"),
                     F.greatest("mine", "other").alias("high"),
                     F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(buckets))).otherwise(F.col("group"))
                     .alias("bucket"), (F.col("blocks") > 1).alias("split")))
    # the keys are checked in the task; equal rows come more than once
    hashed = docs.where("text is not null").withColumn("hash", F.xxhash64("text"))
    cells = dealt.join(hashed, (dealt["rep"] == hashed["doc_id"]) & (dealt["text_hash"] == hashed["hash"])) \
        .drop("doc_id", "hash", "text_hash")

    def join_cell(rows: pa.Table) -> pa.Table:
        found = [[], []]
        sets_, key1, key2 = _sets_of(rows["text"], k)
        rows = rows.drop_columns("text")
        right = np.flatnonzero((key1 == rows["key1"].to_numpy()) & (key2 == rows["key2"].to_numpy()))
        rep, group, mine, low, high = (rows[c].to_numpy() for c in ("rep", "group", "mine", "low", "high"))
        ident = np.stack([group, key1, key2])[:, right]
        _, once = np.unique(ident, axis=1, return_index=True)
        right = right[once]
        right = right[np.lexsort((rep[right], group[right]))]
        cuts = np.r_[0, np.flatnonzero(np.diff(group[right])) + 1, len(right)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = right[a:b]
            if not len(part):
                continue
            side = None if low[part[0]] == high[part[0]] else mine[part] == high[part[0]]
            label = linked_groups([sets_[i] for i in part], side, percent)
            moved = np.flatnonzero(label != np.arange(len(label)))
            found[0].append(rep[part[moved]])
            found[1].append(rep[part[label[moved]]])
        if not found[0]:
            return _LINKS.empty_table()
        return pa.table([np.concatenate(x) for x in found], schema=_LINKS)

    links = stash(cells.groupBy("split", "bucket", "low", "high").applyInArrow(releasing(join_cell), "a long, b long"))
    linked = components(links)
    named = (classes.join(linked, classes["rep"] == linked["node"], "left")
             .select("key1", "key2", F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("full")))
    rows = sets.withColumn("full", (F.col("n") > 0) & F.col("doc_id").isNotNull())
    return rows.join(named, ["key1", "key2", "full"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
