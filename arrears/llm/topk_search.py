"""Exact top-k search by no-random-access aggregation over sorted lists.

Each component is a list of the candidates sorted by value; a query reads a list from its high end
where its weight is positive and from its low end where it is negative. Lists are read in rounds.
After a round every candidate has a lower bound (unread entries count as the list's last value)
and an upper bound (unread entries count as the value last read). Reading stops for a query as
soon as few enough candidates have an upper bound that reaches the k-th best lower bound: nobody
outside can qualify. Their final scores are then resolved, ties to the smaller id.

Scale: queries and candidates are dealt by hash into blocks of bounded size; a task handles one
cell (query block, candidate block), so memory never depends on the table's size. Every cell
returns at most k rows a query, and a window over the cells' rows keeps the k best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8192
# share of every list that is still unread after each round
UNREAD = (0.5, 0.25, 0.125, 0.0625, 0.0)
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(values: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled up with zeros."""
    lengths = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _widen(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _spare_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep: of equal vectors only the k + 1 smallest ids can be among a query's k best."""
    by_id = np.argsort(ids, kind="stable")
    _, group = np.unique(vectors[by_id], axis=0, return_inverse=True)
    group = group.ravel()
    by_group = np.argsort(group, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(group[by_group])) + 1]
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
    return np.sort(by_id[by_group[place <= k]])


def nra_top_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """The k best candidates of each query by integer inner product: (query row, candidate row, score)."""
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = _widen(queries, width), _widen(vectors, width)
    kept = _spare_copies(ids, vectors, k)
    ids, vectors = ids[kept], vectors[kept]
    n = len(ids)
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * 2 * max(width, 1)
    # bounds are exact integers in the chosen type, so comparisons with them are exact too
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
    weights = np.hstack([np.maximum(queries, 0), np.maximum(-queries, 0)]).astype(kind)
    values = np.hstack([vectors, -vectors]).astype(kind)
    order = np.argsort(-vectors, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None] * np.ones((1, width), order.dtype), axis=0)
    place = np.hstack([place, n - 1 - place])  # the second half reads the same lists from the low end
    lists = np.take_along_axis(vectors, order, axis=0)
    lists = np.hstack([lists, -lists[::-1]]).astype(kind)
    last = lists[-1]
    lower = np.repeat((weights @ last)[:, None], n, axis=1)
    own = query_ids[:, None] == ids[None, :]
    active = np.arange(len(query_ids))
    read, found = 0, []
    for unread in UNREAD:
        depth = n - int(n * unread)
        if depth <= read and unread:
            continue
        fresh = (place >= read) & (place < depth)
        seen = place < depth
        lower = lower + weights[active] @ np.where(fresh, values - last, 0).T.astype(kind)
        upper = weights[active] @ np.where(seen, values, lists[depth - 1]).T
        mine = own[active]
        low = np.where(mine, -np.inf, lower) if kind != np.int64 else np.where(mine, np.iinfo(np.int64).min, lower)
        reach = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(active), low.min(initial=0))
        can = (upper >= reach[:, None]) & ~mine
        done = (can.sum(axis=1) <= 8 * k) | (depth == n)
        q, c = np.nonzero(can[done])
        found.append((active[done][q], c))
        active, lower, read = active[~done], lower[~done], depth
        if not len(active):
            break
    q = np.concatenate([x for x, _ in found])
    c = np.concatenate([x for _, x in found])
    scores = np.empty(len(q), np.int64)
    whole_q, whole_v = queries.astype(np.int64), vectors.astype(np.int64)
    for at in range(0, len(q), 1 << 16):  # resolve the final scores of those that can qualify
        part = slice(at, at + (1 << 16))
        scores[part] = np.einsum("ij,ij->i", whole_q[q[part]], whole_v[c[part]])
    best = np.lexsort((ids[c], -scores, q))
    q, c, scores = q[best], c[best], scores[best]
    starts = np.searchsorted(q, q, "left")
    first = np.arange(len(q)) - starts < k
    return q[first], kept[c[first]], scores[first]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20,
          query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """Exact top ``k`` of ``candidates(vec_id, vector)`` for each of ``queries(vec_id, vector)``.

    ``vector`` is array<bigint>; the score is the integer inner product (missing components count
    as zero). A candidate with the query's id is left out. Rows with a null id or vector take no
    part; ids are expected to be unique on each side (see :func:`one_per_id`). Empty tables give no
    rows. Returns query_id, rank (from 1), vec_id, score.
    """
    queries = queries.where("vec_id is not null and vector is not null").select("vec_id", "vector")
    candidates = candidates.where("vec_id is not null and vector is not null").select("vec_id", "vector")
    q_blocks = max(1, -(-queries.count() // query_block))
    c_blocks = max(1, -(-candidates.count() // candidate_block))

    def dealt(df, own, blocks, other, others, is_query):
        return df.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
                         F.lit(is_query).alias("is_query"), "vec_id", "vector")

    cells = dealt(queries, "qb", q_blocks, "cb", c_blocks, True).unionByName(
        dealt(candidates, "cb", c_blocks, "qb", q_blocks, False))

    def cell(rows: pa.Table) -> pa.Table:
        sides = []
        for is_query in (True, False):
            side = rows.filter(pc.equal(rows["is_query"], is_query))
            if not len(side):
                return _OUT.empty_table()
            sides += [side["vec_id"].to_numpy(), _matrix(pa.concat_arrays(side["vector"].chunks))]
        q, c, score = nra_top_k(*sides, k)
        return pa.table([sides[0][q], sides[2][c], score], schema=_OUT)

    best = cells.groupBy("qb", "cb").applyInArrow(cell, "query_id long, vec_id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def finite(vector: str) -> F.Column:
    """True where the vector and all its components are finite (nulls and NaN are not)."""
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(False))


def one_per_id(df: DataFrame) -> DataFrame:
    """One row per vec_id: repeated ids count once, with the smallest vector in array order."""
    return df.groupBy("vec_id").agg(F.min("vector").alias("vector"))
