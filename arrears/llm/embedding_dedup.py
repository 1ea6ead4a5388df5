"""Embedding near-duplicates by PCA-ordered tiled comparison.

All pairs of vectors with cosine >= threshold, found tile against tile. Unit vectors are rotated
into the corpus' principal axes, largest variance first, so that the leading dimensions carry most
of a product. A pair's product is accumulated block by block; what is still missing is at most the
product of the two suffix norms, and a pair is dropped as soon as even that cannot reach the
threshold. Survivors are decided by the cosine of the raw vectors in double precision.

Scale: equal vectors are folded into one representative before any comparison; representatives
are dealt by hash into tiles of bounded size, and a task handles one pair of tiles. A task returns
the link counts of its rows and star links (member, smallest member of its local component), never
pairs, so the output stays linear in the rows of its tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import components, local_roots, stash
from arrears.llm.topk_search import _matrix, _widen

TILE = 4096
LEADING = 16  # dimensions added per step
SLACK = 1e-4  # bounds are computed in single precision on unit vectors
_PARTS = pa.schema([("node", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def usable(vector: str) -> F.Column:
    """True for vectors that can link: not null, only finite components, at least one not zero."""
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(c, lambda x: x != 0)
    return F.coalesce(c.isNotNull() & ~bad & some, F.lit(False))


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def principal_axes(reps: DataFrame) -> np.ndarray:
    """Axes (as columns) of the unit vectors' second moments over all rows, largest first.

    Each task sends one partial d x d matrix; Spark adds them up entry by entry.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(0)).astype(float))
                width = max(x.shape[1], len(total))
                x = _widen(x, width)
                grown = np.zeros((width, width))
                grown[:len(total), :len(total)] = total
                total = grown + x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                          pa.array(total.ravel())], ["i", "j", "m"])

    cells = (reps.select("vector").mapInArrow(moments, "i int, j int, m double")
             .groupBy("i", "j").agg(F.sum("m").alias("m")).toArrow())
    width = int(np.sqrt(len(cells)))
    matrix = np.zeros((width, width))
    matrix[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["m"].to_numpy()
    values, axes = np.linalg.eigh(matrix)
    return axes[:, np.argsort(-values, kind="stable")]


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool):
    """Row pairs (i of a, j of b) with cosine >= threshold; ``same``: only i < j of one tile."""
    unit_a, unit_b = _unit(a), _unit(b)
    lead_a, lead_b = ((u @ axes).astype(np.float32) for u in (unit_a, unit_b))
    width = len(axes)
    steps = list(range(LEADING, width, LEADING)) + [width]
    rest_a, rest_b = ([np.sqrt((x[:, s:].astype(float) ** 2).sum(axis=1)).astype(np.float32) for s in steps]
                      for x in (lead_a, lead_b))
    found_i, found_j = [], []
    for top in range(0, len(a), 512):
        rows = slice(top, min(top + 512, len(a)))
        partial, at, step = 0, 0, 0
        while True:  # whole block of pairs, until few enough are left to follow them one by one
            partial = partial + lead_a[rows, at:steps[step]] @ lead_b[:, at:steps[step]].T
            alive = partial >= threshold - SLACK - rest_a[step][rows, None] * rest_b[step][None, :]
            if same:
                alive &= np.arange(rows.start, rows.stop)[:, None] < np.arange(len(b))[None, :]
            at, step = steps[step], step + 1
            if step == len(steps) or np.count_nonzero(alive) <= alive.size // 50:
                break
        left_i, left_j = np.nonzero(alive)
        part = partial[left_i, left_j]
        left_i = left_i + rows.start
        for begin in range(0, len(left_i), 1 << 17):
            i, j, p = (x[begin:begin + (1 << 17)] for x in (left_i, left_j, part))
            for s in range(step, len(steps)):
                p = p + np.einsum("ij,ij->i", lead_a[i, steps[s - 1]:steps[s]], lead_b[j, steps[s - 1]:steps[s]])
                stay = p >= threshold - SLACK - rest_a[s][i] * rest_b[s][j]
                i, j, p = i[stay], j[stay], p[stay]
            dots = np.einsum("ij,ij->i", a[i], b[j])
            norms = np.linalg.norm(a, axis=1)[i] * np.linalg.norm(b, axis=1)[j]
            with np.errstate(all="ignore"):
                cosine = dots / norms
            odd = ~np.isfinite(cosine) | (norms < 1e-150)  # out of double range: use the scaled vectors
            cosine[odd] = np.einsum("ij,ij->i", unit_a[i[odd]], unit_b[j[odd]])
            link = cosine >= threshold
            found_i.append(i[link])
            found_j.append(j[link])
    return np.concatenate(found_i or [np.zeros(0, int)]), np.concatenate(found_j or [np.zeros(0, int)])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """Near-duplicate classes of ``vectors(vec_id, vector)`` by cosine >= ``threshold``.

    One output row per input row: vec_id, n_links, component_id, kept. Vectors that are null, zero
    or hold null or non-finite components link with nothing; shorter vectors count as filled up
    with zeros. Rows are vectors of their own even where ids repeat (the component is then the
    smallest id of any of them). Rows with a null id link with nothing. Empty table: no rows.
    """
    rows = vectors.select("vec_id", F.transform("vector", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"),
                          (usable("vector") & F.col("vec_id").isNotNull()).alias("usable"))
    reps = stash(rows.where("usable").groupBy("vector")
                 .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
                 .withColumn("node", F.monotonically_increasing_id()))  # written once: a vector's own number
    n = reps.count()
    if n:
        axes = principal_axes(reps)
        tiles = max(1, -(-n // tile))
        mine = F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int")
        cells = (reps.withColumn("tile", mine)
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
                 .select(F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
                         "tile", "node", "rep", "copies", "vector"))

        def cell(group: pa.Table) -> pa.Table:
            low, high = group["low"][0].as_py(), group["high"][0].as_py()
            sides = []
            for t in dict.fromkeys((low, high)):
                side = group.filter(pc.equal(group["tile"], t)).combine_chunks()
                if not len(side):
                    return _PARTS.empty_table()
                sides.append((side["rep"].to_numpy(), side["node"].to_numpy(), side["copies"].to_numpy(),
                              _widen(_matrix(pa.concat_arrays(side["vector"].chunks)), len(axes))))
            (rep_a, node_a, copies_a, a), (rep_b, node_b, copies_b, b) = sides[0], sides[-1]
            i, j = linked_pairs(a, b, axes, threshold, low == high)
            if low == high:
                reps_here, nodes_here, at_j = rep_a, node_a, j
                links = (np.bincount(i, copies_a[j], len(rep_a)) + np.bincount(j, copies_a[i], len(rep_a)))
            else:
                reps_here, nodes_here, at_j = np.r_[rep_a, rep_b], np.r_[node_a, node_b], j + len(rep_a)
                links = np.r_[np.bincount(i, copies_b[j], len(rep_a)), np.bincount(j, copies_a[i], len(rep_b))]
            order = np.argsort(reps_here, kind="stable")
            spot = np.empty_like(order)
            spot[order] = np.arange(len(order))
            root = reps_here[order][local_roots(len(order), spot[i], spot[at_j])]
            some = links > 0
            return pa.table([nodes_here[some], reps_here[some], root[spot[some]], links[some].astype(np.int64)], schema=_PARTS)

        parts = stash(cells.groupBy("low", "high").applyInArrow(cell, "node long, a long, b long, links long"))
        degree = parts.groupBy("node").agg(F.sum("links").alias("links"))  # of the vector, not of its id
        comps = components(parts.select("a", "b")).withColumnRenamed("node", "rep")
        classes = (reps.join(degree, "node", "left").join(comps, "rep", "left")
                   .select("vector", "rep", "copies", "links", "component"))
    else:
        classes = reps.select("vector", "rep", "copies", F.lit(None).cast("long").alias("links"),
                              F.lit(None).cast("long").alias("component"))
    classes = classes.withColumn("usable", F.lit(True))
    out = rows.join(classes, ["vector", "usable"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", F.when(F.col("usable") & F.col("rep").isNotNull(), F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
                      .otherwise(F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
