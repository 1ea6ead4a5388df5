"""Vector code compression: product codes learned with metric trees over the parts of the vectors.

Vectors become integers floor(scale * x) and are cut into equal consecutive parts. Each part position
has a codebook that starts as the parts of the vectors of the smallest ids and is moved by a few rounds of
nearest-entry assignment and componentwise floored means. An assignment descends anchors-hierarchy
trees (``metric_tree``): balls cache sums and counts, and lists of candidate entries shrink on
the way down until a ball is wholly owned.

Scale: rows are dealt to chunks as they are read, without a shuffle. One row of the chunk table holds the
chunk's ids and its trees, one for each part position; equal parts are one point with a weight, so many
copies of a vector cost one point. Rounds read only the chunk table and return sums per entry; a lost
executor costs the re-read of its chunks. The driver sees one codebook: parts * entries vectors.

Odd rows: vectors that are null or hold null or non-finite components are dropped. Shorter vectors, and
lengths that do not divide into parts, are filled up with zeros. Rows may repeat an id: each gets its
code, and the first codebook takes the smallest vector of an id. A null id gets a code but
starts no entry. Components are cut off where squared distances would leave 64 bits (at 2**27, that is
|x| >= 524288, for 64 components). Fewer ids than entries give shorter codebooks; ``label_error`` beyond
64 bits stays at the largest long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrears.llm import metric_tree
from arrears.llm.common import arrow_batches, ship_package, stash
from arrears.llm.topk_search import finite

CHUNK_ROWS = 4096
CHUNKS_AT_ONCE = 8
_FIELDS = {**dict.fromkeys(("left", "right", "begin", "end", "points", "place"), "int"),
           **dict.fromkeys(("pivot", "radius"), "double"), **dict.fromkeys(("total", "count", "weight"), "long")}
_ARROW = {"int": pa.int32(), "double": pa.float64(), "long": pa.int64()}
_SPARK = {"int": T.IntegerType(), "double": T.DoubleType(), "long": T.LongType()}


def whole_components(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), filled up with zeros to ``width``, cut off where distances would overflow."""
    column = column.cast(pa.list_(pa.float64()))
    length = np.diff(column.offsets.to_numpy())
    inside = np.arange(width) < length[:, None]
    out = np.zeros((len(column), width))
    out[inside] = column.flatten().to_numpy(zero_copy_only=False)
    limit = math.floor(math.sqrt(2.0**62 / width) / 2)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -limit, limit).astype(np.int64)


def _chunks(vectors: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """One row per chunk: ids, labels and the trees of its part positions (outer arrays are by position)."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(vectors.schema["vec_id"].dataType)),
                           T.StructField("labels", T.ArrayType(vectors.schema["label"].dataType))])
    for name, kind in _FIELDS.items():
        schema = schema.add(name, T.ArrayType(T.ArrayType(_SPARK[kind])))

    def chunk(rows: pa.Table) -> pa.RecordBatch:
        whole = whole_components(rows["vector"].combine_chunks(), width, scale)
        found = {name: [] for name in _FIELDS}
        for part in np.split(whole, parts, axis=1):
            points, row_point, weight = np.unique(part, axis=0, return_inverse=True, return_counts=True)
            tree, order = metric_tree.build(points, weight)
            place = np.empty(len(order), int)
            place[order] = np.arange(len(order))
            for name, values in tree.arrays().items():
                found[name].append(values.ravel())
            found["place"].append(place[row_point.ravel()])
        nested = [pa.array([v], pa.list_(pa.list_(_ARROW[_FIELDS[name]]))) for name, v in found.items()]
        ids, labels = (rows[c].combine_chunks() for c in ("vec_id", "label"))
        one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, labels)]
        return pa.RecordBatch.from_arrays([*one, *nested], schema.names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                yield chunk(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield chunk(pa.Table.from_batches(held))

    return stash(vectors.select("vec_id", "label", "vector").mapInArrow(build, schema))


def _trees(batch: pa.RecordBatch, row: int, wide: int) -> Iterator[tuple[metric_tree.Tree, np.ndarray]]:
    """The trees of a chunk, by part position, each with the points of the chunk's rows."""
    columns = {name: batch.column(batch.schema.get_field_index(name))[row].values for name in _FIELDS}
    for part in range(len(columns["left"])):
        arrays = {name: column[part].values.to_numpy() for name, column in columns.items()}
        place = arrays.pop("place")
        for name in ("pivot", "total", "points"):
            arrays[name] = arrays[name].reshape(-1, wide)
        yield metric_tree.Tree(**arrays), place


def _moved(chunks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks (part x entry x component) with used entries at the floored means of what they own."""
    parts, entries, wide = codebooks.shape

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for part, (tree, _) in enumerate(_trees(batch, row, wide)):
                    t, c = metric_tree.sums(tree, codebooks[part])
                    total[part] += t
                    count[part] += c
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, wide), pa.int32()), pa.array(np.repeat(entry, wide), pa.int32()),
             pa.array(np.tile(np.arange(wide), len(part)), pa.int32()), pa.array(total[part, entry].ravel()),
             pa.array(np.repeat(count[part, entry], wide))], ["part", "entry", "at", "total", "count"])

    sums = (chunks.mapInArrow(owned, "part int, entry int, at int, total long, count long").groupBy("part", "entry", "at")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("count").alias("count")))
    out = codebooks.copy()
    with arrow_batches(chunks.sparkSession, CHUNKS_AT_ONCE):
        for r in sums.collect():  # one row per component of a codebook
            out[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["count"]
    return out


def _coded(chunks: DataFrame, codebooks: np.ndarray, schema: T.StructType) -> DataFrame:
    wide = codebooks.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = (batch.column(c)[row].values for c in (0, 1))
                codes, error = np.zeros((len(ids), len(codebooks)), np.uint8), np.zeros(len(ids), np.int64)
                for part, (tree, place) in enumerate(_trees(batch, row, wide)):
                    nearest, _ = metric_tree.assign(tree, codebooks[part])
                    gap = tree.points - codebooks[part][nearest]
                    codes[:, part] = nearest[place]
                    error += (gap * gap).sum(axis=1)[place]
                digits = codes.tobytes().hex()
                step = 2 * codes.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([digits[i:i + step] for i in range(0, len(digits), step)], pa.string()),
                     pa.array(error)], schema.names)

    return stash(chunks.mapInArrow(code, schema), CHUNKS_AT_ONCE)


def first_codebooks(vectors: DataFrame, entries: int) -> list:
    """Vectors of the smallest ids, ascending; of a repeated id the smallest vector."""
    known = vectors.where("vec_id is not null")
    ids = [r[0] for r in known.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return []
    rows = known.where(F.col("vec_id") <= ids[-1]).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return [r["vector"] for r in rows.orderBy("vec_id").collect()]  # at most ``entries`` rows


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Codes of ``vectors(vec_id, vector, label)``: vec_id, code, error, label_error, codebooks_sha256.

    ``code`` has two hex digits for each part (``entries`` is at most 256), ``error`` is the squared
    distance to the coded vector, ``label_error`` its sum over the rows of equal label (nulls together).
    """
    spark = vectors.sparkSession
    ship_package(spark)
    vectors = vectors.select("vec_id", "vector", "label").where(finite("vector"))
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    width = parts * max(1, -(-longest // parts))
    start = first_codebooks(vectors, entries)
    if longest and not start:  # rows without any id: no entry to begin with
        start = [[0.0]]
    start = pa.array([list(v) for v in start] or [[]], pa.list_(pa.float64()))
    codebooks = np.stack(np.split(whole_components(start, width, scale), parts, axis=1))
    chunks = _chunks(vectors, width, parts, scale)
    for _ in range(rounds):
        codebooks = _moved(chunks, codebooks)
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"]]).add("code", "string").add("error", "long")
    coded = _coded(chunks, codebooks, schema)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error"))
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")), "left")
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
