import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arrears.llm import metric_tree, queries, vector_codes
from tests.llm.test_vectors import odd_vectors, usable

LIMIT = 2**62


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """{(vec_id, label, code, error): rows} and the digest, with Python integers."""
    rows = [(i, [float(np.float32(x)) for x in v], g) for i, v, g in rows if usable(v)]
    width = parts * max(1, -(-max((len(v) for _, v, _ in rows), default=0) // parts))
    limit = math.floor(math.sqrt(2.0**62 / width) / 2)
    whole = lambda v: [max(-limit, min(limit, math.floor(x * scale))) for x in v] + [0] * (width - len(v))
    wide = width // parts
    first = {}
    for i, v, _ in rows:
        if i is not None and (i not in first or v < first[i]):
            first[i] = v
    start = [whole(first[i]) for i in sorted(first)[:entries]]
    vectors = [(i, whole(v), g) for i, v, g in rows]
    books = [[v[p * wide:(p + 1) * wide] for v in start] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in vectors:
                x = v[p * wide:(p + 1) * wide]
                own[nearest(p, x)[1]].append(x)
            for e, xs in own.items():
                books[p][e] = [sum(column) // len(xs) for column in zip(*xs)]
    out = []
    for i, v, g in vectors:
        found = [nearest(p, v[p * wide:(p + 1) * wide]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), g))
    by_label = defaultdict(int)
    for _, _, error, g in out:
        by_label[g] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, by_label[g], digest) for i, c, e, g in out), key=str)


def codes(df, **options):
    got = vector_codes.compress(df.select("vec_id", F.col("embedding").alias("vector"), "label"), **options)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("chunk", [4096, 37])
def test_codes_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(vector_codes, "CHUNK_ROWS", chunk)
    df, rows = odd_vectors(spark, width=48)
    # labels with nulls; repeated ids; the huge vector is cut off
    rows = [(i, v, None if i is None or i % 3 == 0 else i % 2) for i, v in rows] + [(3, rows[8][1], 1), (3, rows[3][1], 0)]
    df = spark.createDataFrame([(i, v, g, 1, 1) for i, v, g in rows], df.schema)
    assert codes(df) == brute_codes(rows)
    assert codes(df, parts=4, entries=7, rounds=3, scale=16) == brute_codes(rows, 4, 7, 3, 16)


def test_codes_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = [(5, [1.0, 2.0], None), (5, [0.5, 2.0], 2), (None, [3.0], 2), (6, [], 2), (7, None, 2)]
    assert codes(spark.createDataFrame(few, schema)) == brute_codes(few)
    assert codes(spark.createDataFrame([], schema)) == []
    lone = [(None, [1.0, -2.0], 1)]
    assert [(r[0], r[1]) for r in codes(spark.createDataFrame(lone, schema))] == [(None, "00" * 16)]


def test_trees_answer_as_a_full_search():
    rng = np.random.default_rng(4)
    for n, width, spread in ((1, 4, 9), (400, 3, 2), (3000, 4, 40), (500, 2, 10**8), (50, 0, 1)):
        rows = rng.normal(0, spread, (n, width)).astype(np.int64)
        points, weight = np.unique(rows, axis=0, return_counts=True)
        tree, order = metric_tree.build(points, weight, leaf=6)
        assert (tree.points == points[order]).all() and tree.count[-1] == n
        inner = tree.left >= 0
        assert (tree.count[inner] == tree.count[tree.left[inner]] + tree.count[tree.right[inner]]).all()
        entries = rows[rng.integers(0, n, 40)]
        entries[7:9] = entries[2]
        nearest, handed = metric_tree.assign(tree, entries)
        full = ((tree.points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (nearest == full.argmin(axis=1)).all()
        if n == 3000:
            assert len(handed[0][1]) > 50  # balls that are owned whole
        total, count = metric_tree.sums(tree, entries)
        for e in range(len(entries)):
            assert count[e] == tree.weight[nearest == e].sum()
            assert (total[e] == (tree.points * tree.weight[:, None])[nearest == e].sum(axis=0)).all()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    df = queries.QUERIES["op12_vector_codes"](spark, sf)
    rel = con.sql(queries.ORACLES["op12_vector_codes"])
    assert df.columns == rel.columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(rel.fetchall())
