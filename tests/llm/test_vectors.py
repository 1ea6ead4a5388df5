import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrears.llm import embedding_dedup, topk_search
from tests.llm.helpers import components

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score int"


def odd_vectors(spark, n=150, width=12):
    r = random.Random(5)
    base = [[r.gauss(0, 0.3) for _ in range(width)] for _ in range(n)]
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(n + i, [x + r.gauss(0, 0.02) for x in base[i % 7]]) for i in range(40)]  # near copies
    rows += [(n + 40 + i, base[3]) for i in range(60)]  # a third are one vector: ties
    rows += [(900, None), (901, [0.0] * width), (902, [math.nan] + [1.0] * (width - 1)),
             (903, [math.inf] + [1.0] * (width - 1)), (904, [None] + [1.0] * (width - 1)), (905, []),
             (906, base[5][:4]), (907, [x * 1e18 for x in base[9]]), (None, base[1])]
    return spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], VECTORS), rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def as_floats(v, width=12):
    return np.array([float(np.float32(x)) for x in v] + [0.0] * (width - len(v)))


@pytest.mark.parametrize("block", [(512, 8192), (16, 40)])
def test_top_k_equals_brute_force(spark, block):
    df, rows = odd_vectors(spark)
    df = df.where("vec_id is null or vec_id <> 907")  # kept small: see the test of large values
    whole = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("long"))
    vectors = topk_search.one_per_id(df.where(topk_search.finite("embedding")).select("vec_id", whole.alias("vector")))
    got = topk_search.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20, *block).collect()
    known = {i: np.floor(64 * as_floats(v)).astype(int) for i, v in rows if i is not None and i != 907 and usable(v)}
    want = set()
    for q, v in known.items():
        if q % 20 == 0:
            best = sorted(((-int(v @ w), c) for c, w in known.items() if c != q))[:20]
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_top_k_large_values_and_few_candidates():
    q = np.array([[2**30, 1], [1, -1]])
    v = np.array([[2**30, 5], [2**30, 6], [-(2**30), 2]])
    rows, found, score = topk_search.nra_top_k(np.array([100, 101]), q, np.array([1, 2, 3]), v, 20)
    assert [(int(a), int(b), int(s)) for a, b, s in zip(rows, found, score)] == [
        (0, 1, 2**60 + 6), (0, 0, 2**60 + 5), (0, 2, -(2**60) + 2), (1, 0, 2**30 - 5), (1, 1, 2**30 - 6), (1, 2, -(2**30) - 2)]


def test_top_k_empty(spark):
    none = spark.createDataFrame([], "vec_id long, vector array<long>")
    assert topk_search.top_k(none, none).count() == 0


@pytest.mark.parametrize("tile", [4096, 50])
def test_near_duplicates_equal_brute_force(spark, tile):
    df, rows = odd_vectors(spark)
    got = embedding_dedup.near_duplicates(df.select("vec_id", F.col("embedding").alias("vector")), 0.95, tile).collect()
    known = [(i, as_floats(v)) for i, v in rows if i is not None and usable(v) and any(v)]
    unit = {i: v / np.linalg.norm(v) for i, v in known}
    links = [(a, b) for a in unit for b in unit if a != b and float(unit[a] @ unit[b]) >= 0.95]
    low = components({i for i, _ in rows if i is not None}, links)
    degree = {i: sum(1 for a, _ in links if a == i) for i in low}
    want = {(i, degree.get(i, 0), low.get(i), None if i is None else low[i] == i) for i, _ in rows}
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_near_duplicates_empty(spark):
    none = spark.createDataFrame([], "vec_id long, vector array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0


def test_links_are_counted_per_vector_where_ids_repeat(spark):
    r = random.Random(8)
    a, b = ([r.gauss(0, 1) for _ in range(8)] for _ in range(2))
    near = lambda v: [x + r.gauss(0, 0.01) for x in v]
    rows = [(5, a), (5, b), (6, near(a)), (7, near(b)), (8, near(b)), (9, [r.gauss(0, 1) for _ in range(8)])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    for tile in (4096, 2):
        got = sorted(tuple(x) for x in embedding_dedup.near_duplicates(df, 0.95, tile).collect())
        assert got == [(5, 1, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 2, 5, False), (8, 2, 5, False), (9, 0, 9, True)]
