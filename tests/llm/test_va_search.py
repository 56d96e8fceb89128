"""Exact top-k against brute force, with ties, repeated vectors and odd rows."""

import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.va_search import CELLS, best_of_block, score_key, top_k

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("score", T.StringType())])


def brute(rows, k):
    vec = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in vec if i % 20 == 0}:
        best = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in vec if i != q and len(v) == len(a))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def rows_of(n=400, dim=12):
    rnd = random.Random(4)
    hot = [rnd.uniform(-1, 1) for _ in range(dim)]
    rows = [(i, hot if i % 3 == 0 else [rnd.choice([-1.0, -0.5, 0.0, 0.25, rnd.uniform(-1, 1)]) for _ in range(dim)], "s") for i in range(n)]
    nan, inf = float("nan"), float("inf")
    return rows + [(1000, None, "s"), (1020, [None] * dim, "s"), (1040, [nan] + [0.0] * (dim - 1), "s"), (1060, [], "s"),
                   (1080, [inf] * dim, "s"), (None, hot, "s"), (1100, [0.5, 0.5], "s"), (1101, [0.25, 1.0], "s"),
                   (1120, [1.0], "s"), (2000, [100.0] * dim, "s")]


def test_equals_brute_force(spark):
    rows = rows_of()
    for blocks in ({}, {"query_block": 5, "vector_block": 17}):
        got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=7, **blocks).collect()
        assert {tuple(r) for r in got} == brute(rows, 7) and len(got) == len(brute(rows, 7))


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0], "s"), (1, [2.0], "s"), (2, [2.0], "s")]
    got = {tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1, 1, 8192), (0, 2, 2, 8192)}
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0], "s")], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_few_exact_vectors_are_read():
    rng = np.random.default_rng(0)
    v = np.floor(64 * rng.normal(0, 0.125, (4000, 64))).astype(int)
    low = v.min(0) / 64
    width = (v.max(0) - v.min(0)) / 64 / CELLS
    codes = np.minimum(np.floor((v / 64 - low) / width), CELLS - 1)
    ids = np.arange(4000)
    best, read = best_of_block(v[:20], ids[:20], codes, v, ids, low, width, 10)
    assert read < 20 * 400
    for q in range(20):
        score = v @ v[q]
        want = sorted((-score[i], i) for i in ids if i != q)[:10]
        assert [(-s, i) for s, i in zip(best[best.query_id == q].score, best[best.query_id == q].vec_id)] == want


def test_a_repeated_id_does_not_push_out_equal_vectors(spark):
    rows = [(20, [1.0, 1.0], "s")] * 21 + [(i, [1.0, 1.0], "s") for i in range(21, 51)] + [(100 + i, [0.1 * (i % 7), 0.2], "s") for i in range(60)]
    rows += [(40, [0.5, -1.0], "s")] * 3                     # a second vector of an id asks for itself
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=20).collect()]
    assert set(got) == brute(rows, 20)
    assert [(i, s) for q, n, i, s in sorted(got) if q == 20][:3] == [(21, 8192), (22, 8192), (23, 8192)]


def test_components_of_any_size(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([1e9, -1e9, 3e5, 0.3, 2.0**46 + 0.5, -1e-20]), rnd.uniform(-1, 1)]) for i in range(120)]
    rows += [(200, [1e308, 1.0]), (201, [-1e308, 2.0]), (220, [2.8e306 * 3, -5.0])]
    vec = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows]
    want = set()
    for q, a in vec:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in vec if i != q)[:9]
            want |= {(q, n + 1, i, -s if -2**63 <= -s < 2**63 else None) for n, (s, i) in enumerate(best)}
    for blocks in ({}, {"query_block": 3, "vector_block": 20}):
        got = top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0, k=9, **blocks).collect()
        assert {tuple(r) for r in got} == want


def test_keys_sort_like_scores():
    scores = [0, 1, 9, 10, 99, 10**30, 7 * 2**2000, -1, -9, -10, -11, -10**30, -(2**2000)]
    assert sorted(scores) == sorted(scores, key=score_key)
