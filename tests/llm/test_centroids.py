"""Centroid clustering against a plain Lloyd loop in Python integers."""
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from touchline.llm.centroids import centroid_digest, cluster_vectors, fit, integers

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("cluster", T.StringType()), T.StructField("x", T.StringType())])


def lloyd(rows, clusters, rounds, dim, seed=2, scale=256):
    kept = [(i, [math.floor(scale * c) if abs(c) < 1e300 else int(c) * scale for c in x]) for i, x in rows
            if x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x)]
    named = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))
    centres = [v for _, v in named[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))            # noqa: E731
    for _ in range(rounds if centres else 0):
        own = [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
        for c in range(len(centres)):
            mine = [v for o, (_, v) in zip(own, kept) if o == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    own = [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept] if centres else []
    return sorted(((i, o, far(v, centres[o]), centroid_digest(centres[o])) for (i, v), o in zip(kept, own)), key=repr)


def in_64_bits(rows):
    return sorted(((i, c, d if d < 2**63 else None, s) for i, c, d, s in rows), key=repr)


def run(spark, rows, clusters, rounds, dim, **options):
    table = spark.createDataFrame([(i, x, "c", "x") for i, x in rows], SCHEMA)
    out = cluster_vectors(table, clusters=clusters, rounds=rounds, dim=dim, **options).collect()
    return out, sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in out), key=repr)


def test_equals_a_plain_loop_with_ties_copies_and_unfit_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) + 2 * (i % 5)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]                    # a third are one vector
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, rows[11][1])]       # repeated and null ids
    rows += [(300, None), (301, [1.0] * 5), (302, [1.0, None] + [1.0] * 4), (303, [1.0, float("nan")] + [1.0] * 4),
             (304, [1.0, float("inf")] + [1.0] * 4), (305, [])]
    out, got = run(spark, rows, 9, 5, 6, block=32)
    assert got == lloyd(rows, 9, 5, 6)
    assert {r["inertia"] for r in out} == {sum(r["distance"] for r in out)}
    for c in {r["cluster"] for r in out}:
        mine = [r for r in out if r["cluster"] == c]
        assert {r["cluster_inertia"] for r in mine} == {sum(r["distance"] for r in mine)}


def test_integer_grid_full_of_ties(spark):
    rows = [(i, [float(i % 4), float(i // 4 % 4)]) for i in range(64)]
    assert run(spark, rows, 7, 4, 2, scale=1, block=10)[1] == lloyd(rows, 7, 4, 2, scale=1)


def test_large_components_stay_exact(spark):
    rows = [(i, [1e9 * (i % 3) + i, -3e8 * i]) for i in range(30)]
    assert run(spark, rows, 4, 3, 2)[1] == in_64_bits(lloyd(rows, 4, 3, 2))
    huge = [(i, [1e308 * (-1) ** i, float(i)]) for i in range(12)]
    assert run(spark, huge, 3, 2, 2)[1] == in_64_bits(lloyd(huge, 3, 2, 2))


def test_only_expired_vectors_are_rescanned(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * 0.05 + 10 * (i % 8)).tolist()) for i in range(800)]
    table = spark.createDataFrame([(i, x, "c", "x") for i, x in rows], SCHEMA)
    found, centroids, rescanned = fit(table, clusters=8, rounds=5, dim=4, block=100)
    assert found.count() == rescanned[0] == 800
    assert rescanned[-1] < 400 and len(centroids) == 8


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(None, [1.0, 2.0])]])
def test_tiny_tables(spark, rows):
    assert run(spark, rows, 5, 3, 2)[1] == lloyd(rows, 5, 3, 2)


def test_integers_are_floors():
    assert integers(np.array([[-0.001, 0.004, 1e305]]), 256).tolist() == [[-1, 1, int(1e305) * 256]]
