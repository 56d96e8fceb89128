"""Exact quantiles of unbounded domains against sorted values."""
import math
import random

import pytest

from touchline.operators.stats import exact_quantile


def plain(values, q):
    v = sorted(values)
    at = q * (len(v) - 1)
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo + (hi - lo) * (at - math.floor(at))


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 1.0])
def test_equals_sorting(spark, q):
    rnd = random.Random(7)
    groups = {"a": [rnd.gauss(0, 1) for _ in range(3000)], "b": [10.0 ** rnd.uniform(-200, 200) * rnd.choice([-1, 1]) for _ in range(2000)],
              "c": [5.0] * 1500 + [rnd.random() for _ in range(600)], "d": [1.5], "e": [2.0, 4.0], None: [float(i % 97) for i in range(1000)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("f", None), ("a", float("nan"))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.x for r in exact_quantile(df, ["g"], "v", q, "x", ranges=8, range_rows=20).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k] == pytest.approx(plain(vs, q), rel=1e-12)


def test_a_million_distinct_doubles(spark):
    df = spark.range(1_000_000).selectExpr("CAST((id * 7919 + 13) % 1000003 AS double) / 7 AS v")
    values = [((i * 7919 + 13) % 1000003) / 7 for i in range(1_000_000)]
    assert exact_quantile(df, [], "v", 0.5, "x", range_rows=5000).first().x == plain(values, 0.5)


def test_no_rows(spark):
    assert exact_quantile(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0
