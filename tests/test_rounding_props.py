"""Property checks: the exact half-even helpers equal rational arithmetic."""

from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.functions import expressions as X


def _half_even(fr: Fraction) -> int:
    return round(fr)   # Python rounds Fractions half to even


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**12, 10**12), st.integers(1, 10**6)), min_size=200, max_size=200))
def test_half_even_div_matches_fraction(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(X.half_even_div("n", "d")).collect()]
    assert got == [_half_even(Fraction(n, d)) for n, d in pairs]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(-9 * 10**18, 9 * 10**18), st.integers(1, 4 * 10**18)), min_size=400, max_size=400))
def test_half_even_div_is_exact_beyond_doubles(spark, pairs):
    pairs = [*pairs, (5349979066121302517, 884107995872), (9 * 10**18, 1), (-9 * 10**18, 2), (5, 10), (15, 10), (-25, 10), (7, 0)]
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [tuple(r) for r in df.select(X.half_even_div("n", "d"), X.half_even_div_wide("n", "d")).collect()]
    want = [None if d == 0 else _half_even(Fraction(n, d)) for n, d in pairs]
    assert got == [(w, w) for w in want]


def test_mean_diff_of_a_large_group(spark):
    """10^7 rows in one group, with and without NULLs on one side."""
    n = 10_000_000
    df = spark.range(n).select((F.col("id") % 5).alias("a"), (F.col("id") % 4).alias("b"),
                               F.when(F.col("id") % 10 > 0, F.col("id") % 4).alias("c"))
    got = df.agg(X.mean_diff_half_even("a", "b").alias("x"), X.mean_diff_half_even("a", "c").alias("y"),
                 X.mean_half_even("a", 6, 2).alias("z")).first()
    c = [i % 4 for i in range(20) if i % 10 > 0]
    assert got["x"] == 0.5 and got["z"] == 2.0
    assert got["y"] == _half_even((2 - Fraction(sum(c), len(c))) * 10**6) / 10**6


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.one_of(st.none(), st.integers(0, 999))),
                min_size=300, max_size=300))
def test_mean_half_even_matches_fraction(spark, rows):
    # values with two decimals (units of 0.01), grouped into 31 groups
    df = spark.createDataFrame([(g, None if v is None else v / 100) for g, v in rows], "g long, v double")
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(X.mean_half_even("v", 3, 2).alias("m")).collect()}
    for g in got:
        vals = [v for gg, v in rows if gg == g and v is not None]
        want = None if not vals else _half_even(Fraction(sum(vals) * 1000, len(vals) * 100)) / 1000
        assert got[g] == want, (g, got[g], want)
