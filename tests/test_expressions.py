"""Edge cases of the column expressions: NULL scores, zero denominators,
zone boundaries, code maps and falsy defaults."""

from pyspark.sql import functions as F

from touchline.functions import expressions as X


def _one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_team_result_null_falls_to_loss(spark):
    out = _one(spark, X.team_result(), [(2, 1), (1, 1), (0, 3), (None, 1), (1, None)],
               "goals_for long, goals_against long")
    assert out == ["W", "D", "L", "L", "L"]


def test_match_outcome(spark):
    out = _one(spark, X.match_outcome(), [(2, 1), (1, 1), (0, 3)], "home_score long, away_score long")
    assert out == ["Home Win", "Draw", "Away Win"]


def test_shot_zone_boundaries(spark):
    rows = [(83.0, 20.0), (83.0, 80.0), (83.0, 19.99), (82.99, 30.0), (67.0, 70.0), (67.0, 70.01),
            (50.0, 0.0), (49.99, 50.0), (None, 50.0), (90.0, None)]
    out = _one(spark, X.shot_zone(), rows, "x_coordinate double, y_coordinate double")
    assert out == ["Six Yard Box", "Six Yard Box", "Wide Close", "Central Penalty Area",
                   "Central Penalty Area", "Wide Penalty Area", "Outside Box", "Long Range",
                   "Unknown", "Unknown"]


def test_ratio_guard_zero_denominator(spark):
    out = _one(spark, X.guarded_ratio("a", "b", 100), [(1, 0), (1, 4), (2, 3)], "a long, b long")
    assert out == [0.0, 25.0, 66.666667]


def test_position_codes_and_availability(spark):
    rows = [(1, "a", 123), (4, "u", None), (7, None, 5)]
    df = spark.createDataFrame(rows, "element_type long, status string, code long")
    got = df.select(X.position_from_code(), X.is_available(), X.squad_number()).collect()
    assert [tuple(r) for r in got] == [("GK", True, 23), ("FWD", False, 0), ("UNK", True, 5)]


def test_falsy_default(spark):
    out = _one(spark, X.falsy_default("v", 0.5), [(None,), (0.0,), (0.25,)], "v double")
    assert out == [0.5, 0.5, 0.25]


def test_half_even(spark):
    rows = [(5, 2), (7, 2), (1, 3), (2, 3), (0, 4), (125, 10), (135, 10)]
    out = _one(spark, X.half_even_div("n", "d"), rows, "n long, d long")
    assert out == [2, 4, 0, 1, 0, 12, 14]


def test_opposition_buckets(spark):
    rows = [("Arsenal", 20), ("X", 3), ("X", None), ("X", 14), ("X", 15)]
    out = _one(spark, X.opposition_bucket(), rows, "opponent_name string, final_position long")
    assert out == ["Top 6", "Top 6", "Mid Table", "Mid Table", "Bottom 6"]
    out = _one(spark, X.strength_ordinal(), [(6,), (14,), (15,), (None,)], "final_position long")
    assert out == [2, 1, 0, 0]


def test_signed_and_score_text(spark):
    rows = [(3, 1), (0, 0), (1, 4)]
    df = spark.createDataFrame(rows, "goals_for long, goals_against long")
    got = df.select(X.signed_text(F.col("goals_for") - F.col("goals_against")), X.score_text()).collect()
    assert [tuple(r) for r in got] == [("+2", "3-1"), ("+0", "0-0"), ("-3", "1-4")]
