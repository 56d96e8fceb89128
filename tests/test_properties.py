"""Property checks on whole-table results (sf0.001)."""

from pyspark.sql import functions as F

from touchline.operators import league, performance
from touchline.operators.longform import team_matches


def test_league_table_invariants(small):
    t = league.league_table(small.matches)
    bad = t.filter((F.col("points") != F.col("wins") * 3 + F.col("draws"))
                   | (F.col("matches_played") != F.col("wins") + F.col("draws") + F.col("losses")))
    assert bad.count() == 0
    # every (season, gameweek) ranks all teams of the season
    per = t.groupBy("season_id", "gameweek").agg(F.count("*").alias("n"), F.min("position").alias("p"))
    assert per.filter(F.col("p") != 1).count() == 0
    # the last snapshot equals the season totals
    last = league.opposition_categories(t)
    assert last.count() == t.select("season_id", "team_id").distinct().count()


def test_wins_equal_losses(small):
    rec = performance.home_away_record(small.matches)
    tot = rec.agg(F.sum("wins").alias("w"), F.sum("losses").alias("l"), F.sum("draws").alias("d")).first()
    assert tot["w"] == tot["l"]
    assert tot["d"] % 2 == 0


def test_long_form_doubles_matches(small):
    m = small.matches.filter(F.col("status") == "finished").count()
    assert team_matches(small.matches).count() == 2 * m


def test_form_string_length(small):
    f = performance.form_summary(small.matches, n=10)
    bad = f.filter(F.length("form_string") != F.col("matches_played"))
    assert bad.count() == 0
    assert f.filter(F.col("matches_played") > 10).count() == 0
