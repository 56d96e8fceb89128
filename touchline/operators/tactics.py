"""Tactical analyses: formations, possession, shots and shot zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import expressions as X
from touchline.operators.longform import of_season
from touchline.operators.stats import exact_median, pearson


def team_stat_rows(match_stats: DataFrame, matches: DataFrame, *, team_id=None, season_id=None,
                   status: str | None = "finished") -> DataFrame:
    """match_stats joined to its match, with goals for/against and the
    Win/Draw/Loss result seen from the stats row's team."""
    m = matches if status is None else matches.filter(F.col("status") == status)
    ms = match_stats if team_id is None else match_stats.filter(F.col("team_id") == team_id)
    j = of_season(ms, m, season_id, ("match_date", "status", "home_team_id", "away_team_id", "home_score", "away_score"))
    home = F.col("home_team_id") == F.col("team_id")
    return j.withColumns({
        "goals_for": F.when(home, F.col("home_score")).otherwise(F.col("away_score")),
        "goals_against": F.when(home, F.col("away_score")).otherwise(F.col("home_score")),
    }).withColumn("result", X.team_result(labels=X.RESULT_WORDS))


def formation_effectiveness(match_stats: DataFrame, matches: DataFrame, *, min_matches: int = 3,
                            team_id=None, season_id=None) -> DataFrame:
    """Per (season, team, formation) used at least ``min_matches`` times."""
    rows = team_stat_rows(match_stats, matches, team_id=team_id, season_id=season_id)
    rows = rows.filter(F.col("formation").isNotNull())
    agg = rows.groupBy("season_id", "team_id", "formation").agg(
        F.count(F.lit(1)).alias("matches_played"),
        X.count_when(F.col("goals_for") > F.col("goals_against")).alias("wins"),
        X.count_when(F.col("goals_for") == F.col("goals_against")).alias("draws"),
        X.mean_half_even("possession_percent", value_places=2).alias("avg_possession"),
        X.mean_half_even("shots_total").alias("avg_shots"),
        X.mean_half_even("shots_on_target").alias("avg_shots_on_target"),
        X.mean_half_even("pass_accuracy_percent", value_places=2).alias("avg_pass_accuracy"),
        X.mean_half_even("goals_for").alias("avg_goals_for"),
        X.mean_half_even("goals_against").alias("avg_goals_against"),
        X.mean_diff_half_even("goals_for", "goals_against").alias("goal_difference_per_game"),
    ).filter(F.col("matches_played") >= min_matches)
    return agg.withColumns({
        "win_rate": X.exact_ratio("wins", "matches_played", 100),
        "points_per_game": X.exact_ratio(F.col("wins") * 3 + F.col("draws"), "matches_played"),
    })


def possession_frame(match_stats: DataFrame, matches: DataFrame, *, team_id=None,
                     season_id=None) -> DataFrame:
    """Possession with result, goals, shots and pass accuracy."""
    rows = team_stat_rows(match_stats, matches, team_id=team_id, season_id=season_id)
    return rows.filter(F.col("possession_percent").isNotNull()).select(
        "season_id", "team_id", "match_id", "possession_percent", "result", "goals_for",
        "shots_total", "shots_on_target", "pass_accuracy_percent")


def possession_correlations(possession: DataFrame) -> DataFrame:
    """Pearson possession~goals and possession~shots per (season, team)."""
    return possession.groupBy("season_id", "team_id").agg(
        X.r6(pearson("possession_percent", "goals_for")).alias("possession_goals_correlation"),
        X.r6(pearson("possession_percent", "shots_total")).alias("possession_shots_correlation"),
    )


def possession_by_result(possession: DataFrame) -> DataFrame:
    """Per (season, team, result) mean and median possession, mean
    goals, shots and pass accuracy, rounded half-even to 2 places."""
    keys = ["season_id", "team_id", "result"]
    # Means are rounded exactly from integer sums (percentages carry two
    # decimals), so halfway cases do not depend on summation order.
    means = possession.groupBy(*keys).agg(
        X.mean_half_even("possession_percent", 2, 2).alias("possession_mean"),
        X.mean_half_even("goals_for", 2, 0).alias("goals_for_mean"),
        X.mean_half_even("shots_total", 2, 0).alias("shots_total_mean"),
        X.mean_half_even("pass_accuracy_percent", 2, 2).alias("pass_accuracy_mean"),
    )
    med = exact_median(possession.withColumn("_p", X.scaled_units("possession_percent", 2)),
                       keys, "_p", "_med2")
    med = med.select(*keys, (X.half_even_div(F.col("_med2") * 2, F.lit(2)).cast("double") / 100)
                     .alias("possession_median"))
    j = means.join(med, keys, "left")
    return j.select(*keys, "possession_mean", "possession_median", "goals_for_mean",
                    "shots_total_mean", "pass_accuracy_mean")


def shot_frame(shots: DataFrame, players: DataFrame, matches: DataFrame, teams: DataFrame, *,
               team_id=None, season_id=None) -> DataFrame:
    """A17 (J6): shots with player, match and both team names, plus zone."""
    s = shots if team_id is None else shots.filter(F.col("team_id") == team_id)
    s = of_season(s, matches, season_id, ("match_date", "home_team_id", "away_team_id"))
    p = players.select(F.col("id").alias("player_id"), F.col("name").alias("player_name"), "position")
    ht = teams.select(F.col("id").alias("home_team_id"), F.col("short_name").alias("home_team"))
    at = teams.select(F.col("id").alias("away_team_id"), F.col("short_name").alias("away_team"))
    j = s.join(p, "player_id").join(ht, "home_team_id").join(at, "away_team_id")
    return j.select(
        "season_id", "team_id", "match_id", "x_coordinate", "y_coordinate", "shot_type", "situation",
        "is_goal", "is_on_target", "xg_value", "player_name", "position", "match_date",
        "home_team", "away_team", X.shot_zone().alias("shot_zone"))


def season_shots(shots: DataFrame, matches: DataFrame, *, team_id=None, season_id=None) -> DataFrame:
    """Input of A18 / A19: shots with season and zone.  Names play no part in
    totals, so nothing but the season is looked up, and not even that if the
    shots carry it."""
    s = shots if team_id is None else shots.filter(F.col("team_id") == team_id)
    return of_season(s, matches, season_id, ()).withColumn("shot_zone", X.shot_zone())


def shot_totals(shot_rows: DataFrame) -> DataFrame:
    """Shots, goals, accuracy %, conversion %, mean xG per (season, team)."""
    g = F.col("is_goal").cast("int")
    t = F.col("is_on_target").cast("int")
    return shot_rows.groupBy("season_id", "team_id").agg(
        F.count(F.lit(1)).alias("total_shots"),
        F.sum(g).cast("bigint").alias("goals_scored"),
        X.mean_half_even(t * 100).alias("shot_accuracy"),
        X.mean_half_even(g * 100).alias("conversion_rate"),
        X.mean_half_even("xg_value", value_places=3).alias("avg_xg_per_shot"),
    )


def shot_zones(shot_rows: DataFrame) -> DataFrame:
    """Per (season, team, zone) shot count, goals, conversion,
    on-target rate and mean xG, rounded half-even to 3 places."""
    g = F.col("is_goal").cast("int")
    return shot_rows.groupBy("season_id", "team_id", "shot_zone").agg(
        F.count("is_goal").alias("shots"),
        F.sum(g).cast("bigint").alias("goals"),
        X.mean_half_even(g, 3, 0).alias("conversion_rate"),
        X.mean_half_even(F.col("is_on_target").cast("int"), 3, 0).alias("on_target_rate"),
        X.mean_half_even("xg_value", 3, 3).alias("avg_xg"),
    )
