"""Team performance analyses: venue record, opposition strength, form,
season KPIs, weekly results and upcoming fixtures.

Every function works for all teams and seasons at once (``team_id`` /
``season_id`` = None) or for one team / season; filters are applied to the
match table before the long-form explode, so they reach the parquet scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import expressions as X
from touchline.operators.longform import team_matches, with_opponent_names
from touchline.operators.sequence import time_chunk, last_n


def _record_aggs(with_losses: bool = True):
    gf, ga = F.col("goals_for"), F.col("goals_against")
    aggs = [
        F.count(F.lit(1)).alias("matches_played"),
        X.count_when(gf > ga).alias("wins"),
        X.count_when(gf == ga).alias("draws"),
    ]
    if with_losses:
        aggs.append(X.count_when(gf < ga).alias("losses"))
    return aggs


def home_away_record(matches: DataFrame, *, team_id=None, season_id=None) -> DataFrame:
    """A1 + A2: per (season, team, venue) record with derived rates."""
    lf = team_matches(matches, team_id=team_id, season_id=season_id)
    agg = lf.groupBy("season_id", "team_id", "venue").agg(
        *_record_aggs(),
        F.sum("goals_for").alias("goals_for"),
        F.sum("goals_against").alias("goals_against"),
    ).withColumnRenamed("venue", "venue_type")
    return agg.withColumns({
        "win_rate": X.exact_ratio("wins", "matches_played", 100),
        "points": X.points(F.col("wins"), F.col("draws")),
        "points_per_game": X.exact_ratio(F.col("wins") * 3 + F.col("draws"), "matches_played"),
        "goal_difference": F.col("goals_for") - F.col("goals_against"),
    })


def record_by_opposition(matches: DataFrame, teams: DataFrame, categories: DataFrame, *,
                         team_id=None, season_id=None, top6=X.TOP6_NAMES) -> DataFrame:
    """A3: record per opposition bucket (P11), bucketed by the opponent's
    name and then its final position in the same season (J3)."""
    lf = with_opponent_names(team_matches(matches, team_id=team_id, season_id=season_id), teams)
    cats = categories.select(F.col("team_id").alias("opponent_id"), "season_id", "final_position")
    j = lf.join(cats, ["opponent_id", "season_id"], "left")
    j = j.withColumn("opposition_strength", X.opposition_bucket("opponent_name", "final_position", top6))
    agg = j.groupBy("season_id", "team_id", "opposition_strength").agg(
        *_record_aggs(with_losses=False),
        X.mean_half_even("goals_for").alias("avg_goals_for"),
        X.mean_half_even("goals_against").alias("avg_goals_against"),
    )
    return agg.withColumns({
        "win_rate": X.exact_ratio("wins", "matches_played", 100),
        "points_per_game": X.exact_ratio(F.col("wins") * 3 + F.col("draws"), "matches_played"),
    })


def recent_matches(matches: DataFrame, teams: DataFrame, *, n: int = 10, team_id=None,
                   season_id=None) -> DataFrame:
    """A5 (+ W4, W5, P10, F3): the newest ``n`` finished matches of each
    (season, team), with opponent, score text and display date."""
    lf = team_matches(matches, team_id=team_id, season_id=season_id)
    kept = last_n(lf, ["season_id", "team_id"], ["match_date", "match_id"],
                  chunk=time_chunk(), n=n)
    named = with_opponent_names(kept, teams)
    return named.select(
        "season_id", "team_id", "match_id", "match_date",
        F.when(F.col("is_home"), F.col("team_short_name")).otherwise(F.col("opponent_short_name"))
        .alias("home_team"),
        F.when(F.col("is_home"), F.col("opponent_short_name")).otherwise(F.col("team_short_name"))
        .alias("away_team"),
        "home_score", "away_score",
        F.col("venue"), "result", "goals_for", "goals_against",
        F.col("opponent_short_name").alias("opponent"),
        X.score_text().alias("score"),
        F.date_format("match_date", "dd/MM/yyyy").alias("match_day"),
        "recency", "form_position",
    )


def form_summary(matches: DataFrame, *, n: int = 10, team_id=None, season_id=None) -> DataFrame:
    """A4: W/D/L counts, points, goals and the newest-first form string over
    the newest ``n`` finished matches of each (season, team)."""
    lf = team_matches(matches, team_id=team_id, season_id=season_id)
    kept = last_n(lf, ["season_id", "team_id"], ["match_date", "match_id"],
                  chunk=time_chunk(), n=n)
    # At most n rows per group reach this aggregate.
    agg = kept.groupBy("season_id", "team_id").agg(
        F.expr("listagg(result, '') WITHIN GROUP (ORDER BY recency)").alias("form_string"),
        F.count(F.lit(1)).alias("matches_played"),
        X.count_when(F.col("result") == "W").alias("wins"),
        X.count_when(F.col("result") == "D").alias("draws"),
        X.count_when(F.col("result") == "L").alias("losses"),
        F.sum("goals_for").alias("goals_for"),
        F.sum("goals_against").alias("goals_against"),
    )
    return agg.withColumns({
        "win_rate": X.exact_ratio("wins", "matches_played", 100),
        "points": X.points(F.col("wins"), F.col("draws")),
        "points_per_game": X.exact_ratio(F.col("wins") * 3 + F.col("draws"), "matches_played"),
        "goal_difference": F.col("goals_for") - F.col("goals_against"),
        "goal_difference_text": X.signed_text(F.col("goals_for") - F.col("goals_against")),
    })


def season_kpis(matches: DataFrame, *, team_id=None, season_id=None) -> DataFrame:
    """Total matches, wins, goals and win rate per (season, team)."""
    lf = team_matches(matches, team_id=team_id, season_id=season_id)
    agg = lf.groupBy("season_id", "team_id").agg(
        F.count(F.lit(1)).alias("total_matches"),
        X.count_when(F.col("goals_for") > F.col("goals_against")).alias("total_wins"),
        F.sum("goals_for").alias("total_goals"),
    )
    return agg.withColumn("win_rate", X.exact_ratio("total_wins", "total_matches", 100))


def _as_of_col(as_of) -> F.Column:
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        as_of = as_of.isoformat(sep=" ") if isinstance(as_of, _dt.datetime) else as_of.isoformat()
    return F.lit(as_of).cast("timestamp_ntz")


def weekly_results(matches: DataFrame, teams: DataFrame, *, as_of, days: int = 7,
                   team_id=None) -> DataFrame:
    """Finished matches in ``[as_of - days, as_of]`` per team, with team
    names, score, venue and Win/Draw/Loss (F4 ISO week, F3 date text)."""
    asof = _as_of_col(as_of)
    m = matches.filter((F.col("match_date") >= asof - F.make_interval(days=F.lit(days)))
                       & (F.col("match_date") <= asof))
    lf = with_opponent_names(team_matches(m, team_id=team_id), teams)
    return lf.select(
        "team_id", "match_id", "match_date",
        F.when(F.col("is_home"), F.col("team_name")).otherwise(F.col("opponent_name")).alias("home_team"),
        F.when(F.col("is_home"), F.col("opponent_name")).otherwise(F.col("team_name")).alias("away_team"),
        "home_score", "away_score", "venue",
        X.team_result(labels=X.RESULT_WORDS).alias("result"),
        F.date_format("match_date", "yyyy-MM-dd").alias("report_day"),
        F.weekofyear("match_date").alias("week_number"),
    )


def upcoming_fixtures(matches: DataFrame, teams: DataFrame, *, as_of, team_id=None) -> DataFrame:
    """Scheduled matches on or after ``as_of`` for each team."""
    asof = _as_of_col(as_of)
    m = matches.filter(F.col("match_date") >= asof)
    lf = with_opponent_names(team_matches(m, team_id=team_id, status="scheduled"), teams)
    return lf.select(
        "team_id", "match_id", "season_id", "gameweek", "match_date", "venue",
        F.col("opponent_id"), F.col("opponent_name").alias("opponent"),
    )
