"""Team-match long form (P9): one row per team per match.

The reference repeats ``CASE WHEN home_team_id = t THEN ... ELSE ... END``
pairs in almost every query.  Exploding each match into a home row and an
away row once (one scan, ``inline`` of a two-element array, no union) turns
those into plain ``groupBy('team_id', ...)`` aggregates for every team at
once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import expressions as X

LONG_COLUMNS = (
    "match_id", "season_id", "gameweek", "match_date", "status",
    "home_team_id", "away_team_id", "home_score", "away_score",
    "team_id", "opponent_id", "is_home", "goals_for", "goals_against",
)


def _side(team, opp, is_home: bool, gf, ga):
    # Both structs need identical field names and types for inline().
    return F.struct(
        F.col(team).alias("team_id"),
        F.col(opp).alias("opponent_id"),
        F.lit(is_home).alias("is_home"),
        F.col(gf).alias("goals_for"),
        F.col(ga).alias("goals_against"),
    )


def dealt(df: DataFrame, tasks: int | None, *keys) -> DataFrame:
    """``df`` dealt by ``keys`` over so many tasks, for the join on them that
    follows (None: left to Spark).  The session's shuffle partitions may be
    few, and what a task of a join holds grows with its rows."""
    return df if tasks is None else df.repartition(tasks, *keys)


def of_season(facts: DataFrame, matches: DataFrame, season_id=None, columns=("match_date",), *,
              tasks: int | None = None) -> DataFrame:
    """Fact rows with their match's ``season_id`` and ``columns``.

    Facts that carry ``season_id`` (the stored layout does, and is partitioned
    by it) are filtered on it before anything is joined, so the season prunes
    their files as well as those of ``matches``; the join is then on (season,
    match), or left out if they carry every wanted column.  ``tasks``: see
    ``dealt``."""
    has_season = "season_id" in facts.columns
    if has_season and season_id is not None:
        facts = facts.filter(F.col("season_id") == season_id)
    if has_season and set(columns) <= set(facts.columns):
        return facts
    m = matches if season_id is None else matches.filter(F.col("season_id") == season_id)
    m = m.select(F.col("id").alias("match_id"), "season_id", *columns)
    on = ["season_id", "match_id"] if has_season else ["match_id"]
    return dealt(facts.drop(*columns), tasks, *on).join(m, on)


def filter_matches(matches: DataFrame, *, team_id=None, season_id=None,
                   status: str | None = "finished") -> DataFrame:
    """Status, season and participant filters, applied before any
    explode so they reach the parquet scan."""
    m = matches
    if status is not None:
        m = m.filter(F.col("status") == status)
    if season_id is not None:
        m = m.filter(F.col("season_id") == season_id)
    if team_id is not None:
        m = m.filter((F.col("home_team_id") == team_id) | (F.col("away_team_id") == team_id))
    return m


def team_matches(matches: DataFrame, *, team_id=None, season_id=None,
                 status: str | None = "finished") -> DataFrame:
    """Long form of ``matches`` with venue, result and points columns."""
    m = filter_matches(matches, team_id=team_id, season_id=season_id, status=status)
    lf = m.select(
        F.col("id").alias("match_id"), "season_id", "gameweek", "match_date", "status",
        "home_team_id", "away_team_id", "home_score", "away_score",
        F.inline(F.array(
            _side("home_team_id", "away_team_id", True, "home_score", "away_score"),
            _side("away_team_id", "home_team_id", False, "away_score", "home_score"),
        )),
    )
    if team_id is not None:
        lf = lf.filter(F.col("team_id") == team_id)
    return lf.withColumns({
        "venue": X.venue("is_home"),
        "result": X.team_result(),
    })


def with_opponent_names(lf: DataFrame, teams: DataFrame) -> DataFrame:
    """J2 in long form: attach team and opponent names.

    No broadcast hint: ``teams`` is a dimension, and Spark's size check
    (``autoBroadcastJoinThreshold``, re-checked at run time by AQE) picks a
    broadcast join while it is small and a sort-merge join beyond that.
    """
    t = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"),
                     F.col("short_name").alias("team_short_name"))
    o = teams.select(F.col("id").alias("opponent_id"), F.col("name").alias("opponent_name"),
                     F.col("short_name").alias("opponent_short_name"))
    return lf.join(t, "team_id").join(o, "opponent_id")


def focal_team_id(teams: DataFrame, short_name: str) -> DataFrame:
    """One-row frame ``team_id`` from a short-name lookup, falling back to 1."""
    hit = teams.filter(F.col("short_name") == short_name).agg(F.min("id").alias("id"))
    return hit.select(F.coalesce(F.col("id"), F.lit(1).cast("bigint")).alias("focal_team_id"))


def current_season_id(seasons: DataFrame) -> DataFrame:
    """One-row frame ``season_id`` of the current season, falling back to 1."""
    hit = seasons.filter(F.col("is_current")).agg(F.min("id").alias("id"))
    return hit.select(F.coalesce(F.col("id"), F.lit(1).cast("bigint")).alias("current_season_id"))
