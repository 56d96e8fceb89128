"""Player analyses: top performers, unsung heroes, player form, the
top-performers view and key players.

All are grouped aggregates over ``player_match_stats`` joined to the player
and match dimensions.  Sums and counts combine map-side, so a player (or
team) holding a large share of the rows does not concentrate work in one
task.  Player analyses filter on season and minutes but not on match status,
as the reference does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import expressions as X
from touchline.operators.longform import dealt, of_season
from touchline.operators.sequence import time_chunk, last_n


MATCH_SIDE_COLUMNS = ("home_team_id", "away_team_id", "home_score", "away_score")


def player_rows(players: DataFrame, stats: DataFrame, matches: DataFrame, *, team_id=None,
                season_id=None, positions=None, played_only: bool = True,
                need_sides: bool = False, tasks: int | None = None) -> DataFrame:
    """Players -> player_match_stats -> matches with the common filters
    (P18-P20).  Columns: all stats plus player name/position/squad number,
    the player's team, season and match date (and both sides of the match
    when ``need_sides``).

    When the stats carry ``season_id`` and ``match_date`` (the stored layout
    denormalizes them at ingest) and the sides are not needed, the join with
    ``matches`` -- the largest join of the player analyses -- is skipped.
    ``tasks``: tasks of the joins of all rows (``longform.dealt``)."""
    p = players.select(F.col("id").alias("player_id"), "name", "position", "squad_number",
                       F.col("team_id").alias("player_team_id"), "is_active")
    if team_id is not None:
        p = p.filter(F.col("player_team_id") == team_id)
    if positions:
        p = p.filter(F.col("position").isin(*positions))
    s = stats.filter(F.col("minutes_played") > 0) if played_only else stats
    wanted = ("match_date", *MATCH_SIDE_COLUMNS) if need_sides else ("match_date",)
    return dealt(of_season(s, matches, season_id, wanted, tasks=tasks), tasks, "player_id").join(p, "player_id")


def _player_keys():
    return ["season_id", F.col("player_team_id").alias("team_id"), "player_id", "name", "position"]


def top_performers(players: DataFrame, stats: DataFrame, matches: DataFrame, *, position=None,
                   min_minutes: int = 180, team_id=None, season_id=None, tasks: int | None = None) -> DataFrame:
    """Totals, guarded accuracy ratios and per-90 rates per player,
    keeping players with at least ``min_minutes``; optional position filter."""
    rows = player_rows(players, stats, matches, team_id=team_id, season_id=season_id,
                       positions=[position] if position else None, tasks=tasks)
    mins = F.sum("minutes_played")
    agg = rows.groupBy(*_player_keys(), "squad_number").agg(
        F.count("match_id").alias("appearances"),
        mins.alias("total_minutes"),
        X.mean_half_even("minutes_played").alias("avg_minutes_per_game"),
        F.sum("goals").alias("goals"),
        F.sum("assists").alias("assists"),
        F.sum(F.col("goals") + F.col("assists")).alias("goal_contributions"),
        F.sum("key_passes").alias("key_passes"),
        F.sum("shots_total").alias("shots"),
        F.sum("shots_on_target").alias("shots_on_target"),
        F.sum("passes_total").alias("total_passes"),
        F.sum("passes_accurate").alias("accurate_passes"),
        F.sum("tackles").alias("tackles"),
        F.sum("interceptions").alias("interceptions"),
        F.sum("clearances").alias("clearances"),
        X.mean_half_even("rating", value_places=1).alias("avg_rating"),
    ).filter(F.col("total_minutes") >= min_minutes)
    return agg.withColumns({
        "shot_accuracy": X.guarded_ratio("shots_on_target", "shots", 100),
        "pass_accuracy": X.guarded_ratio("accurate_passes", "total_passes", 100),
        "goals_per_90": X.guarded_ratio("goals", "total_minutes", 90),
        "assists_per_90": X.guarded_ratio("assists", "total_minutes", 90),
        "key_passes_per_90": X.guarded_ratio("key_passes", "total_minutes", 90),
    })


def unsung_heroes(players: DataFrame, stats: DataFrame, matches: DataFrame, *,
                  min_minutes: int = 450, team_id=None, season_id=None, tasks: int | None = None) -> DataFrame:
    """A9 + A10: defensive output of DEF/MID/GK players with at least
    ``min_minutes``; clean-sheet share of appearances for DEF and GK."""
    rows = player_rows(players, stats, matches, team_id=team_id, season_id=season_id,
                       positions=["DEF", "MID", "GK"], need_sides=True, tasks=tasks)
    team = F.col("player_team_id")
    clean = ((F.col("home_team_id") == team) & (F.col("away_score") == 0)) | (
        (F.col("away_team_id") == team) & (F.col("home_score") == 0))
    agg = rows.groupBy(*_player_keys()).agg(
        F.count("match_id").alias("appearances"),
        F.sum("minutes_played").alias("total_minutes"),
        F.sum("tackles").alias("tackles"),
        F.sum("interceptions").alias("interceptions"),
        F.sum("clearances").alias("clearances"),
        F.sum(F.col("tackles") + F.col("interceptions")).alias("defensive_actions"),
        X.mean_half_even("rating", value_places=1).alias("avg_rating"),
        X.mean_half_even(F.when(clean, F.lit(100)).otherwise(F.lit(0))).alias("_clean"),
    ).filter(F.col("total_minutes") >= min_minutes)
    return agg.withColumns({
        "defensive_actions_per_90": X.guarded_ratio(F.col("tackles") + F.col("interceptions"),
                                                    "total_minutes", 90),
        "clean_sheet_percentage": F.when(F.col("position").isin("DEF", "GK"), F.col("_clean")),
    }).drop("_clean")


def player_form(players: DataFrame, stats: DataFrame, matches: DataFrame, *, n: int = 5,
                player_id=None, team_id=None, season_id=None, tasks: int | None = None) -> DataFrame:
    """Over each player's newest ``n`` appearances in a season: mean
    rating, goals, assists, mean passes and pooled pass accuracy.  Grouped by
    player id (names are not unique)."""
    rows = player_rows(players, stats, matches, team_id=team_id, season_id=season_id, tasks=tasks)
    if player_id is not None:
        rows = rows.filter(F.col("player_id") == player_id)
    kept = last_n(rows, ["season_id", "player_id"], ["match_date", "match_id"],
                  chunk=time_chunk(), n=n)
    agg = kept.groupBy(*_player_keys()).agg(
        F.count(F.lit(1)).alias("matches"),
        X.mean_half_even("rating", value_places=1).alias("avg_rating"),
        F.sum("goals").alias("total_goals"),
        F.sum("assists").alias("total_assists"),
        X.mean_half_even("passes_total").alias("avg_passes_per_game"),
        F.sum("passes_accurate").alias("_acc"),
        F.sum("passes_total").alias("_tot"),
    )
    return agg.withColumns({
        "avg_pass_accuracy": X.guarded_ratio("_acc", "_tot", 100),
    }).drop("_acc", "_tot")


def top_performers_view(players: DataFrame, stats: DataFrame, matches: DataFrame, *,
                        team_id=None, season_id=None, tasks: int | None = None) -> DataFrame:
    """A13 (view ``united_top_performers``)."""
    rows = player_rows(players, stats, matches, team_id=team_id, season_id=season_id, tasks=tasks)
    agg = rows.groupBy(*_player_keys()).agg(
        F.count("match_id").alias("matches_played"),
        F.sum("minutes_played").alias("total_minutes"),
        F.sum("goals").alias("goals"),
        F.sum("assists").alias("assists"),
        F.sum("key_passes").alias("key_passes"),
        F.sum("tackles").alias("tackles"),
        F.sum("interceptions").alias("interceptions"),
        X.mean_half_even("rating", value_places=1).alias("avg_rating"),
    )
    return agg


def key_players(players: DataFrame, stats: DataFrame, *, team_id=None, min_appearances: int = 5,
                k: int = 15) -> DataFrame:
    """Active players with at least ``min_appearances`` rows, the top
    ``k`` of each team by total minutes (ties by id).  The ranking window
    runs over one row per player, whose count is bounded by squad sizes."""
    p = players.filter(F.col("is_active")).select(
        F.col("id").alias("player_id"), "name", "team_id")
    if team_id is not None:
        p = p.filter(F.col("team_id") == team_id)
    # Aggregate first (map-side combine), then join the player dimension.
    agg = stats.groupBy("player_id").agg(
        F.count("match_id").alias("appearances"),
        F.sum("minutes_played").alias("total_minutes"),
    ).filter(F.col("appearances") >= min_appearances).join(p, "player_id")
    w = Window.partitionBy("team_id").orderBy(F.desc("total_minutes"), "player_id")
    return agg.withColumn("minutes_rank", F.row_number().over(w).cast("bigint")).filter(
        F.col("minutes_rank") <= k)


def rank_top_performers(performers: DataFrame, *, k: int | None = 10) -> DataFrame:
    """O1 + O3: rank players within (season, team) by goal contributions,
    then average rating with NULLs first (PostgreSQL's DESC order), then id;
    keep the top ``k``.  The window runs over aggregated player rows, whose
    number per team is bounded by squad size."""
    w = Window.partitionBy("season_id", "team_id").orderBy(
        F.desc("goal_contributions"), F.desc_nulls_first("avg_rating"), "player_id")
    out = performers.withColumn("performer_rank", F.row_number().over(w).cast("bigint"))
    return out if k is None else out.filter(F.col("performer_rank") <= k)


# The orders in which the analyses are shown (fixed values); ties go by the last column.
DISPLAY_ORDERS = {
    "top_performers": (("goal_contributions", "avg_rating"), "player_id"),
    "unsung_heroes": (("defensive_actions_per_90", "avg_rating"), "player_id"),
    "formations": (("wins", "avg_goals_for"), "formation"),
    "top_performers_view": (("goals", "assists"), "player_id"),
}


def in_display_order(df: DataFrame, kind: str) -> DataFrame:
    """The result of an analysis in its display order, with the position
    of each row among its season's and team's as ``display_rank``.  NULLs come
    first in descending order, as in the reference's database."""
    down, tie = DISPLAY_ORDERS[kind]
    w = Window.partitionBy("season_id", "team_id").orderBy(*[F.desc_nulls_first(c) for c in down], tie)
    return df.withColumn("display_rank", F.row_number().over(w).cast("bigint")).orderBy("season_id", "team_id", "display_rank")


def select_existing(df: DataFrame, wanted) -> DataFrame:
    """Keep the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])
