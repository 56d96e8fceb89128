"""Declared schemas of the sport tables, column defaults and seed rows.

Spark does not enforce keys or NOT NULL; those become the Q1/Q2 checks.
Defaults are applied at ingest with ``apply_defaults``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, I, S, B, D = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.DoubleType()
TS, DT = T.TimestampNTZType(), T.DateType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


TEAMS = _schema(("id", L, False), ("name", S, False), ("short_name", S, True),
                ("founded_year", I, True), ("stadium", S, True), ("created_at", TS, True))
SEASONS = _schema(("id", L, False), ("season_name", S, False), ("start_date", DT, True),
                  ("end_date", DT, True), ("is_current", B, True))
MATCHES = _schema(("id", L, False), ("season_id", L, True), ("gameweek", L, True),
                  ("match_date", TS, True), ("home_team_id", L, True), ("away_team_id", L, True),
                  ("home_score", L, True), ("away_score", L, True), ("venue", S, True),
                  ("referee", S, True), ("attendance", I, True), ("status", S, True),
                  ("created_at", TS, True), ("updated_at", TS, True))
MATCH_STATS = _schema(("id", L, True), ("match_id", L, True), ("team_id", L, True), ("is_home", B, True),
                      ("possession_percent", T.DecimalType(5, 2), True), ("shots_total", I, True),
                      ("shots_on_target", I, True), ("shots_off_target", I, True),
                      ("shots_blocked", I, True), ("corners", I, True), ("fouls", I, True),
                      ("yellow_cards", I, True), ("red_cards", I, True), ("passes_total", I, True),
                      ("passes_accurate", I, True), ("pass_accuracy_percent", T.DecimalType(5, 2), True),
                      ("formation", S, True), ("created_at", TS, True))
PLAYERS = _schema(("id", L, False), ("name", S, False), ("position", S, True), ("nationality", S, True),
                  ("age", I, True), ("squad_number", L, True), ("team_id", L, True),
                  ("market_value_millions", T.DecimalType(10, 2), True), ("contract_until", DT, True),
                  ("is_active", B, True), ("created_at", TS, True))
PLAYER_MATCH_STATS = _schema(
    ("id", L, True), ("match_id", L, True), ("player_id", L, True), ("team_id", L, True),
    ("started", B, True), *[(c, L, True) for c in (
        "minutes_played", "goals", "assists", "yellow_cards", "red_cards", "shots_total",
        "shots_on_target", "key_passes", "passes_total", "passes_accurate", "tackles",
        "interceptions", "clearances")],
    ("rating", T.DecimalType(3, 1), True), ("created_at", TS, True))
SHOTS = _schema(("id", L, True), ("match_id", L, True), ("player_id", L, True), ("team_id", L, True),
                ("minute", L, True), ("x_coordinate", T.DecimalType(5, 2), True),
                ("y_coordinate", T.DecimalType(5, 2), True), ("shot_type", S, True), ("body_part", S, True),
                ("situation", S, True), ("is_goal", B, True), ("is_on_target", B, True),
                ("is_blocked", B, True), ("xg_value", T.DecimalType(4, 3), True), ("created_at", TS, True))
LEAGUE_TABLE_SNAPSHOTS = _schema(
    ("id", L, True), ("season_id", L, True), ("gameweek", L, True), ("team_id", L, True),
    *[(c, L, True) for c in ("position", "matches_played", "wins", "draws", "losses", "goals_for",
                             "goals_against", "goal_difference", "points")],
    ("form", S, True), ("snapshot_date", TS, True))
OPPOSITION_CATEGORIES = _schema(("id", L, True), ("team_id", L, True), ("season_id", L, True),
                                ("category", S, True), ("final_position", L, True),
                                ("updated_at", TS, True))
DATA_COLLECTION_LOG = _schema(("id", L, True), ("source", S, True), ("data_type", S, True),
                              ("records_collected", L, True), ("success", B, True),
                              ("error_message", S, True), ("execution_time_seconds", D, True),
                              ("collected_at", TS, True))

SCHEMAS = {
    "teams": TEAMS, "seasons": SEASONS, "matches": MATCHES, "match_stats": MATCH_STATS,
    "players": PLAYERS, "player_match_stats": PLAYER_MATCH_STATS, "shots": SHOTS,
    "league_table_snapshots": LEAGUE_TABLE_SNAPSHOTS, "opposition_categories": OPPOSITION_CATEGORIES,
    "data_collection_log": DATA_COLLECTION_LOG,
}

# Column defaults of the declared schema (fixed values).
DEFAULTS = {
    "seasons": {"is_current": False},
    "matches": {"status": "scheduled"},
    "players": {"is_active": True},
    "player_match_stats": {c: 0 for c in (
        "minutes_played", "goals", "assists", "yellow_cards", "red_cards", "shots_total",
        "shots_on_target", "key_passes", "passes_total", "passes_accurate", "tackles",
        "interceptions", "clearances")} | {"started": False},
    "shots": {"is_goal": False, "is_on_target": False, "is_blocked": False},
}

# Seed rows of the declared schema (fixed values).
SEED_SEASON = (1, "2025/26", _dt.date(2025, 8, 16), _dt.date(2026, 5, 24), True)
SEED_TEAM = (1, "Manchester United", "MUN", 1878, "Old Trafford", None)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the declared columns in declared order, casting present ones
    and adding absent ones as typed NULLs."""
    schema = SCHEMAS[table]
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """``coalesce(col, default)`` for the declared defaults of ``table``."""
    d = {k: v for k, v in DEFAULTS.get(table, {}).items() if k in df.columns}
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in d.items()}) if d else df


def seed_frames(spark: SparkSession) -> dict[str, DataFrame]:
    """The seed rows (one season, one team) as conformed DataFrames."""
    seasons = spark.createDataFrame([SEED_SEASON], SEASONS)
    teams = spark.createDataFrame([SEED_TEAM], TEAMS)
    return {"seasons": seasons, "teams": teams}
