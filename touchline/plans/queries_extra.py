"""Registered queries for ordering (O1/O3, O4), league snapshots, parameter
binding (S2) and the second named view (S13)."""

from __future__ import annotations

from touchline.operators import league as lg
from touchline.operators import players as pl
from touchline.operators import tactics as tc
from touchline.plans import sqlx
from touchline.plans.catalog import AS_OF, FOCAL_SHORT_NAME, LF_SQL, ORACLES, register, tables, with_views
from touchline.plans.queries_players import PLAYER_VIEWS, PR_SQL, _a6_sql

DISPLAY_COLUMNS = ["season_id", "team_id", "player_id", "name", "position", "appearances",
                   "total_minutes", "goals", "assists", "goal_contributions", "goals_per_90",
                   "assists_per_90", "avg_rating", "performer_rank", "not_a_column"]


@register("o1_top_performers_ranked", """WITH ranked AS (
SELECT *, ROW_NUMBER() OVER (PARTITION BY season_id, team_id
                             ORDER BY goal_contributions DESC, avg_rating DESC NULLS FIRST, player_id)
          AS performer_rank
FROM (""" + _a6_sql(None) + """) t)
SELECT season_id, team_id, player_id, name, position, appearances, total_minutes, goals, assists,
  goal_contributions, goals_per_90, assists_per_90, avg_rating, performer_rank
FROM ranked WHERE performer_rank <= 10""")
def o1_top_performers_ranked(spark, sf_dir):
    t = tables(spark, sf_dir)
    top = pl.top_performers(t.players, t.player_match_stats, t.matches, min_minutes=180, tasks=t.tasks())
    return pl.select_existing(pl.rank_top_performers(top, k=10), DISPLAY_COLUMNS)


def _ordered_sql(oracle: str, by: str) -> str:
    return f"SELECT *, ROW_NUMBER() OVER (PARTITION BY season_id, team_id ORDER BY {by}) AS display_rank FROM ({ORACLES[oracle]}) t"


@register("o4_top_performers_ordered", _ordered_sql("a6_top_performers", "goal_contributions DESC, avg_rating DESC NULLS FIRST, player_id"))
def o4_top_performers_ordered(spark, sf_dir):
    t = tables(spark, sf_dir)
    return pl.in_display_order(pl.top_performers(t.players, t.player_match_stats, t.matches, tasks=t.tasks()), "top_performers")


@register("o4_unsung_heroes_ordered", _ordered_sql("a9_unsung_heroes", "defensive_actions_per_90 DESC, avg_rating DESC NULLS FIRST, player_id"))
def o4_unsung_heroes_ordered(spark, sf_dir):
    t = tables(spark, sf_dir)
    return pl.in_display_order(pl.unsung_heroes(t.players, t.player_match_stats, t.matches, tasks=t.tasks()), "unsung_heroes")


@register("o4_formations_ordered", _ordered_sql("a12_formations", "wins DESC, avg_goals_for DESC NULLS FIRST, formation"))
def o4_formations_ordered(spark, sf_dir):
    t = tables(spark, sf_dir)
    return pl.in_display_order(tc.formation_effectiveness(t.match_stats, t.matches), "formations")


@register("o4_view_ordered", _ordered_sql("a13_top_performers_view", "goals DESC, assists DESC, player_id"))
def o4_view_ordered(spark, sf_dir):
    t = tables(spark, sf_dir)
    return pl.in_display_order(pl.top_performers_view(t.players, t.player_match_stats, t.matches, tasks=t.tasks()), "top_performers_view")


@register("a23_league_table_snapshots", f"""
SELECT ROW_NUMBER() OVER (ORDER BY season_id, gameweek, team_id) AS id, *, TIMESTAMP '{AS_OF}' AS snapshot_date
FROM ({ORACLES["a23_league_table"]}) t""")
def a23_league_table_snapshots(spark, sf_dir):
    table = lg.league_table(tables(spark, sf_dir).matches)
    return lg.snapshot_rows(table, snapshot_date=AS_OF)


# A query text with named parameters, bound by Spark.
S2_TEXT = """
WITH sides AS (
  SELECT 'Home' AS venue_type, home_score AS scored, away_score AS conceded FROM {matches}
  WHERE home_team_id = :team AND season_id = :season AND status = 'finished'
  UNION ALL
  SELECT 'Away', away_score, home_score FROM {matches}
  WHERE away_team_id = :team AND season_id = :season AND status = 'finished')
SELECT venue_type, COUNT(*) AS matches_played, COUNT_IF(scored > conceded) AS wins,
  COUNT_IF(scored = conceded) AS draws, COUNT_IF(scored < conceded) AS losses,
  SUM(scored) AS goals_for, SUM(conceded) AS goals_against
FROM sides GROUP BY venue_type"""


def run_sql(spark, text: str, frames: dict, **params):
    """S1 + S2: run SQL text over DataFrames with named parameters bound by
    Spark (no string interpolation of values)."""
    return spark.sql(text, args=params, **frames)


@register("s2_parameterized_home_away", with_views("matches", extra=LF_SQL) + """
SELECT list_extract(['Away', 'Home'], 1 + is_home::INTEGER) AS venue_type, COUNT(*) AS matches_played,
  COUNT(*) FILTER (sign(goals_for - goals_against) = 1) AS wins,
  COUNT(*) FILTER (sign(goals_for - goals_against) = 0) AS draws,
  COUNT(*) FILTER (sign(goals_for - goals_against) = -1) AS losses,
  SUM(goals_for)::BIGINT AS goals_for, SUM(goals_against)::BIGINT AS goals_against
FROM lf WHERE team_id = 9 AND season_id = 1997 GROUP BY is_home""")
def s2_parameterized_home_away(spark, sf_dir):
    t = tables(spark, sf_dir)
    return run_sql(spark, S2_TEXT, {"matches": t.matches}, team=9, season=1997)


@register("s13_united_top_performers_view", with_views(
    "teams", "seasons", *PLAYER_VIEWS, extra=PR_SQL) + f"""
SELECT pr.name, pr.position, COUNT(*) AS matches_played,
  {', '.join(f"SUM({c})::BIGINT AS {c.replace('minutes_played', 'total_minutes')}" for c in
             ("minutes_played", "goals", "assists", "key_passes", "tackles", "interceptions"))},
  {sqlx.mean('rating', 6, 1)} AS avg_rating
FROM pr JOIN teams t ON t.id = player_team_id AND t.short_name = '{FOCAL_SHORT_NAME}'
        JOIN seasons s ON s.id = season_id AND s.is_current
GROUP BY player_id, pr.name, pr.position""")
def s13_united_top_performers_view(spark, sf_dir):
    from touchline.operators.longform import current_season_id, focal_team_id
    t = tables(spark, sf_dir)
    team = focal_team_id(t.teams, FOCAL_SHORT_NAME).scalar()
    season = current_season_id(t.seasons).scalar()
    view = pl.top_performers_view(t.players, t.player_match_stats, t.matches, team_id=team,
                                  season_id=season)
    view = view.select("name", "position", "matches_played", "total_minutes", "goals", "assists",
                       "key_passes", "tackles", "interceptions", "avg_rating")
    view.createOrReplaceTempView("united_top_performers")
    return view
