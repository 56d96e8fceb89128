"""Registered team-performance queries (A1-A5, A20, A21, A25, S13 view)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import expressions as X
from touchline.operators import performance as perf
from touchline.operators.longform import current_season_id, focal_team_id, team_matches
from touchline.plans import sqlx
from touchline.plans.catalog import AS_OF, FOCAL_SHORT_NAME, LF_SQL, register, tables, with_views

RESULT_SQL = ("CASE WHEN goals_for > goals_against THEN 'W' "
              "WHEN goals_for = goals_against THEN 'D' ELSE 'L' END")
TOP6_SQL = ", ".join(f"'{n}'" for n in X.TOP6_NAMES)


def _cnt(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


# ---------------------------------------------------------------- A1 + A2
@register("a1_home_away", with_views("matches", extra=LF_SQL) + f"""
SELECT *, {sqlx.ratio('wins', 'matches_played', 100)} AS win_rate, wins * 3 + draws AS points,
       {sqlx.ratio('wins * 3 + draws', 'matches_played')} AS points_per_game,
       goals_for - goals_against AS goal_difference
FROM (SELECT season_id, team_id, CASE WHEN is_home THEN 'Home' ELSE 'Away' END AS venue_type,
        COUNT(*) AS matches_played, {_cnt('goals_for > goals_against')} AS wins,
        {_cnt('goals_for = goals_against')} AS draws, {_cnt('goals_for < goals_against')} AS losses,
        CAST(SUM(goals_for) AS BIGINT) AS goals_for, CAST(SUM(goals_against) AS BIGINT) AS goals_against
      FROM lf GROUP BY 1, 2, 3) a""")
def a1_home_away(spark, sf_dir):
    t = tables(spark, sf_dir)
    return perf.home_away_record(t.matches)


# ----------------------------------------------- S13 view, P1/P2 lookups
@register("s13_united_home_away_view", with_views("teams", "seasons", "matches", extra=LF_SQL) + f"""
SELECT CASE WHEN is_home THEN 'Home' ELSE 'Away' END AS venue_type, COUNT(*) AS matches_played,
  {_cnt('goals_for > goals_against')} AS wins, {_cnt('goals_for = goals_against')} AS draws,
  {_cnt('goals_for < goals_against')} AS losses
FROM lf JOIN teams ON teams.id = team_id AND short_name = '{FOCAL_SHORT_NAME}'
        JOIN seasons ON seasons.id = season_id AND is_current
GROUP BY is_home""")
def s13_united_home_away_view(spark, sf_dir):
    t = tables(spark, sf_dir)
    team = focal_team_id(t.teams, FOCAL_SHORT_NAME).scalar()
    season = current_season_id(t.seasons).scalar()
    lf = team_matches(t.matches.filter(
        ((F.col("home_team_id") == team) | (F.col("away_team_id") == team))
        & (F.col("season_id") == season)))
    lf = lf.filter(F.col("team_id") == team)
    view = lf.groupBy(F.col("venue").alias("venue_type")).agg(
        F.count(F.lit(1)).alias("matches_played"),
        X.count_when(F.col("goals_for") > F.col("goals_against")).alias("wins"),
        X.count_when(F.col("goals_for") == F.col("goals_against")).alias("draws"),
        X.count_when(F.col("goals_for") < F.col("goals_against")).alias("losses"),
    )
    view.createOrReplaceTempView("united_home_away_form")
    return view


# -------------------------------------------------------------------- A3
@register("a3_opposition_strength", with_views("teams", "seasons", "matches", "opposition_categories",
                                               extra=LF_SQL) + f"""
SELECT *, {sqlx.ratio('wins', 'matches_played', 100)} AS win_rate,
       {sqlx.ratio('wins * 3 + draws', 'matches_played')} AS points_per_game
FROM (SELECT lf.season_id, lf.team_id,
        CASE WHEN o.name IN ({TOP6_SQL}) THEN 'Top 6'
             WHEN c.final_position BETWEEN 1 AND 6 THEN 'Top 6'
             WHEN c.final_position BETWEEN 7 AND 14 OR c.final_position IS NULL THEN 'Mid Table'
             ELSE 'Bottom 6' END AS opposition_strength,
        COUNT(*) AS matches_played, {_cnt('goals_for > goals_against')} AS wins,
        {_cnt('goals_for = goals_against')} AS draws,
        {sqlx.mean('goals_for')} AS avg_goals_for, {sqlx.mean('goals_against')} AS avg_goals_against
      FROM lf JOIN teams o ON o.id = lf.opponent_id JOIN teams t ON t.id = lf.team_id
      LEFT JOIN opposition_categories c ON c.team_id = lf.opponent_id AND c.season_id = lf.season_id
      GROUP BY 1, 2, 3) a""")
def a3_opposition_strength(spark, sf_dir):
    t = tables(spark, sf_dir)
    return perf.record_by_opposition(t.matches, t.teams, t.opposition_categories)


# -------------------------------------------------------------------- A4
_RECENT = LF_SQL + f""",
r AS (SELECT *, {RESULT_SQL} AS result,
        ROW_NUMBER() OVER (PARTITION BY season_id, team_id ORDER BY match_date DESC, match_id DESC) AS recency,
        COUNT(*) OVER (PARTITION BY season_id, team_id) AS n_key
      FROM lf)"""


@register("a4_form_summary", with_views("matches", extra=_RECENT) + f"""
SELECT *, {sqlx.ratio('wins', 'matches_played', 100)} AS win_rate, wins * 3 + draws AS points,
       {sqlx.ratio('wins * 3 + draws', 'matches_played')} AS points_per_game,
       goals_for - goals_against AS goal_difference,
       CASE WHEN goals_for - goals_against >= 0 THEN '+' ELSE '' END
         || CAST(goals_for - goals_against AS VARCHAR) AS goal_difference_text
FROM (SELECT season_id, team_id, string_agg(result, '' ORDER BY recency) AS form_string,
        COUNT(*) AS matches_played, {_cnt("result = 'W'")} AS wins, {_cnt("result = 'D'")} AS draws,
        {_cnt("result = 'L'")} AS losses,
        CAST(SUM(goals_for) AS BIGINT) AS goals_for, CAST(SUM(goals_against) AS BIGINT) AS goals_against
      FROM r WHERE recency <= 10 GROUP BY 1, 2) a""")
def a4_form_summary(spark, sf_dir):
    t = tables(spark, sf_dir)
    return perf.form_summary(t.matches, n=10)


# -------------------------------------------------------------------- A5
@register("a5_recent_matches", with_views("teams", "matches", extra=_RECENT) + """
SELECT r.season_id, r.team_id, r.match_id, r.match_date,
  CASE WHEN r.is_home THEN t.short_name ELSE o.short_name END AS home_team,
  CASE WHEN r.is_home THEN o.short_name ELSE t.short_name END AS away_team,
  r.home_score, r.away_score, CASE WHEN r.is_home THEN 'Home' ELSE 'Away' END AS venue, r.result,
  r.goals_for, r.goals_against, o.short_name AS opponent,
  CAST(r.goals_for AS VARCHAR) || '-' || CAST(r.goals_against AS VARCHAR) AS score,
  strftime(r.match_date, '%d/%m/%Y') AS match_day,
  r.recency, LEAST(r.n_key, 10) - r.recency + 1 AS form_position
FROM r JOIN teams t ON t.id = r.team_id JOIN teams o ON o.id = r.opponent_id
WHERE r.recency <= 10""")
def a5_recent_matches(spark, sf_dir):
    t = tables(spark, sf_dir)
    return perf.recent_matches(t.matches, t.teams, n=10)


# ------------------------------------------------------------------- A20
@register("a20_season_kpis", with_views("matches", extra=LF_SQL) + f"""
SELECT *, {sqlx.ratio('total_wins', 'total_matches', 100)} AS win_rate
FROM (SELECT season_id, team_id, COUNT(*) AS total_matches,
        {_cnt('goals_for > goals_against')} AS total_wins, CAST(SUM(goals_for) AS BIGINT) AS total_goals
      FROM lf GROUP BY 1, 2) a""")
def a20_season_kpis(spark, sf_dir):
    t = tables(spark, sf_dir)
    return perf.season_kpis(t.matches)


# ------------------------------------------------------------------- A21
@register("a21_weekly_results", with_views("teams", "matches", extra=LF_SQL) + f"""
SELECT lf.team_id, lf.match_id, lf.match_date,
  CASE WHEN lf.is_home THEN t.name ELSE o.name END AS home_team,
  CASE WHEN lf.is_home THEN o.name ELSE t.name END AS away_team,
  lf.home_score, lf.away_score, CASE WHEN lf.is_home THEN 'Home' ELSE 'Away' END AS venue,
  CASE WHEN goals_for > goals_against THEN 'Win' WHEN goals_for = goals_against THEN 'Draw' ELSE 'Loss' END AS result,
  strftime(lf.match_date, '%Y-%m-%d') AS report_day, CAST(weekofyear(lf.match_date) AS INTEGER) AS week_number
FROM lf JOIN teams t ON t.id = lf.team_id JOIN teams o ON o.id = lf.opponent_id
WHERE lf.match_date >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND lf.match_date <= TIMESTAMP '{AS_OF}'""")
def a21_weekly_results(spark, sf_dir):
    t = tables(spark, sf_dir)
    return perf.weekly_results(t.matches, t.teams, as_of=AS_OF)


# ------------------------------------------------------------------- A25
@register("a25_upcoming_fixtures", with_views("teams", "matches") + f"""
SELECT team_id, match_id, season_id, gameweek, match_date, venue, opponent_id, o.name AS opponent
FROM (SELECT id AS match_id, season_id, gameweek, match_date, home_team_id AS team_id,
        away_team_id AS opponent_id, 'Home' AS venue FROM matches
      WHERE status = 'scheduled' AND match_date >= TIMESTAMP '{AS_OF}'
      UNION ALL
      SELECT id, season_id, gameweek, match_date, away_team_id, home_team_id, 'Away' FROM matches
      WHERE status = 'scheduled' AND match_date >= TIMESTAMP '{AS_OF}') u
JOIN teams o ON o.id = u.opponent_id JOIN teams t ON t.id = u.team_id""")
def a25_upcoming_fixtures(spark, sf_dir):
    t = tables(spark, sf_dir)
    return perf.upcoming_fixtures(t.matches, t.teams, as_of=AS_OF)
