"""Registered feature and league queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import features as ft
from touchline.operators import league as lg
from touchline.operators.longform import current_season_id, focal_team_id
from touchline.plans.catalog import FOCAL_SHORT_NAME, LF_SQL, register, tables, with_views

_FOCAL_SQL = f"(SELECT COALESCE(MIN(id), 1) FROM teams WHERE short_name = '{FOCAL_SHORT_NAME}')"
_SEASON_SQL = "(SELECT COALESCE(MIN(id), 1) FROM seasons WHERE is_current)"


def _r6(c: str) -> str:
    return f"ROUND({c}, 6)"


W2_SQL = LF_SQL + """,
w2a AS (SELECT match_id, season_id, match_date, team_id, is_home,
  AVG(CASE WHEN goals_for > goals_against THEN 1 ELSE 0 END)
    OVER (PARTITION BY team_id ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f,
  AVG(goals_for)
    OVER (PARTITION BY team_id ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS g
  FROM lf),
w2 AS (SELECT match_id, season_id, match_date, team_id, is_home,
  FIRST_VALUE(f) OVER (PARTITION BY team_id, match_date ORDER BY match_id) AS form,
  FIRST_VALUE(g) OVER (PARTITION BY team_id, match_date ORDER BY match_id) AS avg_goals_for
  FROM w2a)"""

W3_SQL = """w3a AS (SELECT id AS match_id, season_id, match_date, home_team_id, away_team_id, home_score, away_score,
  AVG(CASE WHEN home_score > away_score THEN 1.0 WHEN home_score = away_score THEN 0.5 ELSE 0.0 END)
    OVER (PARTITION BY LEAST(home_team_id, away_team_id), GREATEST(home_team_id, away_team_id)
          ORDER BY match_date, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h
  FROM matches WHERE status = 'finished'),
w3 AS (SELECT match_id, season_id, match_date, home_team_id, away_team_id, home_score, away_score,
  FIRST_VALUE(h) OVER (PARTITION BY LEAST(home_team_id, away_team_id), GREATEST(home_team_id, away_team_id),
                       match_date ORDER BY match_id) AS h2h_home_advantage
  FROM w3a)"""


@register("w2_team_form", with_views("matches", extra=W2_SQL) + f"""
SELECT match_id, season_id, match_date, team_id, is_home, {_r6('form')} AS form,
  {_r6('avg_goals_for')} AS avg_goals_for FROM w2""")
def w2_team_form(spark, sf_dir):
    t = tables(spark, sf_dir)
    f = ft.team_form(t.matches, n=5)
    return f.withColumns({"form": F.round("form", 6), "avg_goals_for": F.round("avg_goals_for", 6)})


@register("w3_head_to_head", with_views("matches", extra=W3_SQL) + f"""
SELECT match_id, season_id, match_date, home_team_id, away_team_id, home_score, away_score,
  {_r6('h2h_home_advantage')} AS h2h_home_advantage FROM w3""")
def w3_head_to_head(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ft.head_to_head(t.matches, n=10).withColumn(
        "h2h_home_advantage", F.round("h2h_home_advantage", 6))


@register("m1_match_features", with_views("teams", "seasons", "matches", extra=W2_SQL + ",\n" + W3_SQL) + f"""
SELECT match_id, season_id, match_date, home_team_id, away_team_id, home_score, away_score,
  {_r6('COALESCE(home_form, 0.5)')} AS home_form, {_r6('COALESCE(away_form, 0.5)')} AS away_form,
  {_r6('COALESCE(home_avg_goals_for, 0.5)')} AS home_avg_goals_for,
  {_r6('COALESCE(away_avg_goals_for, 0.5)')} AS away_avg_goals_for,
  {_r6('COALESCE(h2h_home_advantage, 0.5)')} AS h2h_home_advantage,
  {_r6('COALESCE(home_avg_goals_for - away_avg_goals_for, 0.5)')} AS goal_difference_tendency,
  {_r6('COALESCE(home_form - away_form, 0.5)')} AS form_difference,
  CAST(home_team_id = {_FOCAL_SQL} OR away_team_id = {_FOCAL_SQL} AS INTEGER) AS is_focal_team,
  CASE WHEN home_score > away_score THEN 'Home Win' WHEN home_score = away_score THEN 'Draw'
       ELSE 'Away Win' END AS outcome
FROM (SELECT w3.*, hf.form AS home_form, af.form AS away_form, hf.avg_goals_for AS home_avg_goals_for,
        af.avg_goals_for AS away_avg_goals_for
      FROM w3 JOIN w2 hf ON hf.match_id = w3.match_id AND hf.is_home
      JOIN w2 af ON af.match_id = w3.match_id AND NOT af.is_home
      WHERE w3.season_id = {_SEASON_SQL}) x
WHERE home_form IS NOT NULL AND away_form IS NOT NULL""")
def m1_match_features(spark, sf_dir):
    t = tables(spark, sf_dir)
    season = current_season_id(t.seasons).scalar()
    team = focal_team_id(t.teams, FOCAL_SHORT_NAME).scalar()
    f = ft.match_features(t.matches, season_id=season, focal_team_id=team)
    return f.withColumns({c: F.round(c, 6) for c in ft.MATCH_FEATURES if c != "is_focal_team"})


def _falsy(c: str, d: float) -> str:
    return f"COALESCE(CAST(NULLIF({c}, 0) AS DOUBLE), {d})"


M8_SQL = LF_SQL + """,
tr AS (SELECT team_id, AVG(CASE WHEN goals_for > goals_against THEN 1 ELSE 0 END) AS form,
         AVG(goals_for) AS g
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS rn
             FROM lf) z WHERE rn <= 5 GROUP BY team_id),
pr AS (SELECT lo, hi, AVG(CASE WHEN home_score > away_score THEN 1.0 WHEN home_score = away_score THEN 0.5
                               ELSE 0.0 END) AS h
       FROM (SELECT LEAST(home_team_id, away_team_id) AS lo, GREATEST(home_team_id, away_team_id) AS hi,
               home_score, away_score,
               ROW_NUMBER() OVER (PARTITION BY LEAST(home_team_id, away_team_id),
                                  GREATEST(home_team_id, away_team_id) ORDER BY match_date DESC, id DESC) AS rn
             FROM matches WHERE status = 'finished') z WHERE rn <= 10 GROUP BY lo, hi),
fx AS (SELECT f.id AS match_id, f.season_id, f.match_date, f.home_team_id, f.away_team_id,
         """ + _falsy("hm.form", 0.5) + """ AS home_form, """ + _falsy("am.form", 0.5) + """ AS away_form,
         """ + _falsy("hm.g", 1.0) + """ AS home_avg_goals_for, """ + _falsy("am.g", 1.0) + """ AS away_avg_goals_for,
         """ + _falsy("pr.h", 0.5) + """ AS h2h_home_advantage
       FROM matches f LEFT JOIN tr hm ON hm.team_id = f.home_team_id LEFT JOIN tr am ON am.team_id = f.away_team_id
       LEFT JOIN pr ON pr.lo = LEAST(f.home_team_id, f.away_team_id) AND pr.hi = GREATEST(f.home_team_id, f.away_team_id)
       WHERE f.status = 'scheduled')"""


def m8_sql() -> str:
    return with_views("teams", "matches", extra=M8_SQL) + f"""
SELECT match_id, season_id, match_date, home_team_id, away_team_id,
  {_r6('home_form')} AS home_form, {_r6('away_form')} AS away_form,
  {_r6('home_avg_goals_for')} AS home_avg_goals_for, {_r6('away_avg_goals_for')} AS away_avg_goals_for,
  {_r6('h2h_home_advantage')} AS h2h_home_advantage,
  {_r6('home_avg_goals_for - away_avg_goals_for')} AS goal_difference_tendency,
  {_r6('home_form - away_form')} AS form_difference,
  CAST(home_team_id = {_FOCAL_SQL} OR away_team_id = {_FOCAL_SQL} AS INTEGER) AS is_focal_team
FROM fx"""


@register("m8_fixture_features", m8_sql())
def m8_fixture_features(spark, sf_dir):
    t = tables(spark, sf_dir)
    team = focal_team_id(t.teams, FOCAL_SHORT_NAME).scalar()
    f = ft.fixture_features(t.matches, focal_team_id=team)
    return f.withColumns({c: F.round(c, 6) for c in ft.MATCH_FEATURES if c != "is_focal_team"})


M11_SQL = """pf AS (
  SELECT pms.player_id, pms.match_id, m.season_id, m.match_date, pms.team_id,
    CASE WHEN m.home_team_id = pms.team_id THEN m.away_team_id ELSE m.home_team_id END AS opponent_id,
    pms.goals, pms.assists, pms.rating,
    CASE WHEN oc.final_position <= 6 THEN 2 WHEN oc.final_position <= 14 THEN 1 ELSE 0 END AS opposition_strength,
    CAST(m.home_team_id = pms.team_id AS INTEGER) AS is_home, pms.minutes_played,
    AVG(pms.goals) OVER w AS g, AVG(pms.assists) OVER w AS a, AVG(pms.rating) OVER w AS r
  FROM player_match_stats pms JOIN matches m ON m.id = pms.match_id
  LEFT JOIN opposition_categories oc
    ON oc.team_id = CASE WHEN m.home_team_id = pms.team_id THEN m.away_team_id ELSE m.home_team_id END
   AND oc.season_id = m.season_id
  WHERE pms.minutes_played > 0 AND m.status = 'finished'
  WINDOW w AS (PARTITION BY pms.player_id ORDER BY m.match_date, pms.match_id
               ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""


@register("m11_player_features", with_views("matches", "player_match_stats", "opposition_categories",
                                            extra=M11_SQL) + f"""
SELECT player_id, match_id, season_id, match_date, team_id, opponent_id, goals, assists, rating,
  opposition_strength, is_home, minutes_played,
  {_r6('COALESCE(g, 0)')} AS recent_avg_goals, {_r6('COALESCE(a, 0)')} AS recent_avg_assists,
  {_r6('COALESCE(r, 0)')} AS recent_avg_rating
FROM pf""")
def m11_player_features(spark, sf_dir):
    t = tables(spark, sf_dir)
    f = ft.player_features(t.player_match_stats, t.matches, t.opposition_categories, n=10)
    return f.withColumns({c: F.round(c, 6) for c in
                          ("recent_avg_goals", "recent_avg_assists", "recent_avg_rating")})


LEAGUE_SQL = LF_SQL + """,
lfr AS (SELECT *, CASE WHEN goals_for > goals_against THEN 'W' WHEN goals_for = goals_against THEN 'D' ELSE 'L' END
          AS result,
          ROW_NUMBER() OVER (PARTITION BY season_id, team_id ORDER BY gameweek, match_date, match_id) AS seq
        FROM lf),
wk AS (SELECT season_id, gameweek, team_id, COUNT(*) AS p,
         SUM(CASE WHEN goals_for > goals_against THEN 1 ELSE 0 END) AS w,
         SUM(CASE WHEN goals_for = goals_against THEN 1 ELSE 0 END) AS d,
         SUM(CASE WHEN goals_for < goals_against THEN 1 ELSE 0 END) AS l,
         COALESCE(SUM(goals_for), 0) AS gf, COALESCE(SUM(goals_against), 0) AS ga
       FROM lf GROUP BY 1, 2, 3),
grid AS (SELECT t.season_id, t.team_id, g.gameweek
         FROM (SELECT DISTINCT season_id, team_id FROM wk) t
         JOIN (SELECT DISTINCT season_id, gameweek FROM wk) g ON g.season_id = t.season_id),
cum AS (SELECT grid.season_id, grid.gameweek, grid.team_id,
          CAST(SUM(COALESCE(wk.p, 0)) OVER c AS BIGINT) AS matches_played,
          CAST(SUM(COALESCE(wk.w, 0)) OVER c AS BIGINT) AS wins,
          CAST(SUM(COALESCE(wk.d, 0)) OVER c AS BIGINT) AS draws,
          CAST(SUM(COALESCE(wk.l, 0)) OVER c AS BIGINT) AS losses,
          CAST(SUM(COALESCE(wk.gf, 0)) OVER c AS BIGINT) AS goals_for,
          CAST(SUM(COALESCE(wk.ga, 0)) OVER c AS BIGINT) AS goals_against
        FROM grid LEFT JOIN wk ON wk.season_id = grid.season_id AND wk.gameweek = grid.gameweek
          AND wk.team_id = grid.team_id
        WINDOW c AS (PARTITION BY grid.season_id, grid.team_id ORDER BY grid.gameweek)),
frm AS (SELECT a.season_id, a.team_id, a.seq, string_agg(b.result, '' ORDER BY b.seq DESC) AS form
        FROM lfr a JOIN lfr b ON b.season_id = a.season_id AND b.team_id = a.team_id
          AND b.seq BETWEEN a.seq - 4 AND a.seq
        GROUP BY 1, 2, 3),
lt AS (SELECT cum.*, goals_for - goals_against AS goal_difference, wins * 3 + draws AS points,
         CAST(RANK() OVER (PARTITION BY season_id, gameweek
                           ORDER BY wins * 3 + draws DESC, goals_for - goals_against DESC, goals_for DESC)
              AS BIGINT) AS position
       FROM cum)"""


@register("a23_league_table", with_views("matches", extra=LEAGUE_SQL) + """
SELECT lt.*, frm.form FROM lt LEFT JOIN frm ON frm.season_id = lt.season_id AND frm.team_id = lt.team_id
  AND frm.seq = lt.matches_played""")
def a23_league_table(spark, sf_dir):
    t = tables(spark, sf_dir)
    return lg.league_table(t.matches)


@register("a24_opposition_category", with_views("matches", extra=LEAGUE_SQL) + """
SELECT team_id, season_id, position AS final_position,
  CASE WHEN position <= 6 THEN 'top_6' WHEN position <= 14 THEN 'mid_table' ELSE 'relegation_battle' END
    AS category
FROM lt WHERE (season_id, gameweek) IN (SELECT season_id, MAX(gameweek) FROM lt GROUP BY season_id)""")
def a24_opposition_category(spark, sf_dir):
    t = tables(spark, sf_dir)
    return lg.opposition_categories(lg.league_table(t.matches))
