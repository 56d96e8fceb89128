"""Registered player and tactics queries."""

from __future__ import annotations



from touchline.operators import players as pl
from touchline.operators import tactics as tc
from touchline.plans import sqlx
from touchline.plans.catalog import register, tables, with_views


def _s(c: str) -> str:
    return f"CAST(SUM({c}) AS BIGINT)"


def _ratio(num: str, den: str, scale: int) -> str:
    return sqlx.guarded(num, den, scale)


PR_SQL = """pr AS (
  SELECT pms.* EXCLUDE (season_id, match_date), p.name, p.position, p.squad_number, p.team_id AS player_team_id,
         m.season_id, m.match_date, m.home_team_id, m.away_team_id, m.home_score, m.away_score
  FROM player_match_stats pms JOIN players p ON p.id = pms.player_id JOIN matches m ON m.id = pms.match_id
  WHERE pms.minutes_played > 0)"""
PLAYER_VIEWS = ("matches", "players", "player_match_stats")


def _a6_sql(position: str | None) -> str:
    pos = f"AND position = '{position}'" if position else ""
    return with_views(*PLAYER_VIEWS, extra=PR_SQL) + f"""
SELECT season_id, team_id, player_id, name, position, squad_number, appearances, total_minutes,
  avg_minutes_per_game, goals, assists, goal_contributions, key_passes, shots, shots_on_target,
  total_passes, accurate_passes, tackles, interceptions, clearances, avg_rating,
  {_ratio('shots_on_target', 'shots', 100)} AS shot_accuracy,
  {_ratio('accurate_passes', 'total_passes', 100)} AS pass_accuracy,
  {_ratio('goals', 'total_minutes', 90)} AS goals_per_90,
  {_ratio('assists', 'total_minutes', 90)} AS assists_per_90,
  {_ratio('key_passes', 'total_minutes', 90)} AS key_passes_per_90
FROM (SELECT season_id, player_team_id AS team_id, player_id, name, position, squad_number,
        COUNT(match_id) AS appearances, {_s('minutes_played')} AS total_minutes,
        {sqlx.mean('minutes_played')} AS avg_minutes_per_game, {_s('goals')} AS goals,
        {_s('assists')} AS assists, {_s('goals + assists')} AS goal_contributions,
        {_s('key_passes')} AS key_passes, {_s('shots_total')} AS shots,
        {_s('shots_on_target')} AS shots_on_target, {_s('passes_total')} AS total_passes,
        {_s('passes_accurate')} AS accurate_passes, {_s('tackles')} AS tackles,
        {_s('interceptions')} AS interceptions, {_s('clearances')} AS clearances,
        {sqlx.mean('rating', 6, 1)} AS avg_rating
      FROM pr WHERE TRUE {pos}
      GROUP BY 1, 2, 3, 4, 5, 6 HAVING SUM(minutes_played) >= 180) a"""


@register("a6_top_performers", _a6_sql(None))
def a6_top_performers(spark, sf_dir):
    t = tables(spark, sf_dir)
    return pl.top_performers(t.players, t.player_match_stats, t.matches, min_minutes=180, tasks=t.tasks())


@register("p18_top_performers_fwd", _a6_sql("FWD"))
def p18_top_performers_fwd(spark, sf_dir):
    t = tables(spark, sf_dir)
    return pl.top_performers(t.players, t.player_match_stats, t.matches, position="FWD",
                             min_minutes=180, tasks=t.tasks())


@register("a9_unsung_heroes", with_views(*PLAYER_VIEWS, extra=PR_SQL) + f"""
SELECT *, {_ratio('tackles + interceptions', 'total_minutes', 90)} AS defensive_actions_per_90
FROM (SELECT season_id, player_team_id AS team_id, player_id, name, position,
        COUNT(match_id) AS appearances, {_s('minutes_played')} AS total_minutes,
        {_s('tackles')} AS tackles, {_s('interceptions')} AS interceptions,
        {_s('clearances')} AS clearances, {_s('tackles + interceptions')} AS defensive_actions,
        {sqlx.mean('rating', 6, 1)} AS avg_rating,
        CASE WHEN position IN ('DEF', 'GK') THEN
          {sqlx.mean("CASE WHEN (home_team_id = player_team_id AND away_score = 0) OR (away_team_id = player_team_id AND home_score = 0) THEN 100 ELSE 0 END")} END
          AS clean_sheet_percentage
      FROM pr WHERE position IN ('DEF', 'MID', 'GK')
      GROUP BY 1, 2, 3, 4, 5 HAVING SUM(minutes_played) >= 450) a""")
def a9_unsung_heroes(spark, sf_dir):
    t = tables(spark, sf_dir)
    return pl.unsung_heroes(t.players, t.player_match_stats, t.matches, min_minutes=450, tasks=t.tasks())


@register("a11_player_form", with_views(*PLAYER_VIEWS, extra=PR_SQL + """,
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY season_id, player_id
                                   ORDER BY match_date DESC, match_id DESC) AS rn FROM pr)""") + f"""
SELECT season_id, player_team_id AS team_id, player_id, name, position, COUNT(*) AS matches,
  {sqlx.mean('rating', 6, 1)} AS avg_rating, {_s('goals')} AS total_goals, {_s('assists')} AS total_assists,
  {sqlx.mean('passes_total')} AS avg_passes_per_game,
  {_ratio('SUM(passes_accurate)', 'SUM(passes_total)', 100)} AS avg_pass_accuracy
FROM r WHERE rn <= 5 GROUP BY 1, 2, 3, 4, 5""")
def a11_player_form(spark, sf_dir):
    t = tables(spark, sf_dir)
    return pl.player_form(t.players, t.player_match_stats, t.matches, n=5, tasks=t.tasks())


@register("a13_top_performers_view", with_views(*PLAYER_VIEWS, extra=PR_SQL) + f"""
SELECT season_id, player_team_id AS team_id, player_id, name, position,
  COUNT(match_id) AS matches_played, {_s('minutes_played')} AS total_minutes, {_s('goals')} AS goals,
  {_s('assists')} AS assists, {_s('key_passes')} AS key_passes, {_s('tackles')} AS tackles,
  {_s('interceptions')} AS interceptions, {sqlx.mean('rating', 6, 1)} AS avg_rating
FROM pr GROUP BY 1, 2, 3, 4, 5""")
def a13_top_performers_view(spark, sf_dir):
    t = tables(spark, sf_dir)
    return pl.top_performers_view(t.players, t.player_match_stats, t.matches, tasks=t.tasks())


@register("a22_key_players", with_views(*PLAYER_VIEWS) + f"""
SELECT * FROM (
  SELECT a.player_id, a.appearances, a.total_minutes, p.name, p.team_id,
    ROW_NUMBER() OVER (PARTITION BY p.team_id ORDER BY a.total_minutes DESC, a.player_id) AS minutes_rank
  FROM (SELECT player_id, COUNT(match_id) AS appearances, {_s('minutes_played')} AS total_minutes
        FROM player_match_stats GROUP BY 1 HAVING COUNT(match_id) >= 5) a
  JOIN players p ON p.id = a.player_id WHERE p.is_active) x
WHERE minutes_rank <= 15""")
def a22_key_players(spark, sf_dir):
    t = tables(spark, sf_dir)
    return pl.key_players(t.players, t.player_match_stats)


# ------------------------------------------------------------------ tactics
TR_SQL = """tr AS (
  SELECT ms.* EXCLUDE (season_id, match_date), m.season_id, m.match_date,
    CASE WHEN m.home_team_id = ms.team_id THEN m.home_score ELSE m.away_score END AS goals_for,
    CASE WHEN m.home_team_id = ms.team_id THEN m.away_score ELSE m.home_score END AS goals_against
  FROM match_stats ms JOIN matches m ON m.id = ms.match_id WHERE m.status = 'finished'),
tp AS (
  SELECT season_id, team_id, match_id, possession_percent,
    CASE WHEN goals_for > goals_against THEN 'Win' WHEN goals_for = goals_against THEN 'Draw' ELSE 'Loss' END
      AS result,
    goals_for, shots_total, shots_on_target, pass_accuracy_percent
  FROM tr WHERE possession_percent IS NOT NULL)"""
TACTIC_VIEWS = ("matches", "match_stats")


@register("a12_formations", with_views(*TACTIC_VIEWS, extra=TR_SQL) + f"""
SELECT season_id, team_id, formation, matches_played, wins, draws,
  avg_possession, avg_shots, avg_shots_on_target, avg_pass_accuracy, avg_goals_for, avg_goals_against,
  {sqlx.ratio('wins', 'matches_played', 100)} AS win_rate,
  {sqlx.ratio('wins * 3 + draws', 'matches_played')} AS points_per_game, goal_difference_per_game
FROM (SELECT season_id, team_id, formation, COUNT(*) AS matches_played,
        CAST(SUM(CASE WHEN goals_for > goals_against THEN 1 ELSE 0 END) AS BIGINT) AS wins,
        CAST(SUM(CASE WHEN goals_for = goals_against THEN 1 ELSE 0 END) AS BIGINT) AS draws,
        {sqlx.mean('possession_percent', 6, 2)} AS avg_possession, {sqlx.mean('shots_total')} AS avg_shots,
        {sqlx.mean('shots_on_target')} AS avg_shots_on_target,
        {sqlx.mean('pass_accuracy_percent', 6, 2)} AS avg_pass_accuracy,
        {sqlx.mean('goals_for')} AS avg_goals_for, {sqlx.mean('goals_against')} AS avg_goals_against,
        {sqlx.mean_diff('goals_for', 'goals_against')} AS goal_difference_per_game
      FROM tr WHERE formation IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3) a""")
def a12_formations(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tc.formation_effectiveness(t.match_stats, t.matches, min_matches=3)


@register("a14_possession", with_views(*TACTIC_VIEWS, extra=TR_SQL) + "SELECT * FROM tp")
def a14_possession(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tc.possession_frame(t.match_stats, t.matches)


def _pearson_sql(x: str, y: str) -> str:
    xs = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN CAST({x} AS DOUBLE) END"
    ys = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN CAST({y} AS DOUBLE) END"
    return (f"ROUND(COVAR_POP({xs}, {ys}) / NULLIF(STDDEV_POP({xs}) * STDDEV_POP({ys}), 0), 6)")


@register("a15_possession_correlation", with_views(*TACTIC_VIEWS, extra=TR_SQL) + f"""
SELECT season_id, team_id,
  {_pearson_sql('possession_percent', 'goals_for')} AS possession_goals_correlation,
  {_pearson_sql('possession_percent', 'shots_total')} AS possession_shots_correlation
FROM tp GROUP BY 1, 2""")
def a15_possession_correlation(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tc.possession_correlations(tc.possession_frame(t.match_stats, t.matches))


@register("a16_possession_by_result", with_views(*TACTIC_VIEWS, extra=TR_SQL) + f"""
SELECT season_id, team_id, result,
  {sqlx.mean('possession_percent', 2, 2)} AS possession_mean,
  CAST({sqlx.he("CAST(MEDIAN(CAST(ROUND(possession_percent * 100) AS BIGINT)) * 2 AS BIGINT)", "2")} AS DOUBLE) / 100
    AS possession_median,
  {sqlx.mean('goals_for', 2, 0)} AS goals_for_mean,
  {sqlx.mean('shots_total', 2, 0)} AS shots_total_mean,
  {sqlx.mean('pass_accuracy_percent', 2, 2)} AS pass_accuracy_mean
FROM tp GROUP BY 1, 2, 3""")
def a16_possession_by_result(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tc.possession_by_result(tc.possession_frame(t.match_stats, t.matches))


SHOT_SQL = """sr AS (
  SELECT m.season_id, s.team_id, s.match_id, s.x_coordinate, s.y_coordinate, s.shot_type, s.situation,
    s.is_goal, s.is_on_target, s.xg_value, p.name AS player_name, p.position, m.match_date,
    ht.short_name AS home_team, aw.short_name AS away_team,
    CASE WHEN s.x_coordinate IS NULL OR s.y_coordinate IS NULL THEN 'Unknown'
         WHEN s.x_coordinate >= 83 THEN
           CASE WHEN s.y_coordinate BETWEEN 20 AND 80 THEN 'Six Yard Box' ELSE 'Wide Close' END
         WHEN s.x_coordinate >= 67 THEN
           CASE WHEN s.y_coordinate BETWEEN 30 AND 70 THEN 'Central Penalty Area' ELSE 'Wide Penalty Area' END
         WHEN s.x_coordinate >= 50 THEN 'Outside Box'
         ELSE 'Long Range' END AS shot_zone
  FROM shots s JOIN players p ON s.player_id = p.id JOIN matches m ON s.match_id = m.id
  JOIN teams ht ON m.home_team_id = ht.id JOIN teams aw ON m.away_team_id = aw.id)"""
SHOT_VIEWS = ("teams", "matches", "players", "shots")


def _shot_rows(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tc.shot_frame(t.shots, t.players, t.matches, t.teams)


@register("a17_shots", with_views(*SHOT_VIEWS, extra=SHOT_SQL) + "SELECT * FROM sr")
def a17_shots(spark, sf_dir):
    return _shot_rows(spark, sf_dir)


@register("a18_shot_totals", with_views(*SHOT_VIEWS, extra=SHOT_SQL) + f"""
SELECT season_id, team_id, COUNT(*) AS total_shots,
  CAST(SUM(CAST(is_goal AS INTEGER)) AS BIGINT) AS goals_scored,
  {sqlx.mean('CAST(is_on_target AS INTEGER) * 100')} AS shot_accuracy,
  {sqlx.mean('CAST(is_goal AS INTEGER) * 100')} AS conversion_rate,
  {sqlx.mean('xg_value', 6, 3)} AS avg_xg_per_shot
FROM sr GROUP BY 1, 2""")
def a18_shot_totals(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tc.shot_totals(tc.season_shots(t.shots, t.matches))


@register("a19_shot_zones", with_views(*SHOT_VIEWS, extra=SHOT_SQL) + f"""
SELECT season_id, team_id, shot_zone, COUNT(is_goal) AS shots,
  CAST(SUM(CAST(is_goal AS INTEGER)) AS BIGINT) AS goals,
  {sqlx.mean('CAST(is_goal AS INTEGER)', 3, 0)} AS conversion_rate,
  {sqlx.mean('CAST(is_on_target AS INTEGER)', 3, 0)} AS on_target_rate,
  {sqlx.mean('xg_value', 3, 3)} AS avg_xg
FROM sr GROUP BY 1, 2, 3""")
def a19_shot_zones(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tc.shot_zones(tc.season_shots(t.shots, t.matches))



