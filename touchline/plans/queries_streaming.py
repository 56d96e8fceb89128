"""Registered streaming and report queries.

The streaming queries land files derived from the given tables in a fresh
folder under ``spark.checkpoint.dir``, run the stream to completion
(``availableNow``) and return the resulting table; their oracles are the
equivalent batch SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.operators.longform import current_season_id, focal_team_id
from touchline.plans import sqlx
from touchline.plans.catalog import AS_OF, FOCAL_SHORT_NAME, LF_SQL, register, tables, with_views
from touchline.plans.report import weekly_report
from touchline.session import scratch_dir
from touchline.sources import schemas as SC
from touchline.operators.league import opposition_categories
from touchline.operators import features as ft
from touchline.plans.queries_features import LEAGUE_SQL, m8_sql
from touchline.streaming import commits
from touchline.streaming import form_state as fs
from touchline.streaming import league_state as ls
from touchline.streaming import match_day as md


def _run_dir(spark, name: str) -> str:
    return scratch_dir(spark, f"streams/{name}/{uuid.uuid4().hex}")


_T1_SQL = """
SELECT id, season_id, gameweek, match_date, home_team_id, away_team_id,
  CASE WHEN status = 'scheduled' THEN NULL ELSE home_score END AS home_score,
  CASE WHEN status = 'scheduled' THEN NULL ELSE away_score END AS away_score, status,
  CASE WHEN status = 'scheduled' THEN match_date - INTERVAL 1 DAY ELSE match_date + INTERVAL 2 HOUR END
    AS updated_at
FROM matches"""


def _match_landings(spark, sf_dir):
    """(documents before the match, documents with results)."""
    m = tables(spark, sf_dir).matches
    keep = ["id", "season_id", "gameweek", "match_date", "home_team_id", "away_team_id"]
    pre = m.select(*keep, F.lit(None).cast("long").alias("home_score"),
                   F.lit(None).cast("long").alias("away_score"), F.lit("scheduled").alias("status"),
                   (F.col("match_date") - F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    final = m.filter(F.col("status") != "scheduled").select(
        *keep, "home_score", "away_score", "status",
        (F.col("match_date") + F.expr("INTERVAL 2 HOURS")).alias("updated_at"))
    return pre, final


@register("t1_incremental_match_ingest", with_views("matches") + _T1_SQL)
def t1_incremental_match_ingest(spark, sf_dir):
    base = _run_dir(spark, "t1")
    pre, final = _match_landings(spark, sf_dir)
    # Two landings: pre-match documents first, then results.
    pre.write.parquet(f"{base}/landing/h01")
    final.write.parquet(f"{base}/landing/h02")
    q = md.start_match_ingest(spark, f"{base}/landing/*", f"{base}/matches", f"{base}/checkpoint",
                              files_per_trigger=4)
    q.awaitTermination()
    return md.current_matches(spark, f"{base}/matches")


@register("t1_compacted_matches", with_views("matches") + _T1_SQL)
def t1_compacted_matches(spark, sf_dir):
    """Results land first and are compacted; a compaction that never commits
    and the documents before the match follow."""
    base = _run_dir(spark, "t1c")
    table = f"{base}/matches"
    pre, final = _match_landings(spark, sf_dir)
    final.write.parquet(f"{base}/landing/h01")
    md.start_match_ingest(spark, f"{base}/landing/*", table, f"{base}/checkpoint", files_per_trigger=1).awaitTermination()
    md.compact_matches(spark, table)
    commits.write_data(final.withColumn("home_score", F.lit(-1).cast("long")), table)
    pre.write.parquet(f"{base}/landing/h02")
    md.start_match_ingest(spark, f"{base}/landing/*", table, f"{base}/checkpoint").awaitTermination()
    return md.current_matches(spark, table)


@register("s8_stream_collection_log", with_views("matches") + """
SELECT 'match_day' AS source, 'matches' AS data_type, n AS records_collected, TRUE AS success
FROM (SELECT COUNT(*) AS n FROM matches UNION ALL SELECT COUNT(*) FROM matches WHERE status <> 'scheduled') a""")
def s8_stream_collection_log(spark, sf_dir):
    base = _run_dir(spark, "s8")
    for i, docs in enumerate(_match_landings(spark, sf_dir)):
        docs.write.parquet(f"{base}/landing/h{i:02d}")
        md.start_match_ingest(spark, f"{base}/landing/*", f"{base}/matches", f"{base}/checkpoint",
                              log_path=f"{base}/log").awaitTermination()
    return spark.read.schema(SC.DATA_COLLECTION_LOG).parquet(f"{base}/log").select(
        "source", "data_type", "records_collected", "success")


def _late_results(spark, sf_dir, table, refresh):
    """Commit results in three batches and refresh after each: first without
    every seventh match and with wrong scores for every fifth, then all of them,
    as documents before and after the match that arrive in either order."""
    pre, final = _match_landings(spark, sf_dir)
    early = final.filter(F.col("id") % 7 != 0).withColumns({
        "home_score": F.when(F.col("id") % 5 == 0, F.col("away_score") + 1).otherwise(F.col("home_score")),
        "updated_at": F.col("updated_at") - F.expr("INTERVAL 1 HOUR")})
    for updates in (early, pre, final):
        md.commit_matches(spark, updates, table)
        refresh()


@register("a23_refreshed_league_table", with_views("matches", extra=LEAGUE_SQL) + """
SELECT lt.*, frm.form FROM lt LEFT JOIN frm ON frm.season_id = lt.season_id AND frm.team_id = lt.team_id
  AND frm.seq = lt.matches_played""")
def a23_refreshed_league_table(spark, sf_dir):
    base = _run_dir(spark, "a23")
    _late_results(spark, sf_dir, f"{base}/matches",
                  lambda: ls.refresh_league_table(spark, f"{base}/matches", f"{base}/league"))
    return ls.stored_league_table(spark, f"{base}/league")


@register("a24_refreshed_opposition_category", with_views("matches", extra=LEAGUE_SQL) + """
SELECT team_id, season_id, position AS final_position,
  CASE WHEN position <= 6 THEN 'top_6' WHEN position <= 14 THEN 'mid_table' ELSE 'relegation_battle' END
    AS category
FROM lt WHERE (season_id, gameweek) IN (SELECT season_id, MAX(gameweek) FROM lt GROUP BY season_id)""")
def a24_refreshed_opposition_category(spark, sf_dir):
    return opposition_categories(a23_refreshed_league_table(spark, sf_dir))


@register("m8_refreshed_fixture_features", m8_sql())
def m8_refreshed_fixture_features(spark, sf_dir):
    base = _run_dir(spark, "m8")
    _late_results(spark, sf_dir, f"{base}/matches", lambda: fs.refresh_form(spark, f"{base}/matches", f"{base}/form"))
    team = focal_team_id(tables(spark, sf_dir).teams, FOCAL_SHORT_NAME).scalar()
    fixtures = md.current_matches(spark, f"{base}/matches").filter(F.col("status") == "scheduled")
    f = fs.fixture_features(spark, f"{base}/form", fixtures, focal_team_id=team)
    return f.withColumns({c: F.round(c, 6) for c in ft.MATCH_FEATURES if c != "is_focal_team"})


_T2_SQL = with_views("data_collection_log") + f"""
SELECT window_start, source, runs, successes, records_collected,
  {sqlx.ratio('successes', 'runs', 100)} AS success_rate, ROUND(total_seconds / runs, 6) AS mean_seconds
FROM (SELECT date_trunc('day', collected_at) AS window_start, source, COUNT(*) AS runs,
        COUNT(*) FILTER (WHERE success) AS successes,
        CAST(SUM(CASE WHEN success THEN records_collected END) AS BIGINT) AS records_collected,
        SUM(execution_time_seconds) AS total_seconds
      FROM data_collection_log GROUP BY 1, 2) a"""


@register("t2_log_health_windows", _T2_SQL)
def t2_log_health_windows(spark, sf_dir):
    t = tables(spark, sf_dir)
    base = _run_dir(spark, "t2")
    t.data_collection_log.write.parquet(f"{base}/landing")
    q = md.start_log_health(spark, f"{base}/landing", f"{base}/out", f"{base}/checkpoint",
                            files_per_trigger=None)
    q.awaitTermination()
    return md.final_windows(spark, f"{base}/out")


@register("t2_late_rows_reconciled", _T2_SQL)
def t2_late_rows_reconciled(spark, sf_dir):
    """Every third hour lands at a time, each landing a run of its own: the rows
    of the second and third lie behind the watermark, but for the last hours."""
    log = tables(spark, sf_dir).data_collection_log
    base = _run_dir(spark, "t2late")
    part = F.pmod(F.coalesce(F.hour("collected_at"), F.lit(0)), F.lit(3))
    for i in range(3):
        log.filter(part == i).write.parquet(f"{base}/landing/h{i:02d}")
        md.run_log_health(spark, f"{base}/landing/*", base)
    return md.reconciled_windows(spark, base)


_FOCAL = f"(SELECT COALESCE(MIN(id), 1) FROM teams WHERE short_name = '{FOCAL_SHORT_NAME}')"
_SEASON = "(SELECT COALESCE(MIN(id), 1) FROM seasons WHERE is_current)"


@register("a26_weekly_report", with_views(
    "teams", "seasons", "matches", "match_stats", "players", "player_match_stats", extra=LF_SQL) + f"""
SELECT '{AS_OF}' AS report_date, CAST(weekofyear(DATE '{AS_OF}') AS INTEGER) AS week_number,
  CAST({_SEASON} AS VARCHAR) AS season,
  (SELECT COUNT(*) FROM lf WHERE team_id = {_FOCAL}
     AND match_date >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND match_date <= TIMESTAMP '{AS_OF}') AS n_performance,
  (SELECT COUNT(*) FROM (SELECT pms.player_id FROM player_match_stats pms
     JOIN players p ON p.id = pms.player_id JOIN matches m ON m.id = pms.match_id
     WHERE p.team_id = {_FOCAL} AND m.season_id = {_SEASON} AND pms.minutes_played > 0
     GROUP BY pms.player_id HAVING SUM(pms.minutes_played) >= 180) x) AS n_players,
  (SELECT COUNT(*) FROM (SELECT ms.formation FROM match_stats ms JOIN matches m ON m.id = ms.match_id
     WHERE ms.team_id = {_FOCAL} AND m.season_id = {_SEASON} AND m.status = 'finished'
       AND ms.formation IS NOT NULL GROUP BY ms.formation HAVING COUNT(*) >= 3) y) AS n_tactics,
  (SELECT COUNT(*) FROM matches WHERE status = 'scheduled' AND match_date >= TIMESTAMP '{AS_OF}'
     AND (home_team_id = {_FOCAL} OR away_team_id = {_FOCAL})) AS n_fixtures""")
def a26_weekly_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    team = focal_team_id(t.teams, FOCAL_SHORT_NAME).scalar()
    season = current_season_id(t.seasons).scalar()
    rep = weekly_report(spark, t, as_of=AS_OF, team_id=team, season_id=season,
                        season_label=None)
    return rep["header"].withColumn("season", season.cast("string"))
