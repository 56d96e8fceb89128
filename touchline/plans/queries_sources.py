"""Registered source queries: HTML elements (S7) and the loaders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import performance as perf
from touchline.plans.catalog import ORACLES, register, tables, with_views
from touchline.session import scratch_dir
from touchline.sources import html, ingest, names
from touchline.sources import schemas as SC


def _s7_sql(start: str, end: str) -> str:
    """The given pages nest neither element, so cutting at the tags finds them."""
    return f"""SELECT page_id, url, CAST(i - 2 AS INTEGER) AS element_index,
  trim(regexp_replace(split_part(pieces[i], '{end}', 1), '<[^>]*>', '', 'g')) AS text
FROM (SELECT page_id, url, string_split(html, '{start}') AS pieces FROM pages) p, range(2, 100000) r(i)
WHERE i <= len(pieces)"""


@register("s7_html_list_items", _s7_sql('<li>', '</li>'))
def s7_html_list_items(spark, sf_dir):
    return html.html_elements(tables(spark, sf_dir).raw("pages"), "li")


@register("s7_html_div_ad", _s7_sql('<div class="ad">', '</div>'))
def s7_html_div_ad(spark, sf_dir):
    return html.html_elements(tables(spark, sf_dir).raw("pages"), "div", "ad")


@register("s9_load_teams", with_views("teams", "src_teams") + """
SELECT (SELECT COALESCE(MAX(id), 0) FROM teams) + ROW_NUMBER() OVER (ORDER BY name) AS id, name, short_name,
  CAST(NULL AS INTEGER) AS founded_year, CAST(NULL AS VARCHAR) AS stadium
FROM (SELECT name, arg_min(short_name, id) AS short_name FROM src_teams GROUP BY name) n
WHERE NOT EXISTS (SELECT 1 FROM teams t WHERE t.name = n.name)""")
def s9_load_teams(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ingest.load_teams(t.src_teams, t.teams)


@register("s10_load_players", with_views("teams", "players", "src_teams", "src_elements") + """,
e AS (SELECT el.id AS source_id, el.first_name || ' ' || el.second_name AS name,
        CASE el.element_type WHEN 1 THEN 'GK' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD'
             ELSE 'UNK' END AS position,
        COALESCE(el.code, 0) % 100 AS squad_number, t.id AS team_id,
        COALESCE(el.status <> 'u', TRUE) AS is_active
      FROM src_elements el JOIN src_teams st ON st.id = el.team JOIN teams t ON t.name = st.name),
f AS (SELECT name, team_id, arg_min(position, source_id) AS position,
        arg_min(squad_number, source_id) AS squad_number, arg_min(is_active, source_id) AS is_active
      FROM e GROUP BY name, team_id)
SELECT (SELECT COALESCE(MAX(id), 0) FROM players) + ROW_NUMBER() OVER (ORDER BY team_id, name) AS id,
  name, position, squad_number, team_id, is_active
FROM f WHERE NOT EXISTS (SELECT 1 FROM players p WHERE p.name = f.name AND p.team_id = f.team_id)""")
def s10_load_players(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ingest.load_players(t.src_elements, t.src_teams, t.teams, t.players)


@register("s11_load_fixtures", with_views("teams", "matches", "src_teams", "src_fixtures") + """,
k AS (SELECT st.id AS sid, t.id AS lid FROM src_teams st JOIN teams t ON t.name = st.name),
f AS (SELECT CAST(EXTRACT(YEAR FROM CAST(fx.kickoff_time AS TIMESTAMP)) AS BIGINT) AS season_id,
        CAST(fx.event AS BIGINT) AS gameweek, CAST(fx.kickoff_time AS TIMESTAMP) AS match_date,
        kh.lid AS home_team_id, ka.lid AS away_team_id, fx.team_h_score AS home_score,
        fx.team_a_score AS away_score,
        CASE WHEN COALESCE(fx.finished, FALSE) THEN 'finished' ELSE 'live' END AS status, fx.id AS source_id
      FROM src_fixtures fx JOIN k kh ON kh.sid = fx.team_h JOIN k ka ON ka.sid = fx.team_a
      WHERE COALESCE(fx.started, FALSE)),
g AS (SELECT season_id, home_team_id, away_team_id, match_date, arg_min(gameweek, source_id) AS gameweek,
        arg_min(home_score, source_id) AS home_score, arg_min(away_score, source_id) AS away_score,
        arg_min(status, source_id) AS status
      FROM f GROUP BY 1, 2, 3, 4)
SELECT (SELECT COALESCE(MAX(id), 0) FROM matches)
         + ROW_NUMBER() OVER (ORDER BY match_date, home_team_id, away_team_id) AS id,
  season_id, gameweek, match_date, home_team_id, away_team_id, home_score, away_score, status
FROM g WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.season_id = g.season_id
  AND m.home_team_id = g.home_team_id AND m.away_team_id = g.away_team_id AND m.match_date = g.match_date)""")
def s11_load_fixtures(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ingest.load_fixtures(t.src_fixtures, t.src_teams, t.teams, t.matches)


# ------------------------------------------------------- landed documents
# The given tables are landed as JSON documents of bounded size under the
# shared folder and read back by the document readers.
DOCUMENT_ROWS = 512
# A file and its folder are committed one by one by the driver, and listed again by the
# reader: documents of one kind share a file, as a JSON array of them.
FILE_DOCUMENTS = 64


def _land(spark, docs: DataFrame, by: list[str], name: str, *, arrays: bool = False) -> str:
    """``FILE_DOCUMENTS`` documents a file: ``docs`` has the columns ``by`` (the last
    one numbers the documents) and the text ``value``, an object, or with
    ``arrays`` an array whose elements are taken."""
    path = scratch_dir(spark, f"documents/{name}-{uuid.uuid4().hex}")
    by = [*by[:-1], F.floor(F.col(by[-1]) / FILE_DOCUMENTS).alias("file")]
    text = F.col("value").substr(F.lit(2), F.length("value") - 2) if arrays else F.col("value")
    files = docs.groupBy(*by).agg(F.concat(F.lit("["), F.array_join(F.collect_list(text), ","), F.lit("]")).alias("value"))
    folders = files.columns[:-1]
    files.repartition(*folders).write.partitionBy(*folders).text(path)
    return path


def _bootstrap(spark, t) -> str:
    part = F.floor(F.col("id") / DOCUMENT_ROWS).alias("part")
    teams = t.src_teams.groupBy(part).agg(F.collect_list(F.struct("id", "name", "short_name")).alias("teams"))
    elements = t.src_elements.groupBy(part).agg(F.collect_list(F.struct(*ingest.BOOTSTRAP_ELEMENT.names)).alias("elements"))
    docs = teams.join(elements, "part", "full").select("part", F.to_json(F.struct("teams", "elements")).alias("value"))
    return _land(spark, docs, ["part"], "bootstrap")


@register("s3_bootstrap_teams", with_views("src_teams") + "SELECT id, name, short_name FROM src_teams")
def s3_bootstrap_teams(spark, sf_dir):
    return ingest.read_bootstrap(spark, _bootstrap(spark, tables(spark, sf_dir)))[0]


@register("s3_bootstrap_elements", with_views("src_elements") + """
SELECT id, first_name, second_name, team, element_type, code, status FROM src_elements""")
def s3_bootstrap_elements(spark, sf_dir):
    return ingest.read_bootstrap(spark, _bootstrap(spark, tables(spark, sf_dir)))[1]


@register("s4_fixture_documents", with_views("src_fixtures") + """
SELECT id, event, strftime(kickoff_time, '%Y-%m-%dT%H:%M:%SZ') AS kickoff_time, team_h, team_a, team_h_score,
  team_a_score, started, finished FROM src_fixtures""")
def s4_fixture_documents(spark, sf_dir):
    t = tables(spark, sf_dir)
    f = t.src_fixtures.withColumn("kickoff_time", F.date_format("kickoff_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    docs = f.groupBy(F.floor(F.col("id") / DOCUMENT_ROWS).alias("part")).agg(
        F.to_json(F.collect_list(F.struct(*ingest.FIXTURE.names))).alias("value"))
    return ingest.read_fixtures(spark, _land(spark, docs, ["part"], "fixtures", arrays=True)).select(*ingest.FIXTURE.names)


@register("s5_gameweek_documents", with_views("matches", "player_match_stats") + """
SELECT m.gameweek, s.player_id AS id, SUM(s.minutes_played)::DOUBLE AS minutes, SUM(s.goals)::DOUBLE AS goals
FROM player_match_stats s JOIN matches m ON m.id = s.match_id GROUP BY 1, 2""")
def s5_gameweek_documents(spark, sf_dir):
    t = tables(spark, sf_dir)
    weeks = t.matches.select(F.col("id").alias("match_id"), "gameweek")
    live = t.player_match_stats.join(weeks, "match_id").groupBy("gameweek", F.col("player_id").alias("id")).agg(
        F.sum("minutes_played").alias("minutes"), F.sum("goals").alias("goals"))
    element = F.struct("id", F.create_map(F.lit("minutes"), "minutes", F.lit("goals"), "goals").alias("stats"))
    docs = live.groupBy("gameweek", F.floor(F.col("id") / DOCUMENT_ROWS).alias("part")).agg(
        F.to_json(F.struct(F.collect_list(element).alias("elements"))).alias("value"))
    back = ingest.read_gameweek_live(spark, _land(spark, docs, ["gameweek", "part"], "live"))
    return back.select("gameweek", "id", F.col("stats")["minutes"].alias("minutes"), F.col("stats")["goals"].alias("goals"))


@register("s6_competition_documents", with_views("matches", "teams") + """
SELECT m.id, m.match_date, m.status, m.gameweek, m.home_team_id AS home_source_id, h.name AS home_name,
  m.away_team_id AS away_source_id, a.name AS away_name, m.home_score, m.away_score
FROM matches m JOIN teams h ON h.id = m.home_team_id JOIN teams a ON a.id = m.away_team_id""")
def s6_competition_documents(spark, sf_dir):
    t = tables(spark, sf_dir)
    return _competition(spark, t.matches, t.teams)


def _competition(spark, matches: DataFrame, teams: DataFrame) -> DataFrame:
    named = lambda side: teams.select(F.col("id").alias(f"{side}_team_id"), F.col("name").alias(f"{side}_name"))
    m = matches.join(named("home"), "home_team_id").join(named("away"), "away_team_id")
    match = F.struct(
        "id", F.date_format("match_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utcDate"), "status", F.col("gameweek").alias("matchday"),
        F.struct(F.col("home_team_id").alias("id"), F.col("home_name").alias("name")).alias("homeTeam"),
        F.struct(F.col("away_team_id").alias("id"), F.col("away_name").alias("name")).alias("awayTeam"),
        F.struct(F.struct(F.col("home_score").alias("home"), F.col("away_score").alias("away")).alias("fullTime")).alias("score"))
    docs = m.groupBy(F.floor(F.col("id") / DOCUMENT_ROWS).alias("part")).agg(
        F.to_json(F.struct(F.collect_list(match).alias("matches"))).alias("value"))
    return ingest.read_competition_matches(spark, _land(spark, docs, ["part"], "competition"))


@register("s6_loaded_competition_matches", with_views("matches", "teams") + """
SELECT season_id, gameweek, match_date, home_team_id, away_team_id,
  arg_min(home_score, id) AS home_score, arg_min(away_score, id) AS away_score, arg_min(status, id) AS status
FROM matches GROUP BY 1, 2, 3, 4, 5""")
def s6_loaded_competition_matches(spark, sf_dir):
    """Documents that misspell every team (two letters in the middle change
    places, or the last is doubled) end up in the match table under the team meant."""
    t = tables(spark, sf_dir)
    n, mid = F.col("name"), F.floor(F.length("name") / 2).cast("int")
    swapped = F.concat(n.substr(F.lit(1), mid - 1), n.substr(mid + 1, F.lit(1)), n.substr(mid, F.lit(1)),
                       n.substr(mid + 2, F.length(n)))
    wrong = t.teams.withColumn("name", F.when(F.length(n) >= 8, swapped).otherwise(F.concat(n, F.substring(n, -1, 1))))
    docs = _competition(spark, t.matches, wrong)
    rows, _ = names.load_competition_matches(docs, t.teams, t.matches.limit(0), F.year("match_date"))
    return rows.drop("id")


LOGGED = ("orders", "customer", "nation")


@register("s8_collection_log", "\nUNION ALL\n".join(
    f"SELECT 'tables' AS source, '{n}' AS data_type, COUNT(*) AS records_collected, COUNT(*) > 0 AS success FROM {n}" for n in LOGGED))
def s8_collection_log(spark, sf_dir):
    """A log row appended for every table read, with the rows observed in it."""
    t, path = tables(spark, sf_dir), scratch_dir(spark, f"log-{uuid.uuid4().hex}")
    for n in LOGGED:
        df, seen = ingest.observed(t.raw(n), n)
        df.write.format("noop").mode("overwrite").save()
        ingest.log_collection(spark, path, "tables", n, seen.get["records"], seen.get["records"] > 0)
    return spark.read.schema(SC.DATA_COLLECTION_LOG).parquet(path).select("source", "data_type", "records_collected", "success")


@register("s12_conformed_players", with_views("players") + """
SELECT id, name, position, NULL::VARCHAR AS nationality, NULL::INTEGER AS age, squad_number, team_id,
  CASE WHEN id % 3 = 0 THEN TRUE ELSE is_active END AS is_active FROM players""")
def s12_conformed_players(spark, sf_dir):
    """Declared columns, absent ones as typed NULLs, defaults for NULLs (here: every third is_active)."""
    t = tables(spark, sf_dir)
    p = t.players.withColumn("is_active", F.when(F.col("id") % 3 != 0, F.col("is_active")))
    return SC.apply_defaults(SC.conform(p, "players"), "players").select(
        "id", "name", "position", "nationality", "age", "squad_number", "team_id", "is_active")


@register("s12_seeded_teams", with_views("teams") + f"""
SELECT id, name, short_name, NULL::INTEGER AS founded_year, NULL::VARCHAR AS stadium FROM teams
UNION ALL SELECT {SC.SEED_TEAM[0]}, '{SC.SEED_TEAM[1]}', '{SC.SEED_TEAM[2]}', {SC.SEED_TEAM[3]}, '{SC.SEED_TEAM[4]}'""")
def s12_seeded_teams(spark, sf_dir):
    teams = SC.conform(tables(spark, sf_dir).teams, "teams").unionByName(SC.seed_frames(spark)["teams"])
    return teams.select("id", "name", "short_name", "founded_year", "stadium")


@register("s15_exported_kpis", ORACLES["a20_season_kpis"])
def s15_exported_kpis(spark, sf_dir):
    """An analysis exported as JSON records and read back."""
    kpis = perf.season_kpis(tables(spark, sf_dir).matches)
    path = scratch_dir(spark, f"export-{uuid.uuid4().hex}")
    ingest.export_records(kpis, path)
    return spark.read.schema(kpis.schema).json(path)
