"""Driver tables -> sport-shaped tables.

The test data is a TPC-H-style star schema.  This module turns it into the
ten sport tables the analyses read (teams, seasons, matches, ...), with one
SQL text per table.  The same text is rendered for Spark (DataFrame
arguments of ``spark.sql``) and for DuckDB (a ``WITH`` prefix in the oracle
queries), so both engines see identical inputs.

Only integer arithmetic is used, and every double -> integer cast goes
through ``FLOOR`` (Spark truncates, DuckDB rounds).

Fixed values: focal team id 9 (short name 'N9'); current season 1997.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FOCAL_SHORT_NAME = "N9"
FOCAL_TEAM_ID = 9
CURRENT_SEASON_ID = 1997

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Each entry: name -> (sql template, tables it reads).  Templates reference
# their inputs as {name}; raw driver tables and mapped tables alike.
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "teams": (
        """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
  'N' || CAST(n_nationkey AS STRING) AS short_name
FROM {nation}""",
        ("nation",),
    ),
    "seasons": (
        """SELECT DISTINCT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS id,
  CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING) AS season_name,
  EXTRACT(YEAR FROM o_orderdate) = 1997 AS is_current
FROM {orders}""",
        ("orders",),
    ),
    "matches": (
        """SELECT o_orderkey AS id, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS season_id,
  CAST(EXTRACT(WEEK FROM o_orderdate) AS BIGINT) AS gameweek, o_orderdate AS match_date,
  CAST(c_nationkey AS BIGINT) AS home_team_id,
  CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS BIGINT) AS away_team_id,
  CAST(FLOOR(o_totalprice) AS BIGINT) % 5 AS home_score,
  CAST(FLOOR(o_totalprice / 100) AS BIGINT) % 4 AS away_score,
  CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'scheduled' ELSE 'live' END AS status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
        ("orders", "customer"),
    ),
    "match_stats": (
        """SELECT id AS match_id, season_id, match_date, home_team_id AS team_id, TRUE AS is_home,
  CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(30 + id % 41 AS DOUBLE) END AS possession_percent,
  5 + (id * 7) % 16 AS shots_total, (id * 7) % 5 AS shots_on_target,
  CAST(70 + (id * 13) % 21 AS DOUBLE) AS pass_accuracy_percent,
  CASE id % 5 WHEN 0 THEN '4-2-3-1' WHEN 1 THEN '4-3-3' WHEN 2 THEN '3-5-2' WHEN 3 THEN '4-4-2' END AS formation
FROM {matches}
UNION ALL
SELECT id, season_id, match_date, away_team_id, FALSE,
  CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(70 - id % 41 AS DOUBLE) END,
  4 + (id * 5) % 13, (id * 5) % 4, CAST(68 + (id * 17) % 23 AS DOUBLE),
  CASE (id + away_team_id) % 5 WHEN 0 THEN '4-2-3-1' WHEN 1 THEN '4-3-3' WHEN 2 THEN '3-5-2' WHEN 3 THEN '4-4-2' END
FROM {matches}""",
        ("matches",),
    ),
    # every (team, supplier) that occurs in a line is a player, so players
    # grow with the data; id = supplier * 25 + team
    "players": (
        """SELECT l_suppkey * 25 + team_id AS id, 'Player ' || CAST(l_suppkey * 25 + team_id AS STRING) AS name,
  CASE l_suppkey % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS position,
  l_suppkey % 99 + 1 AS squad_number, team_id, l_suppkey % 7 <> 6 AS is_active
FROM (SELECT DISTINCT l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN m.home_team_id ELSE m.away_team_id END AS team_id
  FROM {lineitem} JOIN {matches} m ON l_orderkey = m.id) x""",
        ("lineitem", "matches"),
    ),
    # lines of one player in one match add up
    "player_match_stats": (
        """SELECT match_id, player_id, team_id, season_id, match_date,
  CAST(SUM(minutes_played) AS BIGINT) AS minutes_played, CAST(SUM(goals) AS BIGINT) AS goals,
  CAST(SUM(assists) AS BIGINT) AS assists, CAST(SUM(shots_total) AS BIGINT) AS shots_total,
  CAST(SUM(shots_on_target) AS BIGINT) AS shots_on_target, CAST(SUM(key_passes) AS BIGINT) AS key_passes,
  CAST(SUM(passes_total) AS BIGINT) AS passes_total, CAST(SUM(passes_accurate) AS BIGINT) AS passes_accurate,
  CAST(SUM(tackles) AS BIGINT) AS tackles, CAST(SUM(interceptions) AS BIGINT) AS interceptions,
  CAST(SUM(clearances) AS BIGINT) AS clearances,
  CAST(FLOOR(SUM(rating10) / COUNT(rating10)) AS DOUBLE) / 10 AS rating
FROM (SELECT m.id AS match_id, m.season_id, m.match_date,
    CASE WHEN l_linenumber % 2 = 0 THEN m.home_team_id ELSE m.away_team_id END AS team_id,
    l_suppkey * 25 + CASE WHEN l_linenumber % 2 = 0 THEN m.home_team_id ELSE m.away_team_id END AS player_id,
    CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE 40 + CAST(FLOOR(l_quantity) AS BIGINT) END AS minutes_played,
    CAST(FLOOR(l_extendedprice) AS BIGINT) % 3 AS goals, l_partkey % 3 AS assists,
    3 + l_partkey % 4 AS shots_total, l_partkey % 4 AS shots_on_target, l_partkey % 5 AS key_passes,
    20 + l_partkey % 31 AS passes_total, 10 + l_partkey % 11 AS passes_accurate,
    l_suppkey % 6 AS tackles, l_suppkey % 4 AS interceptions, l_suppkey % 7 AS clearances,
    CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE 50 + l_partkey % 50 END AS rating10
  FROM {lineitem} JOIN {matches} m ON l_orderkey = m.id) x
GROUP BY match_id, player_id, team_id, season_id, match_date""",
        ("lineitem", "matches"),
    ),
    "shots": (
        """SELECT m.id AS match_id, m.season_id, m.match_date,
  CASE WHEN l_linenumber % 2 = 0 THEN m.home_team_id ELSE m.away_team_id END AS team_id,
  l_suppkey * 25 + CASE WHEN l_linenumber % 2 = 0 THEN m.home_team_id ELSE m.away_team_id END AS player_id,
  CAST(FLOOR(l_quantity) AS BIGINT) AS minute,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(l_partkey % 101 AS DOUBLE) END AS x_coordinate,
  CAST((l_orderkey * 7 + l_partkey) % 101 AS DOUBLE) AS y_coordinate,
  CASE l_partkey % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'right_foot' ELSE 'left_foot' END AS shot_type,
  CASE l_linestatus WHEN 'O' THEN 'open_play' ELSE 'corner' END AS situation,
  l_returnflag = 'R' AS is_goal, l_returnflag <> 'N' AS is_on_target, l_discount AS xg_value
FROM {lineitem} JOIN {matches} m ON l_orderkey = m.id""",
        ("lineitem", "matches"),
    ),
    # final positions from the finished matches of a season; NULL (not yet
    # known) for every sixth team
    "opposition_categories": (
        """SELECT team_id, season_id, CASE WHEN team_id % 6 <> 5 THEN final_position END AS final_position
FROM (SELECT team_id, season_id, CAST(ROW_NUMBER() OVER (PARTITION BY season_id
    ORDER BY SUM(points) DESC, SUM(difference) DESC, team_id) AS BIGINT) AS final_position
  FROM (SELECT season_id, home_team_id AS team_id, home_score - away_score AS difference,
      CASE WHEN home_score > away_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END AS points
    FROM {matches} WHERE status = 'finished'
    UNION ALL
    SELECT season_id, away_team_id, away_score - home_score,
      CASE WHEN home_score < away_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END
    FROM {matches} WHERE status = 'finished') x
  GROUP BY team_id, season_id) y""",
        ("matches",),
    ),
    "data_collection_log": (
        """SELECT event_id AS id, event_type AS source, 'user_' || CAST(user_id % 5 AS STRING) AS data_type,
  user_id AS records_collected, event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN 'failed' END AS error_message,
  value AS execution_time_seconds, ts AS collected_at
FROM {events}""",
        ("events",),
    ),
    # Landed source documents, flattened (the input of the S9-S11 loaders).
    "src_teams": (
        """SELECT CAST(n_nationkey + 100 AS BIGINT) AS id, n_name AS name,
  'N' || CAST(n_nationkey AS STRING) AS short_name
FROM {nation}
UNION ALL
SELECT CAST(r_regionkey + 200 AS BIGINT), r_name, 'R' || CAST(r_regionkey AS STRING)
FROM {region}""",
        ("nation", "region"),
    ),
    "src_elements": (
        """SELECT s_suppkey AS id, 'Player' AS first_name,
  CASE WHEN s_suppkey % 5 = 0 THEN 'New ' ELSE '' END || CAST(s_suppkey * 25 + s_nationkey AS STRING) AS second_name,
  CAST(s_nationkey + 100 AS BIGINT) AS team, s_suppkey % 5 AS element_type,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey * 37 END AS code,
  CASE WHEN s_suppkey % 4 = 0 THEN 'u' ELSE 'a' END AS status
FROM {supplier}""",
        ("supplier",),
    ),
    "src_fixtures": (
        """SELECT id, gameweek AS event,
  CASE WHEN id % 3 = 0 THEN match_date + INTERVAL 1 DAY ELSE match_date END AS kickoff_time,
  home_team_id + 100 AS team_h, away_team_id + 100 AS team_a,
  home_score AS team_h_score, away_score AS team_a_score,
  status <> 'scheduled' AS started, status = 'finished' AS finished
FROM {matches}""",
        ("matches",),
    ),
}


def _closure(names) -> list[str]:
    """Mapped views needed by ``names``, dependencies first."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n not in VIEWS:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def oracle_prefix(*names: str) -> str:
    """``WITH`` clause defining the mapped views for DuckDB."""
    views = _closure(names)
    parts = []
    for v in views:
        sql, deps = VIEWS[v]
        parts.append(f"{v} AS (\n{sql.format(**{d: d for d in deps})}\n)")
    return "WITH " + ",\n".join(parts) + "\n"


# Lines of one task.  The mapped facts of a match are grouped and sorted where
# its lines are; a plain scan or a shuffle merged by bytes deals them by size on
# disk, which says little of what a task holds.
LINES_PER_TASK = 400_000


def line_tasks(lines: DataFrame) -> int | None:
    """Tasks over which ``lineitem`` and what is made of its rows are dealt,
    ``LINES_PER_TASK`` to each; None while the session's shuffle partitions
    are enough for that."""
    rows = lines.count()                                   # from the footers
    session = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_default = min(session, lines.sparkSession.sparkContext.defaultParallelism)
    return None if rows <= LINES_PER_TASK * by_default else max(session, -(-rows // LINES_PER_TASK))


def dealt_lines(lines: DataFrame) -> DataFrame:
    """``lineitem`` dealt by match over its ``line_tasks``."""
    tasks = line_tasks(lines)
    return lines if tasks is None else lines.repartition(tasks, "l_orderkey")


class SportTables:
    """Lazily mapped sport tables over one driver directory.

    Attribute access (``t.matches``) returns a DataFrame; each is built once
    per instance so that plans built from it share their scans.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        key = "raw:" + name
        if key not in self._cache:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._cache[key] = dealt_lines(df) if name == "lineitem" else df
        return self._cache[key]

    def tasks(self) -> int | None:
        """``line_tasks`` of this directory: what the player analyses deal their rows over."""
        return line_tasks(self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._cache:
            sql, deps = VIEWS[name]
            args = {d: (getattr(self, d) if d in VIEWS else self.raw(d)) for d in deps}
            self._cache[name] = self.spark.sql(sql, **args)
        return self._cache[name]


def sport_tables(spark: SparkSession, sf_dir: str) -> SportTables:
    return SportTables(spark, sf_dir)
