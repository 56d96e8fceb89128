"""Query catalog: every registered analysis as a Spark callable
``(spark, sf_dir) -> DataFrame`` plus, where SQL can express it, the
equivalent DuckDB SQL over the driver tables (the correctness oracle).

The Spark side calls the library functions on the mapped sport tables; the
oracle side is written independently as SQL (long form by ``UNION ALL``,
plain window functions, brute-force where needed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.sources.fixture_map import oracle_prefix, sport_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed parameters of the registered queries.
FOCAL_SHORT_NAME = "N9"
AS_OF = "1998-03-01"


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str):
    """Sport tables for ``sf_dir``: a stored layout (``sources.layout``) is
    read as is; a directory of driver tables is mapped on the fly."""
    from touchline.sources.layout import StoredTables, read_marker
    if read_marker(spark, sf_dir) is not None:
        return StoredTables(spark, sf_dir)
    return sport_tables(spark, sf_dir)


# Long form of finished matches for the oracle side.
LF_SQL = """lf AS (
  SELECT id AS match_id, season_id, gameweek, match_date, home_team_id, away_team_id, home_score, away_score,
         home_team_id AS team_id, away_team_id AS opponent_id, TRUE AS is_home,
         home_score AS goals_for, away_score AS goals_against
  FROM matches WHERE status = 'finished'
  UNION ALL
  SELECT id, season_id, gameweek, match_date, home_team_id, away_team_id, home_score, away_score,
         away_team_id, home_team_id, FALSE, away_score, home_score
  FROM matches WHERE status = 'finished'
)"""


def with_views(*views: str, extra: str = "") -> str:
    """``WITH`` prefix: mapped views, then optional extra CTEs."""
    pre = oracle_prefix(*views)
    if extra:
        pre = pre.rstrip("\n") + ",\n" + extra + "\n"
    return pre


# Register the analysis modules (import for side effects).
from touchline.plans import queries_core  # noqa: E402,F401
from touchline.plans import queries_players  # noqa: E402,F401
from touchline.plans import queries_features  # noqa: E402,F401
from touchline.plans import queries_quality  # noqa: E402,F401
from touchline.plans import queries_sources  # noqa: E402,F401
from touchline.plans import queries_models  # noqa: E402,F401
from touchline.plans import queries_streaming  # noqa: E402,F401
from touchline.plans import queries_extra  # noqa: E402,F401
