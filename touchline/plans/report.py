"""The weekly report bundle.

The reference builds a dict of already-fetched results; here the bundle is a
dict of lazy DataFrames (nothing is collected), plus a one-row header frame
whose section counts are scalar subqueries.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import performance as perf
from touchline.operators import players as pl
from touchline.operators import tactics as tc


def weekly_report(spark: SparkSession, tables, *, as_of: str, team_id: int, season_id: int,
                  season_label: str | None = None) -> dict[str, DataFrame]:
    """Sections: performance (A21), players (A6), tactics (A12), fixtures
    (A25) for one team, and a header with report date, ISO week and counts."""
    t = tables
    sections = {
        "performance": perf.weekly_results(t.matches, t.teams, as_of=as_of, team_id=team_id),
        "players": pl.top_performers(t.players, t.player_match_stats, t.matches, team_id=team_id,
                                     season_id=season_id),
        "tactics": tc.formation_effectiveness(t.match_stats, t.matches, team_id=team_id,
                                              season_id=season_id),
        "fixtures": perf.upcoming_fixtures(t.matches, t.teams, as_of=as_of, team_id=team_id),
    }
    day = _dt.date.fromisoformat(str(as_of)[:10])
    header = spark.range(1).select(
        F.lit(day).alias("report_day"),
        F.date_format(F.lit(day), "yyyy-MM-dd").alias("report_date"),
        F.weekofyear(F.lit(day)).alias("week_number"),
        F.lit(season_label if season_label is not None else str(season_id)).alias("season"),
        *[sections[k].agg(F.count(F.lit(1))).scalar().alias(f"n_{k}") for k in sections],
    ).drop("report_day")
    return {"header": header, **sections}
