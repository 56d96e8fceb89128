"""A23 / A24 kept up to date: the league table as stored partitions of one
(season, gameweek) each, of which a refresh rewrites those that the changed
matches can reach.

A changed match touches its season from the earlier of its old and new
gameweek on.  The week before that is read back from the store and carries
all earlier results (``league.continued_table``), so the earlier part of the
season is neither read nor written.  A season whose set of teams changes is
rewritten whole, as every week lists all teams of the season; so is one with a
change in a match without a gameweek.  A week that has lost its last match
keeps one row without a team, which readers pass over.

Partitions are replaced by dynamic overwrite when all rows are ready; a
refresh that is repeated reads only weeks before those it writes, so it
writes the same rows again.  A reader during the replacement may see old and
new weeks side by side.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.league import continued_table
from touchline.operators.longform import team_matches
from touchline.session import ensure_checkpoint_dir
from touchline.streaming import changes as ch
from touchline.streaming import commits
from touchline.streaming.match_day import newest_per_match

LEAGUE_ROW = ("team_id long, matches_played long, wins long, draws long, losses long, goals_for long, "
              "goals_against long, goal_difference long, points long, position long, form string, "
              "season_id long, gameweek long")


def _partitions(spark: SparkSession, state: str) -> DataFrame:
    try:
        return spark.read.schema(LEAGUE_ROW).parquet(f"{state}/table")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], LEAGUE_ROW)
        raise


def stored_league_table(spark: SparkSession, state: str) -> DataFrame:
    """The league table as of the last refresh, as ``league.league_table`` gives it."""
    return _partitions(spark, state).filter(F.col("team_id").isNotNull())


def first_weeks(changes: DataFrame) -> DataFrame:
    """season_id, from_gameweek: where each touched season has to be rewritten from; null: from its start."""
    weeks = ch.touched(changes).filter("season_id is not null").groupBy("season_id")
    return weeks.agg(F.when(F.count("gameweek") == F.count(F.lit(1)), F.min("gameweek")).alias("from_gameweek"))


def _whole_if_teams_differ(since: DataFrame, matches: DataFrame, stored: DataFrame) -> DataFrame:
    now = team_matches(matches).select("season_id", "team_id").distinct().withColumn("_now", F.lit(1))
    had = stored.select("season_id", "team_id").distinct().withColumn("_had", F.lit(1))
    other = now.join(had, ["season_id", "team_id"], "full").filter("_now is null or _had is null") \
        .select("season_id").distinct().withColumn("_whole", F.lit(True))
    return since.join(other, "season_id", "left").select(
        "season_id", F.when(F.col("_whole").isNull(), F.col("from_gameweek")).alias("from_gameweek"))


def rewrite_league_table(matches: DataFrame, since: DataFrame, state: str) -> list:
    """Rewrite the stored weeks of the seasons in ``since`` (season_id,
    from_gameweek) from ``matches``; returns what was rewritten as rows of
    (season_id, from_gameweek), one a touched season."""
    spark = matches.sparkSession
    ensure_checkpoint_dir(spark)
    seasons = [r["season_id"] for r in since.select("season_id").collect()]
    if not seasons:
        return []
    here = F.col("season_id").isin(seasons)                       # a filter on partitions, where there are some
    matches, parts = matches.filter(here), _partitions(spark, state).filter(here)
    stored = parts.filter(F.col("team_id").isNotNull())
    since = _whole_if_teams_differ(since, matches, stored).checkpoint()
    rows = continued_table(matches, since, stored).checkpoint()
    begin = F.col("from_gameweek")
    old = parts.select("season_id", "gameweek").distinct().join(since, "season_id") \
        .filter(begin.isNull() | (F.col("gameweek") >= begin))
    weeks = rows.select(F.col("season_id").alias("_s"), F.col("gameweek").alias("_g")).distinct()
    empty = old.join(weeks, (F.col("season_id") == F.col("_s")) & F.col("gameweek").eqNullSafe(F.col("_g")), "left_anti")
    gone = empty.select(*[F.col(f.name) if f.name in ("season_id", "gameweek") else F.lit(None).cast(f.dataType).alias(f.name)
                          for f in parts.schema])
    rows.select(*parts.columns).union(gone).repartition("season_id", "gameweek").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("season_id", "gameweek").parquet(f"{state}/table")
    return since.collect()


def refresh_league_table(spark: SparkSession, table: str, state: str) -> list:
    """Bring the league table in ``state`` up to the last commit of the match
    table ``table``; returns the rewritten (season_id, from_gameweek)."""
    live = commits.live_entries(spark, table)
    matches = newest_per_match(ch.versions(spark, table, live))
    changes = ch.match_changes(spark, table, ch.taken(spark, state), live)
    if changes is None:
        seasons = matches.select("season_id").union(_partitions(spark, state).select("season_id"))
        since = seasons.filter("season_id is not null").distinct().withColumn("from_gameweek", F.lit(None).cast("long"))
    else:
        since = first_weeks(changes)
    done = rewrite_league_table(matches, since, state)
    ch.note(spark, state, live)
    return done
