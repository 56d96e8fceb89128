"""League table by gameweek (A23, W6) and opposition categories.

The season timeline is (gameweek, match_date, match_id).  A snapshot at
gameweek g holds every team of the season with its running totals over
its finished matches of gameweeks <= g, its position and its last-5 form.
The snapshot grid is (teams of a season) x (gameweeks of a season): its
size follows the number of teams and weeks, not the number of matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import expressions as X
from touchline.operators.longform import team_matches
from touchline.operators.sequence import ordered_prefix
from touchline.sources.schemas import conform

FORM_LENGTH = 5


def _weekly_form(lf: DataFrame, k: int = FORM_LENGTH) -> DataFrame:
    """Form string (newest first) of each (season, team, gameweek with
    matches): its last ``k`` results up to that week.  Only the newest ``k``
    results of a team's week can matter, so weeks are cut to those first (a
    rank limit that Spark applies in every map task); the running window then
    holds ``k`` rows a week of one team's season."""
    week = Window.partitionBy("season_id", "team_id", "gameweek").orderBy(F.desc("match_date"), F.desc("match_id"))
    newest = (lf.select("season_id", "team_id", "gameweek", "match_date", "match_id", "result")
              .withColumn("_rn", F.row_number().over(week)).filter(F.col("_rn") <= k))
    run = Window.partitionBy("season_id", "team_id").orderBy("gameweek", "match_date", "match_id").rowsBetween(1 - k, 0)
    return (newest.withColumn("form", F.array_join(F.reverse(F.collect_list("result").over(run)), ""))
            .filter(F.col("_rn") == 1).select("season_id", "team_id", "gameweek", "form"))


TOTALS = {"matches_played": "w_played", "wins": "w_wins", "draws": "w_draws", "losses": "w_losses",
          "goals_for": "w_gf", "goals_against": "w_ga"}


def _weekly(lf: DataFrame) -> DataFrame:
    gf, ga = F.col("goals_for"), F.col("goals_against")
    return lf.groupBy("season_id", "gameweek", "team_id").agg(
        F.count(F.lit(1)).alias("w_played"),
        X.count_when(gf > ga).alias("w_wins"),
        X.count_when(gf == ga).alias("w_draws"),
        X.count_when(gf < ga).alias("w_losses"),
        F.coalesce(F.sum("goals_for"), F.lit(0)).alias("w_gf"),
        F.coalesce(F.sum("goals_against"), F.lit(0)).alias("w_ga"),
    )


def _grid(teams: DataFrame, weekly: DataFrame) -> DataFrame:
    season_weeks = weekly.select("season_id", "gameweek").distinct()
    return teams.join(season_weeks, "season_id").join(weekly, ["season_id", "gameweek", "team_id"], "left") \
        .fillna(0, subset=list(TOTALS.values()))


def _running(g: DataFrame, *others: str) -> DataFrame:
    run = Window.partitionBy("season_id", "team_id").orderBy("gameweek") \
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return g.select("season_id", "gameweek", "team_id", *[F.sum(w).over(run).alias(name) for name, w in TOTALS.items()],
                    *others)


def _with_position(t: DataFrame) -> DataFrame:
    t = t.withColumns({
        "goal_difference": F.col("goals_for") - F.col("goals_against"),
        "points": F.col("wins") * 3 + F.col("draws"),
    })
    rank_w = Window.partitionBy("season_id", "gameweek").orderBy(
        F.desc("points"), F.desc("goal_difference"), F.desc("goals_for"))
    return t.withColumn("position", F.rank().over(rank_w).cast("bigint"))


def league_table(matches: DataFrame, *, season_id=None) -> DataFrame:
    """A23 + W6: one row per (season, gameweek, team)."""
    lf = team_matches(matches, season_id=season_id)
    weekly = _weekly(lf)
    t = _with_position(_running(_grid(weekly.select("season_id", "team_id").distinct(), weekly)))
    weeks = Window.partitionBy("season_id", "team_id").orderBy("gameweek")
    return (t.join(_weekly_form(lf), ["season_id", "team_id", "gameweek"], "left")
            .withColumn("form", F.last("form", ignorenulls=True).over(weeks)))


def continued_table(matches: DataFrame, since: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of ``league_table`` from a gameweek on, without the matches
    before it.  ``since`` has one row per season: season_id, from_gameweek
    (null: the whole season); ``stored`` holds right rows of the weeks before.

    The last stored week before ``from_gameweek`` stands for all earlier
    matches: its totals are added like those of one more week, its form string
    follows the results since.  A season must have the same teams in
    ``stored`` as in ``matches``; else take the whole season."""
    begin = F.col("from_gameweek")
    lf = team_matches(matches.join(since, "season_id").filter(begin.isNull() | (F.col("gameweek") >= begin))
                      .drop("from_gameweek"))
    earlier = stored.join(since, "season_id").filter(F.col("gameweek") < begin).drop("from_gameweek")
    last = earlier.groupBy("season_id").agg(F.max("gameweek").alias("gameweek"))
    carry = earlier.join(last, ["season_id", "gameweek"])
    weekly = _weekly(lf)
    teams = weekly.select("season_id", "team_id").union(carry.select("season_id", "team_id")).distinct()
    played = _grid(teams, weekly).withColumn("_carried", F.lit(False)) \
        .join(_weekly_form(lf), ["season_id", "team_id", "gameweek"], "left")
    before = carry.select("season_id", "gameweek", "team_id", *[F.col(n).alias(w) for n, w in TOTALS.items()],
                          F.lit(True).alias("_carried"), "form")
    weeks = Window.partitionBy("season_id", "team_id").orderBy("gameweek")
    old = F.coalesce(F.max(F.when(F.col("_carried"), F.col("form"))).over(
        Window.partitionBy("season_id", "team_id")), F.lit(""))
    form = F.when(F.col("_carried"), F.col("form")).when(
        F.col("form").isNotNull(), F.substring(F.concat("form", old), 1, FORM_LENGTH))
    rows = _running(played.unionByName(before).withColumn("form", form), "_carried", "form") \
        .withColumn("form", F.last("form", ignorenulls=True).over(weeks))
    return _with_position(rows.filter(~F.col("_carried")).drop("_carried"))


def snapshot_rows(table: DataFrame, *, snapshot_date, first_id: int = 1) -> DataFrame:
    """The league table as rows of the declared ``league_table_snapshots``:
    ids in the order (season, gameweek, team) from ``first_id`` on, and the
    date of the snapshot.  The numbering runs per (season, gameweek)."""
    chunk = F.col("season_id") * 100 + F.col("gameweek")
    p = ordered_prefix(table, [], ["season_id", "gameweek", "team_id"], chunk=chunk)
    rows = p.withColumns({"id": F.col("seq") + (first_id - 1), "snapshot_date": F.lit(str(snapshot_date)).cast("timestamp_ntz")})
    return conform(rows, "league_table_snapshots")


def opposition_categories(table: DataFrame) -> DataFrame:
    """Final position (last gameweek of the season) and its category."""
    last = table.groupBy("season_id").agg(F.max("gameweek").alias("gameweek"))
    final = table.join(last, ["season_id", "gameweek"])
    return final.select("team_id", "season_id", F.col("position").alias("final_position"),
                        X.category_from_position("position").alias("category"))
