"""M8 kept up to date: the newest results of every team and of every pair of
teams, merged with the changed matches of each refresh.

A key (kind, a, b) is a team (a = b) or a pair (a < b).  Its state is the
array of its newest N finished matches, newest first.  A refresh removes the
changed matches from the arrays of the touched keys, adds their new results
and keeps the newest N.  That is exact while N of them are at least as new as
the oldest match of the old array, since all matches outside it are older; and
also if the old array had room, since it then held every match of the key.
Only keys for which neither holds (a recent match was taken away or moved far
back) are read from the match table again.

Touched keys are written as a batch of a table with a commit log of its own;
the newest version of a key counts.  A refresh that is repeated removes and
adds the same matches once more, which changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators import features as ft
from touchline.operators.sequence import last_n, time_chunk
from touchline.session import ensure_checkpoint_dir
from touchline.streaming import changes as ch
from touchline.streaming import commits
from touchline.streaming.match_day import newest_per_match

KEY = ["kind", "a", "b"]
TEAM_N, PAIR_N = 5, 10
RESULTS = "array<struct<match_date:timestamp_ntz,match_id:bigint,goals:bigint,value:double>>"
STATE = f"kind string, a bigint, b bigint, newest {RESULTS}, version bigint"


def _n(team_n: int, pair_n: int) -> Column:
    return F.when(F.col("kind") == "team", F.lit(team_n)).otherwise(F.lit(pair_n))


def _keyed(results: DataFrame) -> DataFrame:
    """kind, a, b, match_date, match_id, goals, value: a finished match for
    both of its teams (win or not) and for their pair (1, 0.5 or 0).  Matches
    without a date have no place in the order and take no part."""
    hs, as_ = F.col("home_score"), F.col("away_score")

    def team(id_col: str, gf: Column, ga: Column) -> Column:
        return F.struct(F.lit("team").alias("kind"), F.col(id_col).alias("a"), F.col(id_col).alias("b"),
                        gf.alias("goals"), F.when(gf > ga, F.lit(1.0)).otherwise(F.lit(0.0)).alias("value"))

    pair = F.struct(F.lit("pair").alias("kind"), F.least("home_team_id", "away_team_id").alias("a"),
                    F.greatest("home_team_id", "away_team_id").alias("b"), F.lit(None).cast("long").alias("goals"),
                    F.when(hs > as_, F.lit(1.0)).when(hs == as_, F.lit(0.5)).otherwise(F.lit(0.0)).alias("value"))
    return results.filter(F.col("match_date").isNotNull()).select(
        "match_date", F.col("id").alias("match_id"),
        F.inline(F.array(team("home_team_id", hs, as_), team("away_team_id", as_, hs), pair))).filter("a is not null")


def _arrays(rows: DataFrame) -> DataFrame:
    """Of at most N rows a key (match_date, match_id, goals, value): newest first."""
    row = F.struct("match_date", "match_id", "goals", "value")
    return rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(row), asc=False).alias("newest"))


def _from_matches(matches: DataFrame, team_n: int, pair_n: int, keys: DataFrame | None = None) -> DataFrame:
    rows = _keyed(matches.filter(F.col("status") == "finished"))
    if keys is not None:
        rows = rows.join(keys, KEY, "left_semi")
    newest = last_n(rows, KEY, ["match_date", "match_id"], chunk=time_chunk(), n=max(team_n, pair_n))
    return _arrays(newest.filter(F.col("recency") <= _n(team_n, pair_n)))


def _newest(rows: DataFrame, team_n: int, pair_n: int) -> DataFrame:
    # the plain limit first: Spark applies it in every map task
    order = Window.partitionBy(*KEY).orderBy(F.desc("match_date"), F.desc("match_id"))
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max(team_n, pair_n)) \
        .filter(F.col("_rn") <= _n(team_n, pair_n)).drop("_rn")


def form_state(spark: SparkSession, state: str) -> DataFrame:
    """kind, a, b, newest as of the last refresh."""
    rows, _ = commits.snapshot(spark, f"{state}/keys", STATE)
    return rows.groupBy(*KEY).agg(F.max_by("newest", "version").alias("newest"))


def merged(old: DataFrame, changes: DataFrame, matches: DataFrame, team_n: int = TEAM_N, pair_n: int = PAIR_N) -> DataFrame:
    """kind, a, b, newest of every key that ``changes`` touches (an empty
    array where no match is left), from the old arrays where they suffice."""
    now = _keyed(changes.filter("now is not null").select("id", "now.*"))
    keys = _keyed(ch.touched(changes)).select(*KEY).distinct().checkpoint()
    old = old.join(keys, KEY, "left_semi").checkpoint()
    kept = old.select(*KEY, F.inline("newest")).join(changes.select(F.col("id").alias("match_id")), "match_id", "left_anti")
    merged_ = _arrays(_newest(kept.unionByName(_newest(now, team_n, pair_n)), team_n, pair_n))
    last = F.get("newest", F.size("newest") - 1)
    before = old.select(*KEY, F.size("newest").alias("had"), last["match_date"].alias("_date"), last["match_id"].alias("_id"))
    both = keys.join(merged_, KEY, "left").join(before, KEY, "left") \
        .withColumn("newest", F.coalesce("newest", F.array().cast(RESULTS)))
    not_older = F.filter("newest", lambda r: F.struct(r["match_date"], r["match_id"]) >= F.struct("_date", "_id"))
    n = _n(team_n, pair_n)
    both = both.withColumn("_short", (F.coalesce("had", F.lit(0)) >= n) & (F.size(not_older) < n)).checkpoint()
    short = both.filter("_short").select(*KEY)
    again = short.join(_from_matches(matches, team_n, pair_n, short), KEY, "left") \
        .withColumn("newest", F.coalesce("newest", F.array().cast(RESULTS)))
    return both.filter("not _short").select(*KEY, "newest").unionByName(again.select(*KEY, "newest"))


def refresh_form(spark: SparkSession, table: str, state: str, *, team_n: int = TEAM_N, pair_n: int = PAIR_N) -> None:
    """Bring the state up to the last commit of the match table ``table``."""
    ensure_checkpoint_dir(spark)
    log = f"{state}/keys"
    live = commits.live_entries(spark, table)
    matches = newest_per_match(ch.versions(spark, table, live))
    changes = ch.match_changes(spark, table, ch.taken(spark, state), live)
    version = (commits.entries(spark, log).agg(F.max("batch_id")).first()[0] or 0) + 1
    replaced: list[str] = []
    if changes is None:
        rows, replaced = _from_matches(matches, team_n, pair_n), commits.live_entries(spark, log)
    else:
        changes = changes.checkpoint()
        rows = None if changes.isEmpty() else merged(form_state(spark, state), changes, matches, team_n, pair_n)
    if rows is not None:
        entry = commits.write_data(rows.withColumn("version", F.lit(version).cast("long")), log)
        commits.commit(spark, log, entry, "refresh", batch_id=version, replaces=replaced)
    ch.note(spark, state, live)


def compact_form(spark: SparkSession, state: str) -> None:
    """One version of every key in place of all batches so far."""
    log = f"{state}/keys"
    rows, live = commits.snapshot(spark, log, STATE)
    if len(live) > 1:
        newest = rows.groupBy(*KEY).agg(F.max_by("newest", "version").alias("newest"), F.max("version").alias("version"))
        last = commits.entries(spark, log).agg(F.max("batch_id")).first()[0]
        commits.commit(spark, log, commits.write_data(newest, log), "compaction", batch_id=last, replaces=live)


def fixture_features(spark: SparkSession, state: str, fixtures: DataFrame, *, focal_team_id=None) -> DataFrame:
    """M8 of the fixtures from the state, without a pass over past matches."""
    rows = form_state(spark, state).select(*KEY, F.inline("newest"))
    means = rows.groupBy(*KEY).agg(F.avg("value").alias("value"), F.avg("goals").alias("goals"))
    teams = means.filter("kind = 'team'").select(F.col("a").alias("team_id"), F.col("value").alias("form"),
                                                 F.col("goals").alias("avg_goals_for"))
    pairs = means.filter("kind = 'pair'").select(F.col("a").alias("pair_lo"), F.col("b").alias("pair_hi"),
                                                 F.col("value").alias("h2h"))
    return ft.fixture_rows(fixtures, teams, pairs, focal_team_id=focal_team_id)
