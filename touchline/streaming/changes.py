"""What has changed in the match table since a derived table was refreshed.

A derived table lives in a state folder: its rows under ``table`` and, under
``taken``, one row per finished refresh with the commit-log entries it had
read.  A refresh takes the matches of the entries that are live now and were
not then, compares their old and new versions, brings the derived rows up to
date, and last notes the live entries.  A refresh that stops half way leaves
no note, so the next one finds the same changes again; what it writes must
not depend on rows that it rewrites.  One refresh of a state runs at a time.

The data folders of the noted entries give the old versions.  If they have
been retired since, or nothing was noted yet, there are no old versions and
the derived table is built anew.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.streaming import commits
from touchline.streaming.match_day import MATCH_UPDATE, newest_per_match

_TAKEN = "entries array<string>, at timestamp_ntz"
#: columns of a finished match that derived tables are computed from
RESULT = ("season_id", "gameweek", "match_date", "home_team_id", "away_team_id", "home_score", "away_score")


def taken(spark: SparkSession, state: str) -> list[str] | None:
    """The entries that the last finished refresh had read; None before the first."""
    try:
        notes = spark.read.schema(_TAKEN).json(f"{state}/taken")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    last = notes.agg(F.max_by("entries", "at").alias("entries")).first()
    return last["entries"]


def note(spark: SparkSession, state: str, entries: list[str]) -> None:
    at = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(entries, at)], _TAKEN).coalesce(1).write.mode("append").json(f"{state}/taken")


def versions(spark: SparkSession, table: str, entries: list[str]) -> DataFrame:
    """All match versions of some entries."""
    if not entries:
        return spark.createDataFrame([], MATCH_UPDATE)
    return spark.read.schema(MATCH_UPDATE).parquet(*[commits.data_folder(table, e) for e in entries])


def match_changes(spark: SparkSession, table: str, known: list[str] | None, live: list[str]) -> DataFrame | None:
    """Matches whose result differs between the entries ``known`` and ``live``:
    id, ``was`` and ``now``, structs of RESULT, null where the match was or is
    not finished.  None if the old versions are gone."""
    if known is None:
        return None
    try:
        old = versions(spark, table, known)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    had = set(known)
    ids = versions(spark, table, [e for e in live if e not in had]).select("id").distinct()
    result = F.when(F.col("status") == "finished", F.struct(*RESULT))

    def newest(versions: DataFrame, name: str) -> DataFrame:
        return newest_per_match(versions.join(ids, "id", "left_semi")).select("id", result.alias(name))

    both = newest(versions(spark, table, live), "now").join(newest(old, "was"), "id", "left")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("id", "was", "now")


def touched(changes: DataFrame) -> DataFrame:
    """Old and new results of the changes, a row each: id and RESULT."""
    return changes.select("id", F.explode(F.array("was", "now")).alias("v")).filter("v is not null").select("id", "v.*")
