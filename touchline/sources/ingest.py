"""Ingestion: landed JSON documents (S3-S6), the collection log (S8) and
set-based insert-if-absent loaders for teams, players and fixtures (S9-S11).

The reference fetches documents over HTTP and inserts row by row with one or
two SQL round-trips per row.  Here documents are files already landed in
storage, read with explicit schemas; loaders are joins and anti-joins that
return the rows to append, numbered after the current maximum id.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions import expressions as X
from touchline.operators.sequence import ordered_prefix
from touchline.session import scratch_dir
from touchline.sources import schemas as SC

# ----------------------------------------------------------------- schemas
BOOTSTRAP_TEAM = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("short_name", T.StringType()),
])
BOOTSTRAP_ELEMENT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("first_name", T.StringType()),
    T.StructField("second_name", T.StringType()), T.StructField("team", T.LongType()),
    T.StructField("element_type", T.LongType()), T.StructField("code", T.LongType()),
    T.StructField("status", T.StringType()),
])
BOOTSTRAP = T.StructType([
    T.StructField("teams", T.ArrayType(BOOTSTRAP_TEAM)),
    T.StructField("elements", T.ArrayType(BOOTSTRAP_ELEMENT)),
])
FIXTURE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("event", T.LongType()),
    T.StructField("kickoff_time", T.StringType()), T.StructField("team_h", T.LongType()),
    T.StructField("team_a", T.LongType()), T.StructField("team_h_score", T.LongType()),
    T.StructField("team_a_score", T.LongType()), T.StructField("started", T.BooleanType()),
    T.StructField("finished", T.BooleanType()),
])
LIVE = T.StructType([
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("stats", T.MapType(T.StringType(), T.DoubleType())),
    ]))),
])
COMPETITION = T.StructType([
    T.StructField("matches", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("utcDate", T.StringType()),
        T.StructField("status", T.StringType()), T.StructField("matchday", T.LongType()),
        T.StructField("homeTeam", T.StructType([T.StructField("id", T.LongType()),
                                                T.StructField("name", T.StringType())])),
        T.StructField("awayTeam", T.StructType([T.StructField("id", T.LongType()),
                                                T.StructField("name", T.StringType())])),
        T.StructField("score", T.StructType([T.StructField("fullTime", T.StructType([
            T.StructField("home", T.LongType()), T.StructField("away", T.LongType())]))])),
    ]))),
])


# --------------------------------------------------------------- readers
BROKEN = "_broken"


def split_documents(spark: SparkSession, schema: T.StructType, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed JSON documents as (good rows with their ``file``,
    quarantined rows: file, record).  A document that does not parse, or does
    not fit the schema, is one quarantined row with its whole text, so no
    document vanishes."""
    wide = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    docs = (spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
            .json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path")))
    parsed = scratch_dir(spark, f"landed/{uuid.uuid4().hex}")           # parsed once, read by both sides
    docs.write.parquet(parsed)
    docs = spark.read.parquet(parsed)
    return (docs.filter(F.col(BROKEN).isNull()).drop(BROKEN),
            docs.filter(F.col(BROKEN).isNotNull()).select("file", F.col(BROKEN).alias("record")))


def quarantine(spark: SparkSession, schema: T.StructType, path: str, into: str) -> DataFrame:
    """Write the quarantined rows of ``path`` under ``into`` and return the
    account: file, good (rows), quarantined (rows), of every landed file that
    holds any."""
    good, bad = split_documents(spark, schema, path)
    bad.withColumn("quarantined_at", F.current_timestamp()).write.mode("append").parquet(into)
    rows = good.select("file", F.lit(1).alias("g")).unionByName(bad.select("file", F.lit(0).alias("g")))
    return rows.groupBy("file").agg(F.sum("g").cast("long").alias("good"), F.sum(1 - F.col("g")).cast("long").alias("quarantined"))


def read_bootstrap(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: bootstrap documents -> (teams, elements) frames."""
    doc = spark.read.schema(BOOTSTRAP).json(path, multiLine=True)
    return doc.select(F.inline("teams")), doc.select(F.inline("elements"))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Fixture documents (a top-level JSON array of fixtures)."""
    return spark.read.schema(FIXTURE).json(path, multiLine=True)


def read_gameweek_live(spark: SparkSession, path_glob: str) -> DataFrame:
    """Gameweek live documents; the gameweek comes from the file path
    (``.../event/<gw>/...``, ``.../gameweek=<gw>/...`` or ``..._<gw>.json``)."""
    doc = spark.read.schema(LIVE).json(path_glob, multiLine=True)
    path = F.input_file_name()
    gw = F.coalesce(F.nullif(F.regexp_extract(path, r"(?:event/|gameweek=)(\d+)/", 1), F.lit("")),
                    F.nullif(F.regexp_extract(path, r"_(\d+)\.json$", 1), F.lit("")))
    return doc.select(gw.cast("long").alias("gameweek"), F.explode("elements").alias("e")) \
        .select("gameweek", "e.id", "e.stats")


def read_competition_matches(spark: SparkSession, path: str) -> DataFrame:
    """Competition / team match documents -> one row per match."""
    doc = spark.read.schema(COMPETITION).json(path, multiLine=True)
    return doc.select(F.inline("matches")).select(
        "id", F.to_timestamp_ntz(F.regexp_replace("utcDate", "Z$", "")).alias("match_date"),
        "status", F.col("matchday").alias("gameweek"),
        F.col("homeTeam.id").alias("home_source_id"), F.col("homeTeam.name").alias("home_name"),
        F.col("awayTeam.id").alias("away_source_id"), F.col("awayTeam.name").alias("away_name"),
        F.col("score.fullTime.home").alias("home_score"), F.col("score.fullTime.away").alias("away_score"))


# ------------------------------------------------------------ S8 logging
def log_collection(spark: SparkSession, path: str, source: str, data_type: str, records: int,
                   success: bool, error_msg: str | None = None, exec_time: float = 0.0) -> None:
    """Append one collection-log row to the log table at ``path``."""
    row = (None, source, data_type, int(records), bool(success), error_msg, float(exec_time),
           _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))
    spark.createDataFrame([row], SC.DATA_COLLECTION_LOG).write.mode("append").parquet(path)


def observed(df: DataFrame, name: str = "records"):
    """Attach a row-count observation; read ``obs.get`` after an action."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("records")), obs


# --------------------------------------------------------------- loaders
def number_after(existing: DataFrame, new: DataFrame, order: list[str], chunk) -> DataFrame:
    """Give new rows ids ``max(existing id) + position`` in ``order``; the
    numbering runs per chunk with offsets, not as one global window."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    p = ordered_prefix(new, [], order, chunk=chunk).drop("n_key")
    return p.withColumn("id", top + F.col("seq")).drop("seq")


def load_teams(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """S9 (D1): incoming teams whose name is not present yet, one per name,
    as rows to append (ids after the current maximum)."""
    inc = incoming.groupBy("name").agg(F.min_by("short_name", "id").alias("short_name"))
    new = inc.join(existing.select("name"), "name", "left_anti")
    rows = number_after(existing, new, ["name"], F.substring("name", 1, 2))
    return rows.select("id", "name", "short_name", F.lit(None).cast("int").alias("founded_year"),
                       F.lit(None).cast("string").alias("stadium"))


def load_players(elements: DataFrame, source_teams: DataFrame, teams: DataFrame,
                 existing: DataFrame) -> DataFrame:
    """S10 (D2): map the source team id to a local team id by name (J11),
    derive position (P14), full name (P15), squad number (P16) and
    availability (P17); keep players whose (name, team_id) is new."""
    src = source_teams.select(F.col("id").alias("team"), F.col("name").alias("team_name"))
    local = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    e = elements.join(src, "team").join(local, "team_name")
    e = e.select(
        F.col("id").alias("source_id"),
        X.full_name().alias("name"),
        X.position_from_code("element_type").alias("position"),
        X.squad_number("code").alias("squad_number"),
        "team_id",
        X.is_available("status").alias("is_active"),
    )
    first = e.groupBy("name", "team_id").agg(
        F.min_by(F.struct("position", "squad_number", "is_active"), "source_id").alias("v"))
    new = first.select("name", "team_id", "v.*").join(
        existing.select("name", "team_id"), ["name", "team_id"], "left_anti")
    rows = number_after(existing, new, ["team_id", "name"],
                        F.struct("team_id", F.coalesce(F.substring("name", 1, 3), F.lit("")).alias("start")))
    return rows.select("id", "name", "position", "squad_number", "team_id", "is_active")


def load_fixtures(fixtures: DataFrame, source_teams: DataFrame, teams: DataFrame,
                  existing: DataFrame) -> DataFrame:
    """Started fixtures, source team ids re-keyed to local ids by name
    (two lookups, J11), inserted when (season, home, away, date) is new."""
    src = source_teams.select(F.col("id").alias("sid"), F.col("name").alias("tname"))
    local = teams.select(F.col("id").alias("lid"), F.col("name").alias("tname"))
    key = src.join(local, "tname").select("sid", "lid")
    f = fixtures.filter(F.coalesce(F.col("started"), F.lit(False)))
    f = f.join(key.withColumnsRenamed({"sid": "team_h", "lid": "home_team_id"}), "team_h") \
        .join(key.withColumnsRenamed({"sid": "team_a", "lid": "away_team_id"}), "team_a")
    ts = F.to_timestamp_ntz(F.regexp_replace(F.col("kickoff_time").cast("string"), "Z$", ""))
    f = f.select(
        F.year(ts).cast("bigint").alias("season_id"), F.col("event").cast("bigint").alias("gameweek"),
        ts.alias("match_date"), "home_team_id", "away_team_id",
        F.col("team_h_score").alias("home_score"), F.col("team_a_score").alias("away_score"),
        F.when(F.coalesce(F.col("finished"), F.lit(False)), F.lit("finished"))
        .otherwise(F.lit("live")).alias("status"), F.col("id").alias("source_id"))
    nk = ["season_id", "home_team_id", "away_team_id", "match_date"]
    f = f.groupBy(*nk).agg(F.min_by(F.struct("gameweek", "home_score", "away_score", "status"),
                                    "source_id").alias("v")).select(*nk, "v.*")
    new = f.join(existing.select(*nk), nk, "left_anti")
    rows = number_after(existing, new, ["match_date", "home_team_id", "away_team_id"],
                         F.to_date("match_date"))
    return rows.select("id", "season_id", "gameweek", "match_date", "home_team_id", "away_team_id",
                       "home_score", "away_score", "status")


# ------------------------------------------------------------- S15 export
def export_records(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite",
                   partition_by: list[str] | None = None) -> None:
    """Write an analysis result at the edge (JSON records by default),
    in parallel from the executors; nothing is collected to the driver."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
