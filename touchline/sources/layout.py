"""Stored layout of the sport tables.

In a deployment the sport tables are stored once and every analysis reads
them; the driver-table mapping is only an adapter for the test data.
``materialize`` writes each mapped table as parquet: ``matches`` is
partitioned by season (season filters prune whole directories), fact tables
are clustered by their usual keys so parquet row-group statistics skip data
on player / match predicates.  ``StoredTables`` reads them back with the same
attribute interface as ``SportTables``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from touchline.sources.fixture_map import VIEWS, SportTables, line_tasks

MARKER = "touchline_layout"        # a one-row table, written and read by Spark like the others

MARKER_SCHEMA = "raw_dir string, tables array<string>"

LAYOUT = {
    "matches": {"partition_by": ["season_id"], "cluster_by": ["match_date", "id"]},
    # facts carry the season (and date) of their match from the mapping on
    "match_stats": {"partition_by": ["season_id"], "cluster_by": ["match_id"]},
    "player_match_stats": {"partition_by": ["season_id"], "cluster_by": ["player_id", "match_id"]},
    "shots": {"partition_by": ["season_id"], "cluster_by": ["match_id"]},
    "data_collection_log": {"cluster_by": ["source", "collected_at"]},
}
SPORT_TABLES = ("teams", "seasons", "matches", "match_stats", "players", "player_match_stats", "shots",
                "opposition_categories", "data_collection_log", "src_teams", "src_elements",
                "src_fixtures")


def materialize(tables: SportTables, path: str, names=SPORT_TABLES) -> str:
    """Write the mapped tables under ``path`` (a shared folder on a
    cluster) and a marker naming the raw directory for raw-only inputs."""
    path = path.rstrip("/")
    for name in names:
        df: DataFrame = getattr(tables, name)
        spec = LAYOUT.get(name, {})
        part = spec.get("partition_by", [])
        clus = spec.get("cluster_by", [])
        if clus:
            # Range-partitioned by the clustering keys: files hold disjoint key
            # ranges, so min/max statistics prune on those keys.
            df = df.repartitionByRange(*(part + clus)).sortWithinPartitions(*(part + clus))
        w = df.write.mode("overwrite")
        if part:
            w = w.partitionBy(*part)
        w.parquet(f"{path}/{name}")
    tables.spark.createDataFrame([(tables.sf_dir, list(names))], MARKER_SCHEMA).coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/{MARKER}")
    return path


def read_marker(spark: SparkSession, path: str):
    """(raw_dir, tables) of a stored layout, None for any other folder.  The
    answer depends on what is stored, not on how the path is written."""
    try:
        return spark.read.schema(MARKER_SCHEMA).parquet(f"{path.rstrip('/')}/{MARKER}").first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class StoredTables:
    """Sport tables read from a materialized layout."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        meta = read_marker(spark, self.path)
        if meta is None:
            raise FileNotFoundError(f"no stored layout at {self.path}")
        self.sf_dir = meta["raw_dir"]
        self._stored = set(meta["tables"])
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        key = "raw:" + name
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[key]

    def tasks(self) -> int | None:
        """As ``SportTables.tasks``, of the stored rows."""
        return line_tasks(self.player_match_stats if "player_match_stats" in self._stored else self.raw("lineitem"))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._cache:
            if name in self._stored:
                self._cache[name] = self.spark.read.parquet(f"{self.path}/{name}")
            else:
                self._cache[name] = getattr(SportTables(self.spark, self.sf_dir), name)
        return self._cache[name]
