"""Commit log of a table written in batches.

A table is a folder with data folders under ``data/`` and one-row JSON
entries under ``log/``.  A write goes to a data folder of its own, never
used before; it belongs to the table from the moment its entry exists.  An
entry is one row in one file of a folder of its own, which a committing job
renames into place, so a reader sees it whole or not at all, and jobs that
commit at the same time share no folder.  A compaction names the entries it
``replaces``; the live entries are those that no entry replaces.  There are
no numbers to agree on: a stream and a compaction may commit at the same
time, and two compactions of the same entries leave both results live, which
a table whose rows are merged by key reads as the same table.

Data folders never change, so a snapshot that was resolved keeps its state
while others commit.  ``retire`` removes what has been replaced for longer
than a grace period.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType([
    T.StructField("entry", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("batch_id", T.LongType()), T.StructField("replaces", T.ArrayType(T.StringType())),
    T.StructField("committed_at", T.TimestampNTZType()),
])


def _utc_now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def entries(spark: SparkSession, table: str) -> DataFrame:
    """All entries of the log; none for a table that has no log yet."""
    try:
        return spark.read.schema(ENTRY).json(f"{table}/log/*").filter(F.col("entry").isNotNull())
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], ENTRY)
        raise


def live_entries(spark: SparkSession, table: str) -> list[str]:
    """The entries of the newest snapshot: one per batch since the last
    compaction, and that compaction.  Only these names reach the driver."""
    log = entries(spark, table)
    gone = log.select(F.explode("replaces").alias("entry")).distinct()
    return sorted(r["entry"] for r in log.join(gone, "entry", "left_anti").select("entry").distinct().toLocalIterator())


def data_folder(table: str, entry: str) -> str:
    return f"{table}/data/{entry}"


def write_data(rows: DataFrame, table: str) -> str:
    """Write rows to a new data folder and return its entry name.  They are
    no part of the table before ``commit``."""
    entry = uuid.uuid4().hex
    rows.write.mode("errorifexists").parquet(data_folder(table, entry))
    return entry


def commit(spark: SparkSession, table: str, entry: str, kind: str, *, batch_id: int | None = None,
           replaces: list[str] | None = None) -> None:
    """Make a written data folder part of the table, in place of the entries
    it replaces."""
    row = (entry, kind, batch_id, list(replaces or []), _utc_now())
    spark.createDataFrame([row], ENTRY).coalesce(1).write.mode("errorifexists").json(f"{table}/log/{entry}")


def snapshot(spark: SparkSession, table: str, schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """(rows, entries) of the newest snapshot.  The rows stay those of this
    snapshot whatever is committed later."""
    live = live_entries(spark, table)
    if not live:
        return spark.createDataFrame([], schema), live
    return spark.read.schema(schema).parquet(*[data_folder(table, e) for e in live]), live


def retired(spark: SparkSession, table: str, grace: _dt.timedelta) -> DataFrame:
    """Entries replaced by a commit older than ``grace``: entry."""
    log = entries(spark, table)
    old = log.filter(F.col("committed_at") <= F.lit(_utc_now() - grace))
    gone = old.select(F.explode("replaces").alias("entry")).distinct()
    return log.join(gone, "entry", "left_semi").select("entry")


def retire(spark: SparkSession, table: str, grace: _dt.timedelta = _dt.timedelta(days=1)) -> int:
    """Remove the data and then the entries replaced for longer than ``grace``,
    which shall exceed the longest read.  A run that stops half way leaves
    entries that are replaced, hence not read, for the next run."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove(path: str) -> None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)

    gone = retired(spark, table, grace).collect()          # batches since the last retirement
    for r in gone:
        remove(data_folder(table, r["entry"]))
    for r in gone:
        remove(f"{table}/log/{r['entry']}")
    return len(gone)
