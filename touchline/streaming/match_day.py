"""Structured Streaming jobs.

T1  incremental match ingest: match documents land as files during match
    days; each micro-batch keeps the newest version of every match in the
    batch, writes it to a folder of its own and commits it to the table's
    log (``streaming/commits.py``).  The current table is the newest version
    per match id over all committed batches, resolved by an aggregate
    (``max_by``), never by collecting.  A batch that is replayed, with or
    without its checkpoint, commits the same versions once more, which
    changes nothing.
T2  collection-log health per source in tumbling event-time windows with a
    watermark, emitted in update mode; every emitted window row is written
    to its batch partition and the final value per window is the one from
    the latest batch.  The watermark bounds the state kept (windows older
    than it are evicted); Spark keeps every on-time row but gives no
    guarantee that rows behind the watermark are dropped.
    ``run_log_health`` therefore takes late rows out first, into a side
    table, and ``reconciled_windows`` adds them, so that stream and side
    table give the batch aggregate for any lateness.
S8  ``logged`` makes every batch leave a row in the collection log, a failed
    one with ``success = false`` and its error.

Checkpoints and outputs live under the session's ``spark.checkpoint.dir``
(a shared folder on a cluster), so a restarted driver resumes from the last
committed batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions import expressions as X
from touchline.sources import ingest
from touchline.streaming import commits

MATCH_UPDATE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("season_id", T.LongType()),
    T.StructField("gameweek", T.LongType()), T.StructField("match_date", T.TimestampNTZType()),
    T.StructField("home_team_id", T.LongType()), T.StructField("away_team_id", T.LongType()),
    T.StructField("home_score", T.LongType()), T.StructField("away_score", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("updated_at", T.TimestampNTZType()),
])

LOG_ROW = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("source", T.StringType()),
    T.StructField("data_type", T.StringType()), T.StructField("records_collected", T.LongType()),
    T.StructField("success", T.BooleanType()), T.StructField("error_message", T.StringType()),
    T.StructField("execution_time_seconds", T.DoubleType()),
    T.StructField("collected_at", T.TimestampNTZType()),
])


def _write_batch(df: DataFrame, out_path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out_path}/_batch_id={batch_id}")


def newest_per_match(updates: DataFrame) -> DataFrame:
    """Newest version (by ``updated_at``, then status text, then the other
    columns, so that a replay picks the same row) of each match."""
    cols = [c for c in updates.columns if c not in ("id",)]
    rest = [c for c in cols if c not in ("updated_at", "status")]
    best = updates.groupBy("id").agg(
        F.max_by(F.struct(*cols), F.struct("updated_at", "status", *rest)).alias("v"))
    return best.select("id", "v.*")


BatchFunction = Callable[[DataFrame, int], int]


def logged(write: BatchFunction, log_path: str | None, source: str, data_type: str) -> Callable[[DataFrame, int], None]:
    """A batch function that appends one collection-log row per batch.
    ``write`` returns the number of records it wrote.  If it raises, the row
    says ``success = false`` with the error, and the error goes on to stop
    the stream; the batch is then replayed when the stream starts again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        start = time.monotonic()
        try:
            records = write(batch, batch_id)
        except Exception as e:
            if log_path is not None:
                text = f"batch {batch_id}: {type(e).__name__}: {e}"
                ingest.log_collection(batch.sparkSession, log_path, source, data_type, 0, False, text,
                                      time.monotonic() - start)
            raise
        if log_path is not None:
            ingest.log_collection(batch.sparkSession, log_path, source, data_type, records, True, None,
                                  time.monotonic() - start)

    return run


def commit_matches(spark: SparkSession, updates: DataFrame, table: str, batch_id: int | None = None) -> int:
    """Write the newest version of every match in ``updates`` and commit it;
    returns the number of matches."""
    entry = commits.write_data(newest_per_match(updates), table)
    commits.commit(spark, table, entry, "batch", batch_id=batch_id)
    return spark.read.schema(MATCH_UPDATE).parquet(commits.data_folder(table, entry)).count()


def start_match_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, *,
                       available_now: bool = True, files_per_trigger: int | None = None,
                       log_path: str | None = None):
    """Start the incremental ingest stream; returns the StreamingQuery.
    With ``log_path`` every batch leaves a collection-log row there."""
    reader = spark.readStream.schema(MATCH_UPDATE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(landing)

    def upsert(batch: DataFrame, batch_id: int) -> int:
        return commit_matches(batch.sparkSession, batch, table, batch_id)

    w = stream.writeStream.foreachBatch(logged(upsert, log_path, "match_day", "matches")) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 hour")
    return w.start()


def current_matches(spark: SparkSession, table: str) -> DataFrame:
    """The matches table as of the last commit: one snapshot, which later
    commits, compactions and half-finished writes do not change."""
    return newest_per_match(commits.snapshot(spark, table, MATCH_UPDATE)[0])


def compact_matches(spark: SparkSession, table: str) -> list[str]:
    """Commit the current table in place of the entries it was read from, so
    that readers need only it and later batches; returns these entries.  A
    compaction that stops before its commit is never read."""
    rows, live = commits.snapshot(spark, table, MATCH_UPDATE)
    if len(live) > 1:
        commits.commit(spark, table, commits.write_data(newest_per_match(rows), table), "compaction", replaces=live)
    return live


def log_health_windows(stream: DataFrame, *, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Per (tumbling window, source) runs, successes, records and mean
    seconds, with a watermark bounding late rows and the state kept."""
    return _windows(_event_time(stream).withWatermark("event_time", watermark), window)


def _event_time(log: DataFrame) -> DataFrame:
    # Watermarks need a TIMESTAMP; the log holds wall-clock timestamp_ntz.
    # The instant is the wall clock read as UTC (independent of the session
    # zone), so windows align to wall-clock midnight; starts map back alike.
    tz = log.sparkSession.conf.get("spark.sql.session.timeZone")
    return log.withColumn("event_time", F.from_utc_timestamp(F.col("collected_at").cast("timestamp"), tz))


def _windows(log: DataFrame, window: str) -> DataFrame:
    tz = log.sparkSession.conf.get("spark.sql.session.timeZone")
    agg = log.groupBy(F.window("event_time", window), "source").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("success")).alias("successes"),
        F.sum(F.when(F.col("success"), F.col("records_collected"))).alias("records_collected"),
        F.sum("execution_time_seconds").alias("total_seconds"),
    )
    start = F.to_utc_timestamp(F.col("window.start"), tz).cast("timestamp_ntz")
    return agg.select(start.alias("window_start"), "source",
                      "runs", "successes", "records_collected", "total_seconds")


def start_log_health(spark: SparkSession, landing: str, out_path: str, checkpoint: str, *,
                     files_per_trigger: int | None = 1, window: str = "1 day",
                     watermark: str = "1 hour"):
    """Start the windowed health stream (update mode through foreachBatch)."""
    reader = spark.readStream.schema(LOG_ROW)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    agg = log_health_windows(reader.parquet(landing), window=window, watermark=watermark)
    q = agg.writeStream.outputMode("update").foreachBatch(
        lambda df, bid: _write_batch(df, out_path, bid)).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    return q


def _latest_totals(spark: SparkSession, out_path: str) -> DataFrame:
    v = spark.read.parquet(out_path)
    keys = ["window_start", "source"]
    vals = [c for c in v.columns if c not in keys + ["_batch_id"]]
    return v.groupBy(*keys).agg(F.max_by(F.struct(*vals), "_batch_id").alias("v")).select(*keys, "v.*")


def _with_rates(totals: DataFrame) -> DataFrame:
    return totals.withColumns({
        "success_rate": X.exact_ratio("successes", "runs", 100),
        "mean_seconds": F.round(F.col("total_seconds") / F.col("runs"), 6),
    }).drop("total_seconds")


def final_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """Latest emitted value of every (window, source) with derived rates."""
    return _with_rates(_latest_totals(spark, out_path))


# ------------------------------------------------------------- late rows
MARK = T.StructType([T.StructField("newest", T.TimestampNTZType()), T.StructField("_batch_id", T.LongType())])


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def start_late_split(spark: SparkSession, landing: str, base: str, *, watermark: str = "1 hour",
                     files_per_trigger: int | None = None, log_path: str | None = None):
    """Deal landed log rows into ``base/dealt``, by batch and ``_late``.

    A row is late if its time lies more than ``watermark`` before the newest
    time of all earlier batches, or if it has no time.  Every batch writes
    its own folder and last its newest time, and decides by the marks of the
    batches before it, so a replayed batch decides alike."""
    reader = spark.readStream.schema(LOG_ROW)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def split(batch: DataFrame, batch_id: int) -> int:
        session = batch.sparkSession
        newest = _read_or_empty(session, f"{base}/marks", MARK).filter(F.col("_batch_id") < batch_id) \
            .agg(F.max("newest")).first()[0]
        behind = F.lit(False) if newest is None else \
            F.col("collected_at") < F.lit(newest) - F.expr(f"INTERVAL {watermark}")
        late = F.col("collected_at").isNull() | behind
        batch.withColumn("_late", late).write.mode("overwrite").partitionBy("_late") \
            .parquet(f"{base}/dealt/_batch_id={batch_id}")
        dealt = _read_or_empty(session, f"{base}/dealt/_batch_id={batch_id}", LOG_ROW)
        _write_batch(dealt.agg(F.max("collected_at").alias("newest")), f"{base}/marks", batch_id)
        return dealt.count()

    return reader.parquet(landing).writeStream.foreachBatch(logged(split, log_path, "collection_log", "late_split")) \
        .option("checkpointLocation", f"{base}/split_checkpoint").trigger(availableNow=True).start()


def run_log_health(spark: SparkSession, landing: str, base: str, *, window: str = "1 day", watermark: str = "1 hour",
                   files_per_trigger: int | None = None, log_path: str | None = None) -> None:
    """T2, one scheduled run over whatever has landed: first the split, to its
    end, then the windowed stream over the rows on time.

    The windowed stream starts only after the split has ended without an
    error, so it never reads a partition that a replay will write again.  It
    takes all new rows as one batch, so its watermark is never ahead of the
    mark that the split decided by, and it drops nothing."""
    start_late_split(spark, landing, base, watermark=watermark, files_per_trigger=files_per_trigger,
                     log_path=log_path).awaitTermination()
    start_log_health(spark, f"{base}/dealt/*/_late=false", f"{base}/windows", f"{base}/windows_checkpoint",
                     files_per_trigger=None, window=window, watermark=watermark).awaitTermination()


def reconciled_windows(spark: SparkSession, base: str, *, window: str = "1 day") -> DataFrame:
    """Final windows of ``run_log_health`` with the late rows added: equal to
    the batch aggregate of all rows that have a time."""
    late = _windows(_event_time(_read_or_empty(spark, f"{base}/dealt/*/_late=true", LOG_ROW)), window)
    both = _latest_totals(spark, f"{base}/windows").unionByName(late)
    return _with_rates(both.groupBy("window_start", "source").agg(
        *[F.sum(c).alias(c) for c in ("runs", "successes", "records_collected", "total_seconds")]))
