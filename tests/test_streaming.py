"""Structured Streaming jobs: the stream result equals the batch result, and a
replayed micro-batch does not change the outcome."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from touchline.streaming import commits
from touchline.streaming import match_day as md


def test_match_ingest_multi_batch(spark, small, tmp_dir):
    m = small.matches
    keep = ["id", "season_id", "gameweek", "match_date", "home_team_id", "away_team_id"]
    pre = m.select(*keep, F.lit(None).cast("long").alias("home_score"), F.lit(None).cast("long").alias("away_score"),
                   F.lit("scheduled").alias("status"), (F.col("match_date") - F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    fin = m.select(*keep, "home_score", "away_score", "status",
                   (F.col("match_date") + F.expr("INTERVAL 2 HOURS")).alias("updated_at"))
    # results land before the pre-match documents: order must not matter
    fin.repartition(3).write.parquet(f"{tmp_dir}/landing/a")
    pre.repartition(3).write.parquet(f"{tmp_dir}/landing/b")
    q = md.start_match_ingest(spark, f"{tmp_dir}/landing/*", f"{tmp_dir}/table", f"{tmp_dir}/ckpt",
                              files_per_trigger=1)
    q.awaitTermination()
    table = f"{tmp_dir}/table"
    assert len(commits.live_entries(spark, table)) >= 2
    cur = md.current_matches(spark, table)
    assert cur.count() == m.count()
    diff = cur.select("id", "status", "home_score").exceptAll(m.select("id", "status", "home_score"))
    assert diff.count() == 0
    # a lost checkpoint replays every batch into the same table, after a
    # compaction too: the same versions once more leave it as it is
    md.compact_matches(spark, table)
    before = cur.collect()
    q = md.start_match_ingest(spark, f"{tmp_dir}/landing/*", f"{tmp_dir}/table", f"{tmp_dir}/ckpt2",
                              files_per_trigger=1)
    q.awaitTermination()
    after = md.current_matches(spark, table)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, before))


def _version(i, score, hour, status="finished"):
    return (i, 2024, 1, dt.datetime(2024, 1, 1), 1, 2, score, 0, status, dt.datetime(2024, 1, 1, hour))


def _scores(df):
    return {r["id"]: r["home_score"] for r in df.collect()}


def test_commit_log(spark, tmp_dir):
    table = f"{tmp_dir}/table"

    def updates(*rows):
        return spark.createDataFrame(list(rows), md.MATCH_UPDATE)

    assert md.current_matches(spark, table).isEmpty() and md.compact_matches(spark, table) == []
    assert md.commit_matches(spark, updates(_version(1, 0, 1), _version(1, 3, 2), _version(2, 5, 1)), table, 0) == 2
    md.commit_matches(spark, updates(_version(2, 6, 3)), table, 1)
    assert _scores(md.current_matches(spark, table)) == {1: 3, 2: 6}
    # a write that never commits, and a half-written entry, are no part of the table
    commits.write_data(updates(_version(1, 99, 9)), table)
    os.makedirs(f"{table}/log/x/_temporary/0")
    with open(f"{table}/log/x/_temporary/0/part-0.json", "w") as f:
        f.write('{"entry": "x", "kind": "batch"}\n')
    assert _scores(md.current_matches(spark, table)) == {1: 3, 2: 6}
    # a reader that resolved its snapshot before a compaction and a new batch keeps it
    reader = md.current_matches(spark, table)
    replaced = md.compact_matches(spark, table)
    assert len(replaced) == 2 and len(commits.live_entries(spark, table)) == 1
    md.commit_matches(spark, updates(_version(1, 4, 5)), table, 2)
    assert _scores(reader) == {1: 3, 2: 6}
    assert _scores(md.current_matches(spark, table)) == {1: 4, 2: 6}
    # an older version that arrives after the compaction does not win
    md.commit_matches(spark, updates(_version(2, 0, 1)), table, 3)
    assert _scores(md.current_matches(spark, table)) == {1: 4, 2: 6}
    # a batch committed while a compaction runs stays; so do two compactions of one snapshot
    rows, live = commits.snapshot(spark, table, md.MATCH_UPDATE)
    first, second = (commits.write_data(md.newest_per_match(rows), table) for _ in range(2))
    md.commit_matches(spark, updates(_version(3, 1, 1)), table, 4)
    commits.commit(spark, table, first, "compaction", replaces=live)
    commits.commit(spark, table, second, "compaction", replaces=live)
    assert len(commits.live_entries(spark, table)) == 3
    assert _scores(md.current_matches(spark, table)) == {1: 4, 2: 6, 3: 1}
    # retirement leaves what is live, and nothing that is younger than the grace
    assert commits.retire(spark, table, dt.timedelta(days=1)) == 0
    gone = {*replaced, *live}
    assert commits.retire(spark, table, dt.timedelta(0)) == len(gone)
    assert not gone & set(os.listdir(f"{table}/data"))
    assert _scores(md.current_matches(spark, table)) == {1: 4, 2: 6, 3: 1}
    assert commits.retire(spark, table, dt.timedelta(0)) == 0


def test_failed_batches_are_logged(spark, tmp_dir, monkeypatch):
    land, table, log = f"{tmp_dir}/land", f"{tmp_dir}/table", f"{tmp_dir}/log"
    spark.createDataFrame([_version(1, 1, 1), _version(2, 2, 2)], md.MATCH_UPDATE).write.parquet(f"{land}/a")
    real = commits.commit

    def broken(*args, **kwargs):
        raise OSError("storage is gone")

    def start():
        return md.start_match_ingest(spark, f"{land}/*", table, f"{tmp_dir}/ck", log_path=log)

    monkeypatch.setattr(commits, "commit", broken)
    with pytest.raises(Exception, match="storage is gone"):
        start().awaitTermination()
    assert md.current_matches(spark, table).isEmpty()
    monkeypatch.setattr(commits, "commit", real)
    start().awaitTermination()                            # the batch is replayed
    assert _scores(md.current_matches(spark, table)) == {1: 1, 2: 2}
    rows = spark.read.parquet(log).orderBy("collected_at").collect()
    assert [(r["success"], r["records_collected"]) for r in rows] == [(False, 0), (True, 2)]
    assert "OSError: storage is gone" in rows[0]["error_message"] and rows[1]["error_message"] is None
    assert all(r["data_type"] == "matches" and r["execution_time_seconds"] >= 0 for r in rows)


@pytest.mark.parametrize("per_batch", [None, 1])
def test_stream_and_late_rows_equal_the_batch(spark, tmp_dir, per_batch):
    """Rows of any lateness, dealt over several runs and batches."""
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), "x", rng.randint(0, 9), rng.random() < 0.7, None, 0.5 * rng.randint(0, 9),
             dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 12 * 1440))) for i in range(300)]
    rows += [(300, "a", "x", 1, True, None, 1.0, None)]    # no time: in the side table, in no window
    for run in range(3):
        for part in range(3):
            mine = [r for r in rows if r[0] % 9 == 3 * run + part]
            spark.createDataFrame(mine, md.LOG_ROW).coalesce(1).write.parquet(f"{tmp_dir}/land/{run}{part}")
        md.run_log_health(spark, f"{tmp_dir}/land/*", f"{tmp_dir}/base", watermark="2 hours",
                          files_per_trigger=per_batch, log_path=f"{tmp_dir}/log")
    late = spark.read.parquet(f"{tmp_dir}/base/dealt/*/_late=true")
    assert late.count() > 100 and late.filter("collected_at IS NULL").count() == 1
    want = {}
    for _, source, _, records, ok, _, seconds, at in rows:
        if at is not None:
            w = want.setdefault((at.date(), source), [0, 0, None, 0.0])
            w[0] += 1
            w[1] += ok
            w[2] = (w[2] or 0) + records if ok else w[2]
            w[3] += seconds
    got = {(r["window_start"].date(), r["source"]): [r["runs"], r["successes"], r["records_collected"], r["mean_seconds"]]
           for r in md.reconciled_windows(spark, f"{tmp_dir}/base").collect()}
    assert got == {k: [n, s, c, round(t / n, 6)] for k, (n, s, c, t) in want.items()}
    log = spark.read.parquet(f"{tmp_dir}/log")
    assert log.agg(F.sum("records_collected")).first()[0] == len(rows) and log.filter("NOT success").isEmpty()


def test_log_health_stream_equals_batch(spark, small, tmp_dir):
    log = small.data_collection_log
    days = [r[0] for r in log.select(F.to_date("collected_at")).distinct().orderBy(1).collect()]
    for i, d in enumerate(days):      # one landing file per day, in time order
        log.filter(F.to_date("collected_at") == d).coalesce(1).write.parquet(f"{tmp_dir}/land/{i:03d}")
    q = md.start_log_health(spark, f"{tmp_dir}/land/*", f"{tmp_dir}/out", f"{tmp_dir}/ck",
                            files_per_trigger=1)
    q.awaitTermination()
    got = md.final_windows(spark, f"{tmp_dir}/out")
    want = log.groupBy(F.date_trunc("day", "collected_at").alias("window_start"), "source").agg(
        F.count("*").alias("runs"))
    assert got.select("window_start", "source", "runs").exceptAll(want).count() == 0
    assert got.count() == want.count()


def test_out_of_order_files_and_watermark(spark, tmp_dir):
    """Files arriving out of event-time order still give correct per-window
    values in update mode, and the watermark advances to max event time
    minus the delay.  (Spark guarantees on-time rows are kept; rows behind
    the watermark may or may not be dropped -- the watermark bounds state.)"""
    from touchline.streaming.match_day import LOG_ROW
    on_time = [(1, "api", "x", 5, True, None, 1.0, dt.datetime(2024, 1, 10, 12))]
    late = [(2, "api", "x", 7, True, None, 2.0, dt.datetime(2024, 1, 1, 12))]
    spark.createDataFrame(on_time, LOG_ROW).coalesce(1).write.parquet(f"{tmp_dir}/land/000")
    spark.createDataFrame(late, LOG_ROW).coalesce(1).write.parquet(f"{tmp_dir}/land/001")
    q = md.start_log_health(spark, f"{tmp_dir}/land/*", f"{tmp_dir}/out", f"{tmp_dir}/ck",
                            files_per_trigger=1)
    q.awaitTermination()
    marks = [p["eventTime"].get("watermark") for p in q.recentProgress if p["numInputRows"]]
    assert marks[-1].startswith("2024-01-10T11:00")
    got = {str(r["window_start"])[:10]: r["runs"] for r in md.final_windows(spark, f"{tmp_dir}/out").collect()}
    assert got["2024-01-10"] == 1
    assert got.get("2024-01-01", 1) == 1
