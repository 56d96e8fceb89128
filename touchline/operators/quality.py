"""Data-quality checks and the health roll-up (Q1-Q6).

The reference names these checks but leaves them without bodies; the
declared schema (keys, NOT NULL, foreign keys, closed domains, ranges) gives
them their meaning here.  Every check is a grouped aggregate or an anti-join
count; results are small frames of (check, violations).
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import expressions as X
from touchline.operators.longform import dealt

# Fixed schema facts (declared keys, NOT NULL columns, foreign keys, domains).
KEYS = {
    "teams": ["id"],
    "seasons": ["id"],
    "matches": ["id"],
    "players": ["id"],
    "match_stats": ["match_id", "team_id"],
    "player_match_stats": ["match_id", "player_id"],
}
NOT_NULL = {
    "teams": ["name"],
    "seasons": ["season_name"],
    "matches": ["season_id", "home_team_id", "away_team_id", "match_date", "status"],
    "players": ["name"],
}
FOREIGN_KEYS = [
    ("matches", "season_id", "seasons"),
    ("matches", "home_team_id", "teams"),
    ("matches", "away_team_id", "teams"),
    ("match_stats", "match_id", "matches"),
    ("match_stats", "team_id", "teams"),
    ("players", "team_id", "teams"),
    ("player_match_stats", "match_id", "matches"),
    ("player_match_stats", "player_id", "players"),
    ("player_match_stats", "team_id", "teams"),
    ("shots", "match_id", "matches"),
    ("shots", "player_id", "players"),
    ("shots", "team_id", "teams"),
    ("opposition_categories", "team_id", "teams"),
    ("opposition_categories", "season_id", "seasons"),
]
DOMAINS = [
    ("matches", "status", X.MATCH_STATUSES),
    ("players", "position", X.POSITIONS),
]
RANGES = [
    ("match_stats", "possession_percent", 0, 100),
    ("match_stats", "pass_accuracy_percent", 0, 100),
    ("shots", "x_coordinate", 0, 100),
    ("shots", "y_coordinate", 0, 100),
]


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def _row(table: str, check: str, column: str, violations) -> list:
    return [F.lit(table).alias("table_name"), F.lit(check).alias("check_name"),
            F.lit(column).alias("column_name"), violations.cast("bigint").alias("violations")]


def _column_checks(tables: dict[str, DataFrame], kinds=("not_null", "domain", "range")) -> list[DataFrame]:
    """Checks that count rows of one table, all of a table's in one aggregate."""
    checks = [(t, "not_null", c, F.col(c).isNull()) for t, cols in NOT_NULL.items() for c in cols]
    checks += [(t, "domain", c, F.col(c).isNotNull() & ~F.col(c).isin(*allowed)) for t, c, allowed in DOMAINS]
    checks += [(t, "range", c, ~F.col(c).between(lo, hi)) for t, c, lo, hi in RANGES]
    per_table: dict[str, list] = {}
    for t, kind, c, bad in checks:
        if t in tables and kind in kinds:
            per_table.setdefault(t, []).append((kind, c, bad))
    frames = []
    for t, mine in per_table.items():
        agg = tables[t].agg(*[F.count_if(bad).alias(f"_{i}") for i, (_, _, bad) in enumerate(mine)])
        frames.append(agg.select(F.inline(F.array(*[
            F.struct(*_row(t, kind, c, F.col(f"_{i}"))) for i, (kind, c, _) in enumerate(mine)]))))
    return frames


def _key_checks(tables: dict[str, DataFrame]) -> list[DataFrame]:
    frames = []
    for t, key in KEYS.items():
        if t not in tables:
            continue
        dup = tables[t].groupBy(*key).count().agg(
            F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("v"))
        frames.append(dup.select(*_row(t, "unique_key", ",".join(key), F.col("v"))))
    return frames


def null_and_key_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Q1: NULLs in NOT NULL columns (one aggregate per table) and keys that
    occur more than once (rows beyond the first)."""
    return _union([*_column_checks(tables, ("not_null",)), *_key_checks(tables)])


def orphan_checks(tables: dict[str, DataFrame], *, tasks: int | None = None) -> DataFrame:
    """Q2: rows whose (non-NULL) foreign key has no parent row.

    One scan per child table: all its foreign keys are exploded into
    (number of the foreign key, key) rows and counted per distinct key
    (combined map-side); one anti-join against the parent keys, tagged with
    the number of their table, then answers every foreign key at once.  Names
    stand in the result alone, as a task holds many keys.  ``tasks``: tasks of
    the anti-join (``longform.dealt``)."""
    fks = [(t, c, ref) for t, c, ref in FOREIGN_KEYS if t in tables and ref in tables]
    if not fks:
        raise ValueError("no foreign keys to check")
    refs = sorted({ref for _, _, ref in fks})
    by_child: dict[str, list] = {}
    for i, (t, c, ref) in enumerate(fks):
        by_child.setdefault(t, []).append(F.struct(F.lit(i).alias("_fk"), F.col(c).cast("bigint").alias("_k")))
    child_keys = [tables[t].select(F.inline(F.array(*keys))) for t, keys in by_child.items()]
    counts = _union(child_keys).filter(F.col("_k").isNotNull()) \
        .groupBy("_fk", "_k").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_ref", F.get(F.array(*[F.lit(refs.index(ref)) for _, _, ref in fks]), F.col("_fk")))
    parents = _union([tables[r].select(F.lit(i).alias("_ref"), F.col("id").cast("bigint").alias("_k"))
                      for i, r in enumerate(refs)])
    missing = counts.join(dealt(parents, tasks, "_ref", "_k"), ["_ref", "_k"], "left_anti").groupBy("_fk").agg(F.sum("_n").alias("_v"))
    # Every declared key gets a row, zero when nothing is missing.
    declared = next(iter(tables.values())).sparkSession.createDataFrame(
        [(i, *fk) for i, fk in enumerate(fks)], "_fk int, table_name string, column_name string, ref string")
    out = declared.join(missing, "_fk", "left")
    return out.select("table_name", F.concat(F.lit("fk_"), F.col("ref")).alias("check_name"),
                      "column_name", F.coalesce(F.col("_v"), F.lit(0)).cast("bigint").alias("violations"))


def domain_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Q3: values outside a closed set, and percentages / coordinates
    outside 0-100 (NULL is not a violation); one aggregate per table."""
    return _union(_column_checks(tables, ("domain", "range")))


def _ts(as_of):
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        as_of = str(as_of)
    return F.lit(as_of).cast("timestamp_ntz")


def freshness(log: DataFrame, *, as_of, max_age_hours: float = 24.0 * 7) -> DataFrame:
    """Q4: per source the latest successful collection and its age in hours
    at ``as_of``; a source with no success at all is stale."""
    last = log.groupBy("source").agg(
        F.max(F.when(F.col("success"), F.col("collected_at"))).alias("last_success"))
    # Wall-clock difference of two timestamp_ntz values: no time-zone
    # conversion, so the session zone and DST changes cannot shift it.
    micros = F.timestamp_diff("MICROSECOND", F.col("last_success"), _ts(as_of))
    return last.withColumns({
        "age_hours": X.exact_ratio(micros, F.lit(3_600_000_000)),
        "is_stale": F.coalesce(micros > F.lit(int(max_age_hours * 3_600_000_000)), F.lit(True)),
    })


def collection_stats(log: DataFrame) -> DataFrame:
    """Q5: per source runs, successes, success rate %, records collected,
    mean run seconds and the latest run."""
    s = F.col("success")
    agg = log.groupBy("source").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(s).alias("successes"),
        F.sum(F.when(s, F.col("records_collected"))).alias("records_collected"),
        F.avg(F.col("execution_time_seconds").cast("double")).alias("mean_seconds"),
        F.max("collected_at").alias("last_run"),
    )
    return agg.withColumns({
        "success_rate": X.exact_ratio("successes", "runs", 100),
        "mean_seconds": X.r6("mean_seconds"),
    })


def health_checks(tables: dict[str, DataFrame], log: DataFrame, *, as_of,
                  max_age_hours: float = 24.0 * 7, min_success_rate: float = 50.0,
                  tasks: int | None = None) -> DataFrame:
    """One row per named check with its violation count and status."""
    q13 = _union([*_column_checks(tables), *_key_checks(tables)]).agg(
        F.sum("violations").alias("v")).select(F.lit("data_quality").alias("check_name"), "v")
    q2 = orphan_checks(tables, tasks=tasks).agg(F.sum("violations").alias("v")) \
        .select(F.lit("referential_integrity").alias("check_name"), "v")
    q4 = freshness(log, as_of=as_of, max_age_hours=max_age_hours).agg(
        F.count_if(F.col("is_stale")).alias("v")).select(F.lit("data_freshness").alias("check_name"), "v")
    q5 = collection_stats(log).agg(F.count_if(F.col("success_rate") < min_success_rate).alias("v")) \
        .select(F.lit("collection_success").alias("check_name"), "v")
    checks = _union([q13, q2, q4, q5]).withColumn("violations", F.col("v").cast("bigint")).drop("v")
    return checks.withColumn("status", F.when(F.col("violations") == 0, F.lit("healthy"))
                             .otherwise(F.lit("failed")))


def health_rollup(checks: DataFrame) -> DataFrame:
    """Q6: overall status from the failed checks: none -> healthy, one or
    two -> warning, more -> critical; with the failed names (sorted)."""
    failed = F.col("status") != "healthy"
    agg = checks.agg(
        F.count(F.lit(1)).alias("checks_run"),
        F.count_if(failed).alias("failed_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(failed, F.col("check_name")))), ",")
        .alias("failed_checks"),
    )
    return agg.withColumn("overall_status",
                          F.when(F.col("failed_count") == 0, F.lit("healthy"))
                          .when(F.col("failed_count") <= 2, F.lit("warning"))
                          .otherwise(F.lit("critical")))
