"""Registered data-quality and monitoring queries (Q1-Q6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import quality as qc
from touchline.operators.stats import exact_quantile
from touchline.plans import sqlx
from touchline.plans.catalog import register, tables, with_views

LOG_AS_OF = "2024-02-01 00:00:00"
TABLES = ("teams", "seasons", "matches", "match_stats", "players", "player_match_stats", "shots",
          "opposition_categories")


def _tables(spark, sf_dir) -> dict:
    t = tables(spark, sf_dir)
    return {name: getattr(t, name) for name in TABLES}


def _q1_sql() -> str:
    parts = []
    for t, cols in qc.NOT_NULL.items():
        for c in cols:
            parts.append(f"SELECT '{t}' AS table_name, 'not_null' AS check_name, '{c}' AS column_name, "
                         f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS violations FROM {t}")
    for t, key in qc.KEYS.items():
        k = ", ".join(key)
        parts.append(f"SELECT '{t}', 'unique_key', '{','.join(key)}', "
                     f"CAST(COALESCE(SUM(CASE WHEN n > 1 THEN n - 1 END), 0) AS BIGINT) "
                     f"FROM (SELECT {k}, COUNT(*) AS n FROM {t} GROUP BY {k}) d")
    return "\nUNION ALL\n".join(parts)


def _q2_sql() -> str:
    parts = []
    for t, c, ref in qc.FOREIGN_KEYS:
        parts.append(f"SELECT '{t}' AS table_name, 'fk_{ref}' AS check_name, '{c}' AS column_name, "
                     f"CAST(COUNT(*) AS BIGINT) AS violations FROM {t} x "
                     f"WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {ref} r WHERE r.id = x.{c})")
    return "\nUNION ALL\n".join(parts)


def _q3_sql() -> str:
    parts = []
    for t, c, allowed in qc.DOMAINS:
        vals = ", ".join(f"'{v}'" for v in allowed)
        parts.append(f"SELECT '{t}' AS table_name, 'domain' AS check_name, '{c}' AS column_name, "
                     f"CAST(COUNT(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({vals})) AS BIGINT) "
                     f"AS violations FROM {t}")
    for t, c, lo, hi in qc.RANGES:
        parts.append(f"SELECT '{t}', 'range', '{c}', "
                     f"CAST(COUNT(*) FILTER (WHERE NOT ({c} BETWEEN {lo} AND {hi})) AS BIGINT) FROM {t}")
    return "\nUNION ALL\n".join(parts)


Q4_SQL = f"""SELECT source, last_success,
  {sqlx.ratio(f"epoch_us(TIMESTAMP '{LOG_AS_OF}') - epoch_us(last_success)", "3600000000")} AS age_hours,
  COALESCE(epoch_us(TIMESTAMP '{LOG_AS_OF}') - epoch_us(last_success) > {int(24 * 7 * 3_600_000_000)}, TRUE)
    AS is_stale
FROM (SELECT source, MAX(CASE WHEN success THEN collected_at END) AS last_success
      FROM data_collection_log GROUP BY source) s"""

Q5_SQL = f"""SELECT source, runs, successes, records_collected, ROUND(mean_seconds, 6) AS mean_seconds, last_run,
  {sqlx.ratio('successes', 'runs', 100)} AS success_rate
FROM (SELECT source, COUNT(*) AS runs, COUNT(*) FILTER (WHERE success) AS successes,
        CAST(SUM(CASE WHEN success THEN records_collected END) AS BIGINT) AS records_collected,
        AVG(CAST(execution_time_seconds AS DOUBLE)) AS mean_seconds, MAX(collected_at) AS last_run
      FROM data_collection_log GROUP BY source) a"""


@register("q1_nulls_and_keys", with_views(*TABLES) + _q1_sql())
def q1_nulls_and_keys(spark, sf_dir):
    return qc.null_and_key_checks(_tables(spark, sf_dir))


@register("q2_orphans", with_views(*TABLES) + _q2_sql())
def q2_orphans(spark, sf_dir):
    return qc.orphan_checks(_tables(spark, sf_dir), tasks=tables(spark, sf_dir).tasks())


@register("q3_domains", with_views(*TABLES) + _q3_sql())
def q3_domains(spark, sf_dir):
    return qc.domain_checks(_tables(spark, sf_dir))


@register("q4_freshness", with_views("data_collection_log") + Q4_SQL)
def q4_freshness(spark, sf_dir):
    return qc.freshness(tables(spark, sf_dir).data_collection_log, as_of=LOG_AS_OF)


@register("q5_collection_stats", with_views("data_collection_log") + Q5_SQL)
def q5_collection_stats(spark, sf_dir):
    return qc.collection_stats(tables(spark, sf_dir).data_collection_log)


_CHECKS_SQL = f"""checks AS (
  SELECT 'data_quality' AS check_name, CAST(SUM(violations) AS BIGINT) AS violations
    FROM ({_q1_sql()}
          UNION ALL
          {_q3_sql()}) a
  UNION ALL
  SELECT 'referential_integrity', CAST(SUM(violations) AS BIGINT) FROM ({_q2_sql()}) b
  UNION ALL
  SELECT 'data_freshness', CAST(COUNT(*) FILTER (WHERE is_stale) AS BIGINT) FROM ({Q4_SQL}) c
  UNION ALL
  SELECT 'collection_success', CAST(COUNT(*) FILTER (WHERE success_rate < 50.0) AS BIGINT) FROM ({Q5_SQL}) d)"""


@register("q6_health_rollup", with_views(*TABLES, "data_collection_log", extra=_CHECKS_SQL) + """
SELECT checks_run, failed_count, failed_checks,
  CASE WHEN failed_count = 0 THEN 'healthy' WHEN failed_count <= 2 THEN 'warning' ELSE 'critical' END
    AS overall_status
FROM (SELECT CAST(COUNT(*) AS BIGINT) AS checks_run,
        CAST(COUNT(*) FILTER (WHERE violations <> 0) AS BIGINT) AS failed_count,
        COALESCE(string_agg(check_name, ',' ORDER BY check_name) FILTER (WHERE violations <> 0), '')
          AS failed_checks
      FROM checks) r""")
def q6_health_rollup(spark, sf_dir):
    t = tables(spark, sf_dir)
    checks = qc.health_checks(_tables(spark, sf_dir), t.data_collection_log, as_of=LOG_AS_OF, tasks=t.tasks())
    return qc.health_rollup(checks)


@register("a16_collection_time_quantiles", with_views("data_collection_log") + "\nUNION ALL\n".join(
    f"SELECT source, CAST({q} AS DOUBLE) AS quantile, QUANTILE_CONT(execution_time_seconds, {q}) AS seconds "
    "FROM data_collection_log WHERE execution_time_seconds IS NOT NULL GROUP BY source" for q in (0.1, 0.5, 0.95)))
def a16_collection_time_quantiles(spark, sf_dir):
    """A16 over an unbounded domain: exact quantiles of collection times per source."""
    log = tables(spark, sf_dir).data_collection_log
    parts = [exact_quantile(log, ["source"], "execution_time_seconds", q, "seconds", range_rows=2000)
             .select("source", F.lit(q).alias("quantile"), "seconds") for q in (0.1, 0.5, 0.95)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
