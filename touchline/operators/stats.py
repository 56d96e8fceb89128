"""Distributed statistics helpers: exact median and quantiles, Pearson correlation."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import scratch_dir


def exact_median(df: DataFrame, keys: Sequence[str], value: str, alias: str | None = None) -> DataFrame:
    """Exact median of ``value`` per group (mean of the two middle values for
    an even count, NULL values skipped), one row per group.

    ``percentile``/``median`` aggregates buffer every value of a group in one
    task.  Here the rows are first combined into a (group, value) -> count
    histogram (map-side), so the ordered pass runs over distinct values only;
    for bounded domains such as percentages with two decimals that is at most
    10,001 rows per group, however many rows the group has.
    """
    alias = alias or f"median_{value}"
    keys = list(keys)
    h = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value)
    h = h.withColumns({
        "_cum": F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_tot": F.sum("_c").over(Window.partitionBy(*keys)),
    })
    lo = F.floor((F.col("_tot") + 1) / 2)
    hi = F.ceil((F.col("_tot") + 1) / 2)
    g = h.groupBy(*keys).agg(
        F.min(F.when(F.col("_cum") >= lo, F.col(value))).alias("_lo"),
        F.min(F.when(F.col("_cum") >= hi, F.col(value))).alias("_hi"),
    )
    return g.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(alias))


def pearson(x: str, y: str) -> Column:
    """Pearson correlation over rows where both sides are present (pandas
    pairwise deletion); NULL for a constant side.  Built from algebraic
    aggregates, which combine map-side (``corr`` raises on constant input
    under ANSI mode)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs = F.when(both, F.col(x).cast("double"))
    ys = F.when(both, F.col(y).cast("double"))
    den = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.covar_pop(xs, ys) / F.nullif(den, F.lit(0.0))


RANGES, RANGE_ROWS = 32, 100_000


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5, alias: str | None = None, *,
                   ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Exact quantile of ``value`` per group over any domain (the order
    statistics around ``q * (n - 1)``, interpolated; NULL and NaN skipped).

    Distributed selection: a mergeable sketch of every group proposes range
    bounds, rows are counted per range exactly (map-side, ``2 * ranges + 1``
    rows a group), and only the rows of the ranges that hold the wanted ranks
    go on, until each group has one value or at most ``range_rows`` rows left.
    The sketch only chooses where to cut, so the result does not depend on its
    error; a bound is a range of its own, so a value of any weight comes off
    at once.  No task sees more than a range of a group in order.  The
    intervals between rounds, one row a group, are written to the shared
    folder."""
    spark, alias = df.sparkSession, alias or f"quantile_{value}"
    keys = list(keys)
    folder = scratch_dir(spark, f"quantile/{uuid.uuid4().hex}")
    rows = (df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
            .select(F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_")).alias("_key"), F.col(value).alias("_v")))
    place = F.lit(q) * (F.col("n") - 1)
    state = (rows.groupBy("_key").agg(F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b"))
             .select("_key", "n", "a", "b", F.floor(place).alias("lo"), F.ceil(place).alias("hi"),
                     F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    open_ = (F.col("a") < F.col("b")) & (F.col("inside") > range_rows)
    step = 0
    while True:
        state.write.parquet(f"{folder}/{step}")
        state = spark.read.parquet(f"{folder}/{step}")
        if state.filter(open_).isEmpty():
            break
        step += 1
        active = state.filter(open_).withColumnRenamed("_key", "_group")
        held = rows.join(active, F.col("_key").eqNullSafe(F.col("_group"))).filter(F.col("_v").between(F.col("a"), F.col("b")))
        cuts = held.groupBy("_key").agg(F.array_distinct(F.percentile_approx(
            "_v", [i / ranges for i in range(1, ranges)], 20 * ranges)).alias("cuts")).withColumnRenamed("_key", "_cut")
        # range 2i: between cuts, 2i + 1: equal to a cut
        lower = F.size(F.filter("cuts", lambda c: c < F.col("_v")))
        counts = (held.join(cuts, F.col("_key").eqNullSafe(F.col("_cut")))
                  .withColumn("at", 2 * lower + F.array_contains("cuts", F.col("_v")).cast("int"))
                  .groupBy("_key", "lo", "hi", "below", "n", "at")
                  .agg(F.count("*").alias("c"), F.min("_v").alias("a"), F.max("_v").alias("b")))
        order = Window.partitionBy("_key").orderBy("at")                  # 2 * ranges rows a group at most
        ends = counts.withColumn("end", F.col("below") + F.sum("c").over(order)).withColumn("start", F.col("end") - F.col("c"))
        narrowed = (ends.filter((F.col("end") > F.col("lo")) & (F.col("start") <= F.col("hi"))).groupBy("_key", "n", "lo", "hi")
                    .agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("start").alias("below"), F.sum("c").alias("inside"))
                    .select(*state.columns))
        state = state.filter(~open_).unionByName(narrowed)
    last = state.withColumnRenamed("_key", "_group")
    left = (rows.join(last, F.col("_key").eqNullSafe(F.col("_group"))).filter(F.col("_v").between(F.col("a"), F.col("b")))
            .groupBy("_key", "lo", "hi", "below", "n", "_v").agg(F.count("*").alias("c")))
    end = F.col("below") + F.sum("c").over(Window.partitionBy("_key").orderBy("_v"))
    low, high = F.min(F.when(F.col("end") > F.col("lo"), F.col("_v"))), F.min(F.when(F.col("end") > F.col("hi"), F.col("_v")))
    found = (left.withColumn("end", end).groupBy("_key", "n", "lo").agg(low.cast("double").alias("x"), high.cast("double").alias("y")))
    part = F.lit(q) * (F.col("n") - 1) - F.col("lo")
    return found.select(*[F.col(f"_key.{k}").alias(k) for k in keys], (F.col("x") + (F.col("y") - F.col("x")) * part).alias(alias))
