"""Ordered positions, running sums and row-count lookbacks per key, without
one window partition per key.

A ``Window.partitionBy(team_id)`` puts every match of a team into one task.
Teams (and players) do not grow with the data, so at scale each window
partition would hold a large share of all rows and parallelism would stop at
the number of teams.  The operators here split each key into ordered chunks
(for match data: calendar days), run the window per ``(key, chunk)``, add
per-chunk offsets computed from a small per-chunk totals table, and answer
"the previous N rows" with an equi-join on ``(key, position)``.  Every step
is a plain DataFrame operation; nothing is collected.

Positions are 1-based and follow ``order`` (its last column must make the
order total within a key, e.g. the match id).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UNB = Window.unboundedPreceding


def ordered_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                   chunk: Column, sums: Mapping[str, Column] | None = None,
                   tie: str | None = None) -> DataFrame:
    """Add ``seq`` (position within the key), ``n_key`` (rows of the key) and,
    per entry of ``sums``, ``<name>_before`` = sum over rows strictly before
    this one (NULL values skipped, 0 when none).

    With ``tie`` (a column of ``order``), also add ``seq_first`` (position of
    the first row sharing this row's ``tie`` value) and ``<name>_before_tie``
    (sum over rows with a strictly smaller ``tie`` value).  ``chunk`` must be
    a function of ``tie`` then, so that peers share a chunk.
    """
    sums = dict(sums or {})
    keys = list(keys)
    pk = [*keys, "_chunk"]
    d = df.withColumn("_chunk", chunk).withColumns({f"_v_{n}": v for n, v in sums.items()})
    w = Window.partitionBy(*pk).orderBy(*order)
    cols = {"_rn": F.row_number().over(w)}
    for n in sums:
        cols[f"_ex_{n}"] = F.coalesce(F.sum(f"_v_{n}").over(w.rowsBetween(_UNB, -1)), F.lit(0))
    if tie is not None:
        cols["_rk"] = F.rank().over(Window.partitionBy(*pk).orderBy(tie))
    d = d.withColumns(cols)
    if tie is not None:
        wp = Window.partitionBy(*pk, tie).orderBy(*order)
        d = d.withColumns({f"_ext_{n}": F.first(f"_ex_{n}").over(wp) for n in sums})

    # Per-chunk totals: one row per (key, chunk), grouped on the partitioning
    # the window already produced, then offsets over the chunks of each key.
    tot = d.groupBy(*pk).agg(
        F.count(F.lit(1)).alias("_c"),
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums],
    )
    wk = Window.partitionBy(*keys).orderBy("_chunk")
    off = tot.select(
        *pk,
        F.coalesce(F.sum("_c").over(wk.rowsBetween(_UNB, -1)), F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("n_key"),
        *[F.coalesce(F.sum(f"_s_{n}").over(wk.rowsBetween(_UNB, -1)), F.lit(0)).alias(f"_off_{n}")
          for n in sums],
    )
    out = d.join(off, pk)
    new = {"seq": F.col("_off") + F.col("_rn")}
    for n in sums:
        new[f"{n}_before"] = F.col(f"_off_{n}") + F.col(f"_ex_{n}")
    if tie is not None:
        new["seq_first"] = F.col("_off") + F.col("_rk")
        for n in sums:
            new[f"{n}_before_tie"] = F.col(f"_off_{n}") + F.col(f"_ext_{n}")
    out = out.withColumns(new)
    drop = ["_chunk", "_rn", "_off", "_rk", *[c for c in out.columns
                                               if c.startswith(("_v_", "_ex_", "_ext_", "_off_"))]]
    return out.drop(*[c for c in drop if c in out.columns])


def lookback_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                  chunk: Column, values: Mapping[str, Column], n: int,
                  strict_tie: str | None = None) -> DataFrame:
    """Mean of each value over the previous ``n`` rows of the same key.

    Equals ``AVG(v) OVER (PARTITION BY keys ORDER BY order ROWS BETWEEN n
    PRECEDING AND 1 PRECEDING)`` (NULL values skipped, NULL when no value).
    With ``strict_tie``, rows that share the ``strict_tie`` value with the
    current row are not "previous": every peer gets the mean over the ``n``
    rows before the first peer (strictly earlier rows only).

    Plan: one shuffle by ``(key, chunk)``.  A row whose ``n``-row frame lies
    inside its chunk is answered there by a ``rowsBetween(-n, -1)`` frame --
    with large chunks, almost every row.  Only the first ``n`` rows of a chunk
    (consumers) and the last ``n`` (providers of their prefix sum to position
    ``seq + n``) take the cross-chunk path: global prefixes from the per-chunk
    offsets, then a window over ``(key, position)`` pairs each consumer with
    its provider -- at most ``2n`` rows per chunk, no self-join.

    Output: the input columns plus one column per entry of ``values``.
    """
    keys = list(keys)
    pk = [*keys, "_chunk"]
    sums: dict[str, Column] = {}
    for name, v in values.items():
        sums[name] = v
        sums[f"_n_{name}"] = F.when(v.isNotNull(), F.lit(1)).otherwise(F.lit(0))
    d = df.withColumn("_chunk", chunk).withColumns({f"_v_{s}": e for s, e in sums.items()})
    w = Window.partitionBy(*pk).orderBy(*order)
    cols = {"_rn": F.row_number().over(w), "_c": F.count(F.lit(1)).over(Window.partitionBy(*pk))}
    for s in sums:
        cols[f"_ex_{s}"] = F.coalesce(F.sum(f"_v_{s}").over(w.rowsBetween(_UNB, -1)), F.lit(0))
        cols[f"_fr_{s}"] = F.coalesce(F.sum(f"_v_{s}").over(w.rowsBetween(-n, -1)), F.lit(0))
    if strict_tie is not None:
        cols["_rk"] = F.rank().over(Window.partitionBy(*pk).orderBy(strict_tie))
    d = d.withColumns(cols)
    if strict_tie is not None:
        # "here" is the first peer of the (key, tie) group: its prefix and frame.
        wp = Window.partitionBy(*pk, strict_tie).orderBy(*order)
        d = d.withColumns({**{f"_hx_{s}": F.first(f"_ex_{s}").over(wp) for s in sums},
                           **{f"_hf_{s}": F.first(f"_fr_{s}").over(wp) for s in sums},
                           "_hin": F.col("_rk")})
    else:
        d = d.withColumns({**{f"_hx_{s}": F.col(f"_ex_{s}") for s in sums},
                           **{f"_hf_{s}": F.col(f"_fr_{s}") for s in sums},
                           "_hin": F.col("_rn")})
    keep = [c for c in df.columns if c not in values]

    def means(num_prefix: str, lo_prefix: str | None = None):
        out = {}
        for name in values:
            if lo_prefix is None:
                tot, cnt = F.col(f"{num_prefix}{name}"), F.col(f"{num_prefix}_n_{name}")
            else:
                tot = F.col(f"{num_prefix}{name}") - F.col(f"{lo_prefix}{name}")
                cnt = F.col(f"{num_prefix}_n_{name}") - F.col(f"{lo_prefix}_n_{name}")
            out[name] = F.when(cnt > 0, tot.cast("double") / cnt)
        return out

    # 1) Frames inside the chunk: answered locally.
    local = d.filter(F.col("_hin") - F.lit(n) >= 1).withColumns(means("_hf_")).select(*keep, *values)

    # 2) Cross-chunk path for chunk heads (consumers) and tails (providers).
    tot = d.groupBy(*pk).agg(*[F.sum(f"_v_{s}").alias(f"_s_{s}") for s in sums],
                             F.count(F.lit(1)).alias("_cc"))
    wk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(_UNB, -1)
    off = tot.select(*pk, F.coalesce(F.sum("_cc").over(wk), F.lit(0)).alias("_off"),
                     *[F.coalesce(F.sum(f"_s_{s}").over(wk), F.lit(0)).alias(f"_o_{s}") for s in sums])
    consumer = F.col("_hin") - F.lit(n) < 1
    provider = F.col("_rn") + F.lit(n) > F.col("_c")
    edge = d.filter(consumer | provider).join(off, pk)
    payload = [c for c in keep if c not in keys]
    rec = F.explode(F.array(
        F.struct(consumer.alias("_use"), F.lit(0).alias("_kind"),
                 (F.col("_off") + F.col("_hin")).cast("long").alias("_pos"),
                 *[F.lit(None).cast("double").alias(f"_p_{s}") for s in sums]),
        F.struct(provider.alias("_use"), F.lit(1).alias("_kind"),
                 (F.col("_off") + F.col("_rn") + F.lit(n)).cast("long").alias("_pos"),
                 *[(F.col(f"_o_{s}") + F.col(f"_ex_{s}")).cast("double").alias(f"_p_{s}") for s in sums]),
    )).alias("_r")
    e = edge.select(*keys, *payload,
                    *[(F.col(f"_o_{s}") + F.col(f"_hx_{s}")).cast("double").alias(f"_g_{s}") for s in sums],
                    rec).filter(F.col("_r._use"))
    own = F.col("_r._kind") == 0
    e = e.select(*keys, *[F.when(own, F.col(c)).alias(c) for c in payload],
                 *[F.when(own, F.col(f"_g_{s}")).alias(f"_g_{s}") for s in sums],
                 F.col("_r._kind").alias("_kind"), F.col("_r._pos").alias("_pos"),
                 *[F.col(f"_r._p_{s}").alias(f"_p_{s}") for s in sums])
    wpos = Window.partitionBy(*keys, "_pos")
    e = e.withColumns({f"_lo_{s}": F.coalesce(F.max(f"_p_{s}").over(wpos), F.lit(0.0)) for s in sums})
    edge_out = e.filter(F.col("_kind") == 0).withColumns(means("_g_", "_lo_")).select(*keep, *values)
    return local.unionByName(edge_out)


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, chunk: Column,
           n: int) -> DataFrame:
    """The newest ``n`` rows of each key (W4), with ``recency`` 1 = newest and
    ``form_position`` 1 = oldest of the kept rows (W5).

    Only the tail of each key is ever sorted: per-chunk row counts (a
    map-side combined aggregate) tell which newest chunks can hold the last
    ``n`` rows; rows of other chunks are dropped by a join with that small
    table before any window runs."""
    keys = list(keys)
    pk = [*keys, "_chunk"]
    d = df.withColumn("_chunk", chunk)
    cnt = d.groupBy(*pk).agg(F.count(F.lit(1)).alias("_c"))
    newer = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(_UNB, -1)
    tail = cnt.select(*pk, F.coalesce(F.sum("_c").over(newer), F.lit(0)).alias("_after"),
                      F.sum("_c").over(Window.partitionBy(*keys)).alias("_nk")) \
        .filter(F.col("_after") < n)
    rows = d.join(tail, pk)
    wd = Window.partitionBy(*pk).orderBy(*[F.desc(c) for c in order])
    # the plain rank limit first: Spark then keeps n rows per chunk in every
    # map task, before the shuffle, however many rows a chunk has
    rows = rows.withColumn("_rn", F.row_number().over(wd)).filter(F.col("_rn") <= n)
    rows = rows.withColumn("recency", F.col("_after") + F.col("_rn")).filter(F.col("recency") <= n)
    return rows.withColumn("form_position", F.least(F.col("_nk"), F.lit(n)) - F.col("recency") + 1) \
        .drop("_chunk", "_after", "_nk", "_rn")


def lookback_before(df: DataFrame, keys: Sequence[str], tie: str, order: Sequence[str], *, chunk: Column,
                    values: Mapping[str, Column], n: int) -> DataFrame:
    """Mean of each value over the ``n`` rows of the key that precede this
    row's ``tie`` value (strictly earlier rows; rows of one tie value do not
    see one another), as columns added to ``df``.

    The answer is the same for all rows of a (key, tie), and only the newest
    ``n`` rows of an earlier (key, tie) can matter.  So each (key, tie) is
    first cut to its newest ``n`` rows -- a rank limit that Spark applies in
    every map task -- and the lookback runs over those; a team-day that holds
    most rows of the table is ``n`` rows like any other.  The answers are
    joined back on (key, tie), a join without windows that AQE can split."""
    keys = list(keys)
    newest = Window.partitionBy(*keys, tie).orderBy(*[F.desc(c) for c in order])
    few = (df.select(*keys, *dict.fromkeys([tie, *order]), *[v.alias(name) for name, v in values.items()])
           .withColumn("_newest", F.row_number().over(newest)).filter(F.col("_newest") <= n))
    seen = lookback_mean(few, keys, order, chunk=chunk, values={name: F.col(name) for name in values}, n=n,
                         strict_tie=tie)
    on = [*keys, tie]
    answers = seen.filter(F.col("_newest") == 1).select(*[F.col(c).alias(f"_at_{c}") for c in on], *values)
    rows = df.drop(*values)
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in on]
    return rows.join(answers, same).drop(*[f"_at_{c}" for c in on])


CHUNK_CONF = "spark.touchline.chunkUnit"


def time_chunk(ts: str = "match_date", unit: str | None = None) -> Column:
    """Chunk for match-ordered data: ``date_trunc(unit, ts)``.

    The unit should make a chunk hold roughly 1e5-1e6 rows: large enough
    that most lookback frames stay inside their chunk, small enough to sort
    in one task.  It is read from the session conf ``spark.touchline.chunkUnit``
    (default ``month`` -- right for test scale; ``day`` for 100 TB class data,
    see ``session.CLUSTER_CONF``).  Rows with equal timestamps always share a
    chunk, as the strict lookbacks require."""
    if unit is None:
        from pyspark.sql import SparkSession
        active = SparkSession.getActiveSession()
        unit = active.conf.get(CHUNK_CONF, "month") if active is not None else "month"
    return F.date_trunc(unit, F.col(ts))

