"""Gradient-boosted trees, one model per player, all players in one job.

Histogram boosting on DataFrames.  Features are binned once into ``bins``
equal-width bins over their range.  A round fits one regression tree per
player to what the rounds before left over: for every level, one aggregation
sums the residuals of (player, node, feature, bin), running sums over a
node's bins give both sides of every cut, and the best cut is kept.  Only
those cuts (at most 2**depth a player) are written between levels; rows are
joined with their player's tree and walk it by expression.  Aggregates combine
map-side, so a player may hold any share of the rows, and no model and no row
passes through the driver.

Residuals are long integers of 1e-6 of the metric's unit, so sums are exact
and a fit does not depend on partitioning.  A cut's gain is
``L**2 / n_l + R**2 / n_r - S**2 / n`` (sums L, R of both sides); equal gains
go to the first feature, then the lower bin.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.features import PLAYER_FEATURES
from touchline.session import scratch_dir

UNITS = 1_000_000


@dataclass
class BoostedModels:
    """``base``: player_id, samples, base (mean of the metric); ``trees``:
    player_id, round, tree (map: node -> cut or leaf), in units of 1e-6."""
    metric: str
    base: DataFrame
    trees: DataFrame
    edges: list
    features: tuple
    bins: int
    depth: int


def feature_edges(rows: DataFrame, features: Sequence[str]) -> list[tuple[float, float]]:
    """(least value, bin width) of every feature: one row of aggregates."""
    ends = rows.agg(*[f(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{n}{i}")
                      for i, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max))]).first()
    return [(ends[f"a{i}"] or 0.0, (ends[f"b{i}"] or 0.0) - (ends[f"a{i}"] or 0.0)) for i in range(len(features))]


def _binned(features: Sequence[str], edges, bins: int) -> Column:
    def one(c, low, spread):
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        at = F.floor((x - F.lit(low)) * bins / F.lit(spread)) if spread else F.lit(0)
        return F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int")
    return F.array(*[one(c, *e) for c, e in zip(features, edges)])


def _node(tree: Column, bins: Column, depth: int) -> Column:
    """The node a row stands in: from the root, right where its bin is above the cut."""
    node = F.lit(1)
    for _ in range(depth):
        cut = F.try_element_at(tree, node)
        node = F.when(cut["feature"].isNull(), node).otherwise(
            2 * node + (F.get(bins, cut["feature"]) > cut["bin"]).cast("int"))
    return node


def _half_up(total: Column, n: Column) -> Column:
    """total / n rounded to an integer, halves up, in integers."""
    return F.call_function("div", 2 * total + n - F.pmod(2 * total + n, 2 * n), 2 * n)


def best_cuts(histogram: DataFrame, *, min_split: int, min_leaf: int) -> DataFrame:
    """player_id, node, feature, bin of the best cut of every node that has
    one.  ``histogram``: player_id, node, feature, bin, n, s."""
    by = Window.partitionBy("player_id", "node", "feature")
    so_far = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)   # at most a node's bins
    side = (histogram.withColumn("n_l", F.sum("n").over(so_far)).withColumn("s_l", F.sum("s").over(so_far))
            .withColumn("n_t", F.sum("n").over(by)).withColumn("s_t", F.sum("s").over(by)))
    square = lambda s, n: s.cast("double") * s.cast("double") / n.cast("double")
    n_r, s_r = F.col("n_t") - F.col("n_l"), F.col("s_t") - F.col("s_l")
    gain = square(F.col("s_l"), F.col("n_l")) + square(s_r, n_r) - square(F.col("s_t"), F.col("n_t"))
    fits = (F.col("n_t") >= min_split) & (F.col("n_l") >= min_leaf) & (n_r >= F.greatest(F.lit(min_leaf), F.lit(1)))
    return (side.filter(fits).withColumn("gain", gain).filter("gain > 0").groupBy("player_id", "node")
            .agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("best"))
            .select("player_id", "node", (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("bin")))


def train_boosted_per_player(rows: DataFrame, metric: str = "rating", *, rounds: int = 50, depth: int = 4,
                             rate: float = 0.1, min_split: int = 2, min_leaf: int = 1, bins: int = 64,
                             min_rows: int = 10, features: Sequence[str] = PLAYER_FEATURES,
                             split_col: str | None = None) -> BoostedModels:
    """One boosted model of ``metric`` for every player with at least
    ``min_rows`` rows that have it.  With ``split_col``, rows where it is true
    are held out.  ``rate`` is taken in thousandths."""
    spark = rows.sparkSession
    folder = scratch_dir(spark, f"boosting/{uuid.uuid4().hex}")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    known = rows.filter(F.col(metric).isNotNull() & F.col("player_id").isNotNull())
    known = known if split_col is None else known.filter(~F.col(split_col))
    # the rows are worked out once: edges, bases and residuals read what is kept
    known = kept(known.select("player_id", *dict.fromkeys([metric, *features])), "known")
    edges = feature_edges(known, features)
    slim = known.select("player_id", _binned(features, edges, bins).alias("bins"),
                        F.round(F.col(metric).cast("double") * UNITS).cast("long").alias("y"))
    base = slim.groupBy("player_id").agg(F.count("*").alias("samples"), F.sum("y").alias("s"))
    base = kept(base.filter(F.col("samples") >= min_rows)
                .select("player_id", "samples", _half_up(F.col("s"), F.col("samples")).alias("base")), "base")
    left = kept(slim.join(base, "player_id").select("player_id", "bins", (F.col("y") - F.col("base")).alias("r")), "left0")
    thousandths = round(rate * 1000)
    for number in range(1, rounds + 1):
        trees, placed = None, left.withColumn("node", F.lit(1))
        for level in range(depth):
            cells = (placed.filter(F.col("node") >= 1 << level)
                     .select("player_id", "node", "r", F.posexplode("bins").alias("feature", "bin"))
                     .groupBy("player_id", "node", "feature", "bin").agg(F.count("*").alias("n"), F.sum("r").alias("s")))
            cuts = kept(best_cuts(cells, min_split=min_split, min_leaf=min_leaf), f"cuts{number}-{level}")
            trees = cuts if trees is None else trees.unionByName(cuts)
            placed = _placed(left, _as_maps(trees), depth)
        leaves = (placed.groupBy("player_id", "node").agg(F.count("*").alias("n"), F.sum("r").alias("s"))
                  .select("player_id", "node", _half_up(F.col("s") * thousandths, F.col("n") * 1000).alias("value")))
        leaves = kept(leaves, f"leaves{number}")
        whole = trees.withColumn("value", F.lit(None).cast("long")).unionByName(
            leaves.select("player_id", "node", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("bin"), "value"))
        whole.withColumn("round", F.lit(number)).write.parquet(f"{folder}/trees/{number}")
        if number < rounds:
            left = kept(placed.join(leaves, ["player_id", "node"])
                        .select("player_id", "bins", (F.col("r") - F.col("value")).alias("r")), f"left{number}")
    nodes = spark.read.parquet(*[f"{folder}/trees/{n}" for n in range(1, rounds + 1)])
    return BoostedModels(metric, base, nodes, edges, tuple(features), bins, depth)


def _as_maps(cuts: DataFrame) -> DataFrame:
    """player_id, tree: a map of a player's cuts (fewer than 2**depth)."""
    return cuts.groupBy("player_id").agg(F.map_from_entries(F.collect_list(
        F.struct("node", F.struct("feature", "bin")))).alias("tree"))


def _placed(left: DataFrame, trees: DataFrame, depth: int) -> DataFrame:
    """Rows with the node they stand in; players without a cut stand in the root."""
    return (left.join(trees, "player_id", "left")
            .withColumn("node", F.when(F.col("tree").isNull(), F.lit(1)).otherwise(_node(F.col("tree"), F.col("bins"), depth)))
            .drop("tree"))


def predict_boosted(models: BoostedModels, rows: DataFrame) -> DataFrame:
    """``rows`` of players that have a model, with ``prediction``."""
    maps = (models.trees.groupBy("player_id", "round").agg(F.map_from_entries(F.collect_list(
        F.struct("node", F.struct("feature", "bin", "value")))).alias("tree"))
        .groupBy("player_id").agg(F.collect_list("tree").alias("_trees")))    # rounds x 2**depth entries a player
    bins = _binned(models.features, models.edges, models.bins)
    out = (rows.join(models.base.select("player_id", "base"), "player_id").join(maps, "player_id", "left")
           .withColumn("_bins", bins))
    leaf = F.transform(F.coalesce("_trees", F.expr("CAST(array() AS array<map<int, struct<feature:int,bin:int,value:bigint>>>)")),
                       lambda t: F.try_element_at(t, _node(t, F.col("_bins"), models.depth))["value"])
    total = F.aggregate(leaf, F.col("base"), lambda s, v: s + v)
    return out.withColumn("prediction", total / F.lit(float(UNITS))).drop("_trees", "_bins", "base")


def boosted_errors(models: BoostedModels, rows: DataFrame) -> DataFrame:
    """player_id, metric, n, mse, rmse over rows that have the metric."""
    far = (F.col("prediction") - F.col(models.metric).cast("double"))
    return (predict_boosted(models, rows.filter(F.col(models.metric).isNotNull())).groupBy("player_id")
            .agg(F.lit(models.metric).alias("metric"), F.count("*").alias("n"), F.avg(far * far).alias("mse"))
            .withColumn("rmse", F.sqrt("mse")))
