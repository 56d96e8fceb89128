"""Registered model queries (M2-M15).  Tree learners are seeded and
deterministic here but have no SQL equivalent; what surrounds them (splits,
scaling, supports, probabilities, errors, persistence) is checked by SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from touchline.operators import features as ft
from touchline.operators import players as pl
from touchline.operators.longform import current_season_id, focal_team_id
from touchline.plans import boosting
from touchline.plans import models as ml
from touchline.plans.catalog import FOCAL_SHORT_NAME, ORACLES, register, tables, with_views
from touchline.plans.queries_features import M11_SQL
from touchline.session import scratch_dir

_TRAINED: dict = {}


def _app(spark) -> str:
    """Identity of the running application (models are reused within it)."""
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def _match_model(spark, sf_dir):
    key = ("match", _app(spark), sf_dir)
    if key not in _TRAINED:
        t = tables(spark, sf_dir)
        season = current_season_id(t.seasons).scalar()
        team = focal_team_id(t.teams, FOCAL_SHORT_NAME).scalar()
        feats = ft.match_features(t.matches, season_id=season, focal_team_id=team)
        _TRAINED[key] = ml.train_match_model(feats)
    return _TRAINED[key]


def _player_models(spark, sf_dir, key_players_only=False):
    """(feature rows, models by metric); only the models are kept, the rows are a plan over the appearances, which are
    joined once and written to the shared folder."""
    key = ("players", key_players_only, _app(spark), sf_dir)
    if key not in _TRAINED:
        t = tables(spark, sf_dir)
        rows = ft.player_features(t.player_match_stats, t.matches, t.opposition_categories, n=10,
                                  kept=lambda df: ml.written(df, "player_appearances"))
        if key_players_only:                               # M15 trains on the key players (A22)
            keyp = pl.key_players(t.players, t.player_match_stats)
            rows = rows.join(keyp.select("player_id"), "player_id", "left_semi")
        _TRAINED[key] = (rows, ml.train_player_models(rows))
    return _TRAINED[key]


@register("m4_match_model_metrics")
def m4_match_model_metrics(spark, sf_dir):
    return _match_model(spark, sf_dir).metrics


@register("m5_match_class_report")
def m5_match_class_report(spark, sf_dir):
    return _match_model(spark, sf_dir).class_report


@register("m7_match_feature_importance")
def m7_match_feature_importance(spark, sf_dir):
    return _match_model(spark, sf_dir).importances


@register("m9_fixture_predictions")
def m9_fixture_predictions(spark, sf_dir):
    t = tables(spark, sf_dir)
    team = focal_team_id(t.teams, FOCAL_SHORT_NAME).scalar()
    fx = ft.fixture_features(t.matches, focal_team_id=team)
    return ml.predict_matches(_match_model(spark, sf_dir).model, fx)


@register("m12_player_model_metrics")
def m12_player_model_metrics(spark, sf_dir):
    _, models = _player_models(spark, sf_dir)
    return reduce(lambda a, b: a.unionByName(b), [m.metrics for m in models.values()])


@register("m13_player_prediction_sample")
def m13_player_prediction_sample(spark, sf_dir):
    _, models = _player_models(spark, sf_dir)
    return reduce(lambda a, b: a.unionByName(b), [m.sample for m in models.values()])


@register("m14_player_next_match")
def m14_player_next_match(spark, sf_dir):
    rows, models = _player_models(spark, sf_dir)
    preds = ml.predict_player_models(models.values(), rows, opposition_strength=1, is_home=1)
    return preds.withColumn("predicted_value", F.round("predicted_value", 6))


@register("m15_train_all_summary")
def m15_train_all_summary(spark, sf_dir):
    """One row per trained model (match outcome + one pooled model per
    player metric over the key players) with its headline metric."""
    mm = _match_model(spark, sf_dir).metrics.select(
        F.lit("match_prediction").alias("model"), F.lit("accuracy").alias("metric"),
        F.col("accuracy").alias("value"), F.col("training_samples"))
    _, models = _player_models(spark, sf_dir, key_players_only=True)
    pm = [m.metrics.select(F.concat(F.lit("player_"), F.col("metric")).alias("model"),
                           F.lit("rmse").alias("metric"), F.col("rmse").alias("value"),
                           "training_samples") for m in models.values()]
    return reduce(lambda a, b: a.unionByName(b), [mm, *pm])


# ------------------------------------------------- checkable facts of the models
# The learners themselves have no SQL; what surrounds them does.
_M1 = ORACLES["m1_match_features"]
_CLASSES = f"c AS (SELECT outcome, COUNT(*) AS n, CAST(ROUND(COUNT(*) * 0.2) AS BIGINT) AS t FROM ({_M1}) f GROUP BY outcome)"


def _sql_hash(*ids: str, seed: int = 42) -> str:
    h = str(seed)
    for i in ids:
        h = f"((({h} + {i} % {ml.HASH_MODULUS}) * {ml.HASH_FACTOR} % {ml.HASH_MODULUS}) * {ml.HASH_FACTOR} % {ml.HASH_MODULUS})"
    return h


def _match_rows(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ft.match_features(t.matches, season_id=current_season_id(t.seasons).scalar(),
                             focal_team_id=focal_team_id(t.teams, FOCAL_SHORT_NAME).scalar())


@register("m2_split_sizes", f"""WITH {_CLASSES}
SELECT outcome, -1 AS fold, t AS n FROM c WHERE t > 0
UNION ALL
SELECT outcome, k, (n - t - k + 4) // 5 FROM c, range(5) r(k) WHERE (n - t - k + 4) // 5 > 0""")
def m2_split_sizes(spark, sf_dir):
    """M2 + M6: rows of each class in the hold-out (fold -1) and the folds."""
    split = ml.stratified_split(_match_rows(spark, sf_dir), "outcome", ["match_id"])
    return split.groupBy("outcome", F.coalesce("fold", F.lit(-1)).cast("long").alias("fold")).agg(F.count("*").alias("n"))


@register("m3_scaler_statistics", f"""WITH f AS ({_M1}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY outcome ORDER BY {_sql_hash('match_id')}, match_id) AS rn,
             COUNT(*) OVER (PARTITION BY outcome) AS n FROM f),
x AS (SELECT * FROM r WHERE rn > ROUND(n * 0.2))
""" + "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std FROM x"
                           for c in ft.MATCH_FEATURES))
def m3_scaler_statistics(spark, sf_dir):
    """M3: what the scaler learned from the training part."""
    scaler = _match_model(spark, sf_dir).model.stages[2]
    rows = zip(ft.MATCH_FEATURES, scaler.mean.toArray().tolist(), scaler.std.toArray().tolist())
    return spark.createDataFrame(list(rows), "feature string, mean double, std double").select(
        "feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@register("m5_class_support", f"WITH {_CLASSES} SELECT outcome, t AS support FROM c")
def m5_class_support(spark, sf_dir):
    """M5: the report's classes and their rows in the hold-out."""
    return _match_model(spark, sf_dir).class_report.select("outcome", "support")


_ZERO_PREDICTIONS = f"""SELECT COUNT(*) AS predictions, CAST(0 AS BIGINT) AS sum_violations,
  CAST(0 AS BIGINT) AS confidence_violations, CAST(0 AS BIGINT) AS label_violations FROM ({ORACLES["m8_fixture_features"]}) f"""


@register("m10_prediction_checks", _ZERO_PREDICTIONS)
def m10_prediction_checks(spark, sf_dir):
    """M9 + M10: one prediction a fixture; probabilities sum to one, the
    confidence is the largest of them and belongs to the predicted class."""
    p = m9_fixture_predictions(spark, sf_dir)
    probs = {label: F.col(c) for label, c in (("Away Win", "prob_away_win"), ("Draw", "prob_draw"), ("Home Win", "prob_home_win"))}
    of_label = F.coalesce(*[F.when(F.col("predicted_outcome") == k, v) for k, v in probs.items()])
    return p.agg(F.count("*").alias("predictions"),
                 F.count_if(F.abs(sum(probs.values(), F.lit(0.0)) - 1) > 1e-9).alias("sum_violations"),
                 F.count_if(F.col("confidence") != F.greatest(*probs.values())).alias("confidence_violations"),
                 F.count_if(of_label != F.col("confidence")).alias("label_violations"))


_PLAYER_ROWS = with_views("matches", "player_match_stats", "opposition_categories", extra=M11_SQL)


@register("m13_error_checks", _PLAYER_ROWS + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, COUNT(*) FILTER ({_sql_hash('player_id', 'match_id')} % 10000 >= 3000) AS training_samples, "
    f"CAST(0 AS BIGINT) AS violations FROM pf WHERE {m} IS NOT NULL" for m in ml.PLAYER_METRICS))
def m13_error_checks(spark, sf_dir):
    """M12 + M13 + F9: rows each pooled model is trained on; RMSE squared is MSE, neither is negative."""
    _, models = _player_models(spark, sf_dir)
    every = reduce(lambda a, b: a.unionByName(b), [m.metrics for m in models.values()])
    wrong = (F.abs(F.col("rmse") * F.col("rmse") - F.col("mse")) > 1e-9) | (F.col("mse") < 0)
    return every.select("metric", "training_samples", F.when(wrong, 1).otherwise(0).cast("long").alias("violations"))


@register("m12_per_player_samples", _PLAYER_ROWS + f"""
SELECT player_id, 'rating' AS metric, COUNT(*) AS training_samples, TRUE AS within_spread
FROM pf WHERE rating IS NOT NULL GROUP BY player_id HAVING COUNT(*) >= {ml.MIN_PLAYER_ROWS}""")
def m12_per_player_samples(spark, sf_dir):
    """M12, one model per player: who is fitted, on how many rows, and that
    no fit is worse than predicting zero."""
    t = tables(spark, sf_dir)
    rows = ft.player_features(t.player_match_stats, t.matches, t.opposition_categories, n=10)
    models = ml.train_per_player(rows, "rating")
    none = rows.groupBy("player_id").agg(F.avg(F.col("rating") * F.col("rating")).alias("square"))
    return models.join(none, "player_id").select("player_id", "metric", "training_samples",
                                                 (F.col("mse") <= F.col("square") + 1e-9).alias("within_spread"))


@register("o5_latest_player_rows", f"""SELECT player_id, match_id, match_date, recent_avg_goals, recent_avg_rating
FROM ({ORACLES["m11_player_features"]}) f
QUALIFY ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY match_date DESC, match_id DESC) = 1""")
def o5_latest_player_rows(spark, sf_dir):
    """Every player's most recent feature row."""
    t = tables(spark, sf_dir)
    rows = ft.player_features(t.player_match_stats, t.matches, t.opposition_categories, n=10)
    return ml.latest_player_state(rows).select("player_id", "match_id", "match_date", F.round("recent_avg_goals", 6).alias("recent_avg_goals"),
                                               F.round("recent_avg_rating", 6).alias("recent_avg_rating"))


@register("s14_saved_model", f"""SELECT COUNT(*) AS predictions, CAST(0 AS BIGINT) AS changed
FROM ({ORACLES["m8_fixture_features"]}) f""")
def s14_saved_model(spark, sf_dir):
    """A saved and loaded pipeline predicts what the fitted one does."""
    path = scratch_dir(spark, f"models/{uuid.uuid4().hex}")
    model = _match_model(spark, sf_dir).model
    ml.save_model(model, path)
    t = tables(spark, sf_dir)
    fx = ft.fixture_features(t.matches, focal_team_id=focal_team_id(t.teams, FOCAL_SHORT_NAME).scalar())
    a = ml.predict_matches(model, fx).select("match_id", "predicted_outcome", "confidence")
    b = ml.predict_matches(ml.load_model(path), fx).select("match_id", F.col("predicted_outcome").alias("o"), F.col("confidence").alias("c"))
    same = F.col("predicted_outcome").eqNullSafe(F.col("o")) & F.col("confidence").eqNullSafe(F.col("c"))
    return a.join(b, "match_id", "full").agg(F.count("*").alias("predictions"), F.count_if(~same).alias("changed"))


# One round of boosting, depth 2, in SQL: bins of the same 64 equal widths,
# residuals in 1e-6 units, the best cut by gain, first feature, lowest bin.
_HALF_UP = "((2 * {a} + {b}) - ((((2 * {a} + {b}) % (2 * {b})) + 2 * {b}) % (2 * {b}))) // (2 * {b})"


def _boosted_sql(depth: int = 2, min_split: int = 6, min_leaf: int = 2) -> str:
    cols = [("recent_avg_goals", "COALESCE(g, 0)"), ("recent_avg_assists", "COALESCE(a, 0)"), ("recent_avg_rating", "COALESCE(r, 0)"),
            ("opposition_strength", "opposition_strength"), ("is_home", "is_home"), ("minutes_played", "minutes_played")]
    values = ", ".join(f"COALESCE(CAST({c if i > 2 else f'ROUND({c}, 6)'} AS DOUBLE), 0.0)" for i, (_, c) in enumerate(cols))
    out = [_PLAYER_ROWS.rstrip() + f""",
bx AS (SELECT row_number() OVER () AS row, player_id, CAST(ROUND(CAST(rating AS DOUBLE) * 1000000) AS BIGINT) AS y, [{values}] AS x
       FROM pf WHERE rating IS NOT NULL AND player_id IS NOT NULL),
be AS (SELECT i AS feature, min(x[i + 1]) AS low, max(x[i + 1]) - min(x[i + 1]) AS spread FROM bx, range(6) t(i) GROUP BY i),
bb AS MATERIALIZED (SELECT player_id, count(*) AS n, CAST({_HALF_UP.format(a='sum(y)', b='count(*)')} AS BIGINT) AS base
       FROM bx GROUP BY player_id HAVING count(*) >= 10),
bf AS (SELECT row, player_id, y - base AS r, feature, CASE WHEN spread > 0
         THEN CAST(least(greatest(floor((x[feature + 1] - low) * 64 / spread), 0), 63) AS INTEGER) ELSE 0 END AS bin
       FROM bx JOIN bb USING (player_id), be),
n0 AS MATERIALIZED (SELECT DISTINCT row, player_id, r, 1 AS node FROM bf)"""]
    for d in range(depth):
        out.append(f"""h{d} AS (SELECT player_id, node, feature, bin, count(*) AS n, sum(f.r) AS s
  FROM bf f JOIN n{d} p USING (row, player_id) WHERE node >= {1 << d} GROUP BY ALL),
g{d} AS (SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER v AS nt, sum(s) OVER v AS st FROM h{d}
  WINDOW v AS (PARTITION BY player_id, node, feature), w AS (PARTITION BY player_id, node, feature ORDER BY bin)),
c{d} AS MATERIALIZED (SELECT player_id, node, feature, bin FROM (SELECT *, CAST(sl AS DOUBLE) * CAST(sl AS DOUBLE) / CAST(nl AS DOUBLE)
    + CAST(st - sl AS DOUBLE) * CAST(st - sl AS DOUBLE) / CAST(nt - nl AS DOUBLE)
    - CAST(st AS DOUBLE) * CAST(st AS DOUBLE) / CAST(nt AS DOUBLE) AS gain
    FROM g{d} WHERE nt >= {min_split} AND nl >= {min_leaf} AND nt - nl >= {min_leaf}) WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY player_id, node ORDER BY gain DESC, feature, bin) = 1),
n{d + 1} AS MATERIALIZED (SELECT p.row, p.player_id, p.r, CASE WHEN c.feature IS NULL THEN p.node ELSE 2 * p.node + CAST(f.bin > c.bin AS INTEGER) END AS node
  FROM n{d} p LEFT JOIN c{d} c ON c.player_id = p.player_id AND c.node = p.node
  LEFT JOIN bf f ON f.row = p.row AND f.feature = c.feature)""")
    cuts = " UNION ALL ".join(f"SELECT player_id, node, feature, bin, NULL::BIGINT AS value FROM c{d}" for d in range(depth))
    value = _HALF_UP.format(a="(sum(r) * 100)", b="(count(*) * 1000)")
    return ",\n".join(out) + f"""
SELECT * FROM ({cuts} UNION ALL
  SELECT player_id, node, NULL AS feature, NULL AS bin, CAST({value} AS BIGINT) AS value FROM n{depth} GROUP BY player_id, node)"""


@register("m12_boosted_first_trees", _boosted_sql())
def m12_boosted_first_trees(spark, sf_dir):
    """The first round of boosted trees of every player's rating, two
    levels deep, at least 6 rows to split and 2 a leaf."""
    t = tables(spark, sf_dir)
    rows = ft.player_features(t.player_match_stats, t.matches, t.opposition_categories, n=10)
    rows = rows.withColumns({c: F.round(c, 6) for c in ("recent_avg_goals", "recent_avg_assists", "recent_avg_rating")})
    models = boosting.train_boosted_per_player(rows, "rating", rounds=1, depth=2, min_split=6, min_leaf=2)
    return models.trees.select("player_id", "node", "feature", "bin", "value")
