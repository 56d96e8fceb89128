"""Model behaviour: deterministic for a fixed seed, probabilities sum to 1,
one prediction per input row, save/load round-trip, stratified split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import features as ft
from touchline.plans import models as ml

from conftest import SF_MID, SF_SMALL


def test_match_model(spark, tmp_dir):
    from touchline.sources.fixture_map import sport_tables
    t = sport_tables(spark, SF_MID)
    feats = ft.match_features(t.matches, season_id=1997, focal_team_id=9).cache()
    split = ml.stratified_split(feats, "outcome", ["match_id"])
    per = split.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    for r in per:
        assert r["t"] == round(r["n"] * 0.2)
    folds = split.filter(~F.col("is_test")).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4]

    a = ml.train_match_model(feats, folds=2)
    b = ml.train_match_model(feats, folds=2)
    assert a.metrics.first()["accuracy"] == b.metrics.first()["accuracy"]
    fx = ft.fixture_features(t.matches, focal_team_id=9)
    pred = ml.predict_matches(a.model, fx)
    assert pred.count() == fx.count()
    s = pred.select((F.col("prob_away_win") + F.col("prob_draw") + F.col("prob_home_win")).alias("s"))
    assert s.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    ml.save_model(a.model, f"{tmp_dir}/model")
    back = ml.load_model(f"{tmp_dir}/model")
    p2 = ml.predict_matches(back, fx)
    assert p2.exceptAll(pred).count() == 0


def test_fits_do_not_depend_on_the_session(spark, monkeypatch):
    """A fit has as many tasks as its rows ask for, not one for each shuffle partition."""
    rnd = np.random.default_rng(5)
    rows = [(i, ("Home Win", "Draw", "Away Win")[i % 3], *map(float, rnd.normal(size=8) + i % 3)) for i in range(240)]
    feats = spark.createDataFrame(rows, ["match_id", "outcome", *ml.MATCH_FEATURES])
    monkeypatch.setattr(ml, "FOREST_ROWS", 20)
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            m = ml.train_match_model(feats, folds=2)
            got.append((m.metrics.collect(), m.class_report.orderBy("outcome").collect(), m.importances.collect()))
        split = ml.player_split(spark.range(300).selectExpr("id % 7 AS player_id", "id AS match_id"))
        assert split.rdd.getNumPartitions() == ml.LEAST_TASKS and split.count() == 300
        split.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and got[0][0][0].training_samples == 192
    assert sum(r.support for r in got[0][1]) == 48


def test_small_results_of_the_match_model_are_in_the_plan(spark):
    """No Python worker starts for the metrics, the report and the importances; the report is that of the counts."""
    rnd = np.random.default_rng(6)
    rows = [(i, ("Home Win", "Draw", "Away Win")[i % 3], *map(float, rnd.normal(size=8) / 3)) for i in range(120)]
    model = ml.train_match_model(spark.createDataFrame(rows, ["match_id", "outcome", *ml.MATCH_FEATURES]), folds=2)
    for df in (model.metrics, model.class_report, model.importances):
        assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    assert model.class_report.dtypes == [("outcome", "string"), ("precision", "double"), ("recall", "double"), ("f1", "double"), ("support", "bigint")]
    assert [r.outcome for r in model.class_report.collect()] == model.labels and model.metrics.first().test_samples == 24


def test_match_model_is_fitted_over_short_plans(spark, monkeypatch):
    """The fits read a written split and not a plan with all that led to it, no tree becomes a Python object unless
    asked for, labels that are known are those an index would find, and accuracies are the evaluator's."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    rnd, fitted, fit = np.random.default_rng(7), [], ml.Pipeline.fit

    def seen(pipe, rows):
        model = fit(pipe, rows)
        fitted.append((rows, model))
        return model

    monkeypatch.setattr(ml.Pipeline, "fit", seen)
    rows = [(i, ("Home Win", "Draw", "Away Win")[i % 3], *map(float, rnd.normal(size=8) + i % 3 / 2)) for i in range(150)]
    m = ml.train_match_model(spark.createDataFrame(rows, ["match_id", "outcome", *ml.MATCH_FEATURES]), folds=2)
    assert len(fitted) == 3
    for rows, model in fitted:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Existing RDD" in plan or "ExistingRDD" in plan
        assert "InMemoryRelation" not in plan and "Window" not in plan
        assert "trees" not in vars(model.stages[-1])
        assert list(model.stages[0].labels) == list(ml.match_pipeline().getStages()[0].fit(rows).labels) == ["Away Win", "Draw", "Home Win"]
        counts = ml._confusion(model, rows)
        of = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="accuracy")
        assert sum(counts.values()) == rows.count() and ml._accuracy(counts) == of.evaluate(model.transform(rows))
    assert len(m.model.stages[-1].trees) == 100


def test_class_report_of_confusion_counts():
    """A class never predicted, one never met, one predicted only wrongly."""
    counts = {("A", "A"): 3, ("A", "B"): 1, ("B", "A"): 2, ("C", "A"): 1}
    assert ml._class_report(["A", "B", "C", "D"], counts) == [
        ("A", 0.5, 0.75, 0.6, 4), ("B", 0.0, 0.0, 0.0, 2), ("C", 0.0, 0.0, 0.0, 1), ("D", 0.0, 0.0, 0.0, 0)]


def test_player_model(spark, small):
    feats = ft.player_features(small.player_match_stats, small.matches, small.opposition_categories)
    m = ml.train_player_model(feats, "goals")
    r = m.metrics.first()
    assert r["rmse"] >= 0 and abs(r["rmse"] ** 2 - r["mse"]) < 1e-9
    nxt = ml.predict_players(m, feats)
    assert nxt.count() == feats.select("player_id").distinct().count()


def test_models_share_the_latest_state(spark, small):
    """Predictions of several models are those of each one; the players' latest rows are found once."""
    feats = ft.player_features(small.player_match_stats, small.matches, small.opposition_categories)
    models = ml.train_player_models(feats, ("goals", "assists"))
    every = ml.predict_player_models(models.values(), feats)
    each = ml.predict_players(models["goals"], feats).unionByName(ml.predict_players(models["assists"], feats))
    assert every.columns == each.columns and every.exceptAll(each).count() == 0 and each.exceptAll(every).count() == 0
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()      # noqa: E731
    assert plan(every).count("max_by") == plan(ml.predict_players(models["goals"], feats)).count("max_by")


def test_one_model_per_player(spark):
    """Ridge fits from sums of products equal numpy's on the rows; players below ten rows have none."""
    rnd = np.random.default_rng(2)
    rows = []
    for player, n in ((1, 40), (2, 10), (3, 9), (4, 500)):
        for i in range(n):
            x = rnd.normal(size=6)
            rows.append((player, i, *map(float, x), float(3 + x @ np.arange(6) * player + rnd.normal() * 0.1)))
    cols = ["player_id", "match_id", *ml.PLAYER_FEATURES, "rating"]
    df = spark.createDataFrame(rows, cols).repartition(4)
    models = ml.train_per_player(df, "rating", ridge=0.5)
    got = {r.player_id: r for r in models.collect()}
    assert sorted(got) == [1, 2, 4]
    for p, r in got.items():
        mine = np.array([x[2:] for x in rows if x[0] == p])
        a, y = np.hstack([np.ones((len(mine), 1)), mine[:, :6]]), mine[:, 6]
        w = np.linalg.solve(a.T @ a + 0.5 * np.eye(7), a.T @ y)
        assert np.allclose(r.coefficients, w) and np.isclose(r.mse, ((a @ w - y) ** 2).mean()) and r.training_samples == len(mine)
    pred = ml.predict_per_player(models, df).collect()
    assert len(pred) == 550 and all(abs(r.prediction - r.rating) < 5 for r in pred if r.player_id == 4)


def _appearances(spark, n, rating="round(5 + (id * 7919 % 1009) / 300.0 + is_home - opposition_strength / 3.0, 6)"):
    """Feature rows of few different values, some of them rare."""
    return spark.range(n).selectExpr("id", "id * 7 % 3001 AS k").selectExpr(
        "id", "id % 97 AS player_id", "id AS match_id", "(k * 31 % 47) * (k % 3) / 10.0D AS recent_avg_goals", "(k * 17 % 11) / 11.0D AS recent_avg_assists",
        "7 + (k * 13 % 83) / 40.0D AS recent_avg_rating", "CAST(1 + k % 4 AS INT) AS opposition_strength", "CAST(k % 7 < 3 AS INT) AS is_home",
        "40 + k * 53 % 51 AS minutes_played").selectExpr("*", f"{rating} AS rating")


def test_counted_rows_give_the_model_of_all_rows(spark, monkeypatch):
    """Boosted trees over the counts of rows of the same bins are those over the rows: MLlib's cuts (of a sample, as there
    are more than ten thousand rows) and, but for cuts of equal gain, its predictions."""
    n = 12_000
    rows = ml.deterministic_order(_appearances(spark, n), ["player_id", "match_id"], rows=n, rows_per_task=1_000).cache()
    plain = ml.fit_boosted(rows, n, "rating")
    monkeypatch.setattr(ml, "COUNTED_ROWS", 1_000)
    fitted, fit = [], ml.GBTRegressor.fit
    monkeypatch.setattr(ml.GBTRegressor, "fit", lambda self, df, *a: (fitted.append(df.count()), fit(self, df, *a))[1])
    counted = ml.fit_boosted(rows, n, "rating")
    assert [type(s).__name__ for s in plain.stages] == ["VectorAssembler", "StandardScalerModel", "GBTRegressionModel"]
    scaler, bins = counted.stages[1:3]
    assert fitted == [bins.transform(rows).select(*bins.getOutputCols()).distinct().count()] and fitted[0] < n
    assert scaler.mean == plain.stages[1].mean and scaler.std == plain.stages[1].std

    used, todo = set(), [t._java_obj.rootNode() for t in plain.stages[-1].trees]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "InternalNode":
            used.add((node.split().featureIndex(), node.split().threshold()))
            todo += [node.leftChild(), node.rightChild()]
    assert len(used) > 60
    for i, cut in used:
        inner = np.array(bins.getSplitsArray()[i][1:-1])
        scaled = lambda x: (x - scaler.mean[i]) * (1.0 / scaler.std[i])                # noqa: E731
        assert ((scaled(np.nextafter(inner, -np.inf)) <= cut) & (cut < scaled(inner))).sum() == 1

    both = plain.transform(rows).select("id", F.col("prediction").alias("a")).join(
        counted.transform(rows).select("id", F.col("prediction").alias("b")), "id")
    assert both.count() == n and both.filter(F.abs(F.col("a") - F.col("b")) > 1e-9).count() <= n // 100
    rows.unpersist()


def test_counts_of_bins_hold_every_row(spark):
    """Each row is in one count; means are exact, whatever the order of the rows."""
    n, bins = 3_000, None
    for parts in (1, 7):
        rows = _appearances(spark, n).repartition(parts)
        bins = bins or ml.Bucketizer(inputCols=list(ml.PLAYER_FEATURES), outputCols=[f"{c}_bin" for c in ml.PLAYER_FEATURES],
                                     splitsArray=[[-float("inf"), 1.0, 7.5, float("inf")]] * 6, handleInvalid="keep")
        got = {tuple(int(r[c]) for c in bins.getOutputCols()): (r["samples"], r["rating"]) for r in ml.binned_counts(rows, "rating", bins).collect()}
        want = {}
        for r in rows.collect():
            want.setdefault(tuple(int(r[c] >= 1) + int(r[c] >= 7.5) for c in ml.PLAYER_FEATURES), []).append(round(float(r["rating"]) * 1e6))
        assert got == {k: (len(v), sum(v) / 1e6 / len(v)) for k, v in want.items()} and sum(v[0] for v in got.values()) == n


def test_cuts_are_between_sampled_values():
    """Few values: a cut between any two; many: equal shares; zeros are what the sample lacks."""
    values = np.array([1.0, 1.0, 2.0, 4.0])
    assert ml._scaled_cuts(values, 4.0, 31) == [(1.5, 1.0, 2.0), (3.0, 2.0, 4.0)]
    assert ml._scaled_cuts(values, 6.0, 31) == [(0.5, 0.0, 1.0), (1.5, 1.0, 2.0), (3.0, 2.0, 4.0)]
    assert ml._scaled_cuts(np.zeros(5), 5.0, 31) == [] and ml._scaled_cuts(np.full(5, 2.0), 5.0, 31) == []
    assert [c for c, *_ in ml._scaled_cuts(np.arange(1.0, 101.0), 100.0, 3)] == [25.5, 50.5, 75.5]


def test_counted_fit_refuses_what_the_plain_fit_does(spark, monkeypatch):
    """A feature that is null is an error, as for the trees over the rows; one that never varies is none."""
    rows = _appearances(spark, 400).withColumn("minutes_played", F.lit(90))
    monkeypatch.setattr(ml, "COUNTED_ROWS", 0)
    assert ml.fit_boosted(rows, 400, "rating").transform(rows).filter("prediction BETWEEN 0 AND 12").count() == 400
    with pytest.raises(ValueError, match="null"):
        ml.fit_boosted(rows.withColumn("minutes_played", F.when(F.col("id") != 7, 90)), 400, "rating")


def test_appearances_are_joined_once(spark):
    """The fits and the next-match predictions make their features of one table; the rows are those of the plain plan."""
    from touchline.plans import queries_models as qm
    from touchline.plans.catalog import tables
    rows, models = qm._player_models(spark, SF_SMALL)
    read = "".join(rows.inputFiles())
    assert "player_appearances" in read and "lineitem" not in read and "orders" not in read
    t = tables(spark, SF_SMALL)
    feats = ft.player_features(t.player_match_stats, t.matches, t.opposition_categories, n=10)
    assert rows.columns == feats.columns and rows.exceptAll(feats).count() == 0 and feats.exceptAll(rows).count() == 0
    assert sorted(models) == ["assists", "goals", "rating"]
