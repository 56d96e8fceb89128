"""Match-outcome and player-performance models on ``pyspark.ml``.

scikit-learn fits in one process; here the same steps are Spark ML
pipelines fitted on executors.  Numbers cannot equal scikit-learn's (other
tree learners); behaviour and parameters follow the reference: random forest
of 100 trees, depth 10, min leaf 2, seed 42, stratified 80/20 hold-out and
5-fold CV for outcomes; gradient-boosted trees of 50 rounds, depth 4, step
0.1 for player metrics (one pooled model per metric rather than 45 tiny
per-player fits).
"""

from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer, IndexToString, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.features import MATCH_FEATURES, PLAYER_FEATURES
from touchline.operators.sequence import ordered_prefix
from touchline.plans.boosting import UNITS
from touchline.session import ensure_checkpoint_dir, scratch_dir

PLAYER_METRICS = ("rating", "goals", "assists")
MIN_MATCH_ROWS = 20
MIN_PLAYER_ROWS = 10

# Rows of one task of a fit.  A forest has hundreds of trees to try on each of its rows.
LEAST_TASKS, FOREST_ROWS, BOOSTING_ROWS = 8, 20_000, 100_000

# A boosted fit of more rows than its least tasks hold reads their counts (``fit_boosted``).
COUNTED_ROWS = LEAST_TASKS * BOOSTING_ROWS


# Modulus and multiplier of the split hash (2**31 - 1 and a primitive root of it).
HASH_MODULUS, HASH_FACTOR = 2147483647, 48271


def id_hash(id_cols, seed: int = 42):
    """A seeded hash of integer ids, 0 to 2**31 - 2, in integer arithmetic
    that any SQL engine repeats."""
    h = F.lit(seed).cast("long")
    for c in id_cols:
        h = F.pmod(F.pmod((h + F.pmod(F.col(c), F.lit(HASH_MODULUS))) * HASH_FACTOR, F.lit(HASH_MODULUS))
                   * HASH_FACTOR, F.lit(HASH_MODULUS))
    return h


def stratified_split(df: DataFrame, label: str, id_cols, *, test_size: float = 0.2, seed: int = 42,
                     folds: int = 5) -> DataFrame:
    """M2 + M6: add ``is_test`` (exactly ``round(test_size * n_class)`` rows
    of each class, chosen by ``id_hash``) and a stratified ``fold``
    (0..folds-1) for the training rows.  The per-class numbering uses the
    chunked sequence operator, so no class is gathered into one task."""
    d = df.withColumn("_h", id_hash(id_cols, seed))
    p = ordered_prefix(d, [label], ["_h", *id_cols], chunk=F.shiftright("_h", 20))
    cut = F.round(F.col("n_key") * F.lit(test_size))
    out = p.withColumn("is_test", F.col("seq") <= cut)
    out = out.withColumn("fold", F.when(~F.col("is_test"),
                                        F.pmod(F.col("seq") - cut - 1, F.lit(folds)).cast("int")))
    return out.drop("_h", "seq", "n_key")


def deterministic_order(df: DataFrame, keys, *, rows: int, rows_per_task: int) -> DataFrame:
    """Fix partition contents and row order (hash partitioning + sort within
    partitions): tree learners sample per partition, and shuffle fetch order
    is not stable, so without this a fixed seed would not give a fixed
    model.  The number of partitions follows the rows and not the session: a
    fit is some hundred short jobs, each with a task for every partition."""
    return df.repartition(max(LEAST_TASKS, -(-rows // rows_per_task)), *keys).sortWithinPartitions(*keys)


def at_once(spark, jobs) -> list:
    """Results of independent Spark actions submitted together, so that short
    ones overlap on the cluster."""
    jobs = [inheritable_thread_target(spark)(job) for job in jobs]
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


class _ForestModel(RandomForestClassificationModel):
    """A forest whose trees become Python objects when they are asked for.  As the cached property of the parent they
    are all made, by some ten thousand calls to the JVM, whenever pyspark lists the params of a model."""
    trees = property(RandomForestClassificationModel.trees.func)


class _Forest(RandomForestClassifier):
    def _create_model(self, java_model):
        return _ForestModel(java_model)


def match_pipeline(features=MATCH_FEATURES, *, seed: int = 42, labels=None) -> Pipeline:
    """M3 + M4: label index, assembler, scaler, random forest, label decode.
    With ``labels``, the outcomes of the training rows if they are known, the
    index is not fitted."""
    how = dict(inputCol="outcome", outputCol="label", handleInvalid="error")    # "keep" would add a class that does not exist
    idx = StringIndexer(stringOrderType="alphabetAsc", **how) if labels is None \
        else StringIndexerModel.from_labels(sorted(labels), **how)
    vec = VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep")
    scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    rf = _Forest(numTrees=100, maxDepth=10, minInstancesPerNode=2, seed=seed,
                 labelCol="label", featuresCol="features")
    return Pipeline(stages=[idx, vec, scale, rf])


@dataclass
class MatchModel:
    model: PipelineModel
    metrics: DataFrame
    class_report: DataFrame
    importances: DataFrame
    labels: list = field(default_factory=list)


def _small(spark, rows: list, schema: str) -> DataFrame:
    """A few rows that are known, held in the plan: no Python worker starts for them."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(pa.table({c: list(v) for c, v in zip(names, zip(*rows))}), schema)


def _class_report(labels, counts: dict) -> list[tuple]:
    """Precision, recall, F1 and support of every class from the counts of (outcome, predicted)."""
    out = []
    for c in labels:
        hit = counts.get((c, c), 0)
        support = sum(n for (outcome, _), n in counts.items() if outcome == c)
        predicted = sum(n for (_, p), n in counts.items() if p == c)
        precision, recall = hit / predicted if predicted else 0.0, hit / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0
        out.append((c, precision, recall, f1, support))
    return out


def _confusion(model: PipelineModel, rows: DataFrame) -> dict:
    """Rows by (outcome, predicted), at most one for each pair of classes.  The forest's other outputs are left
    out: each of them would send all its trees along once more."""
    labels = list(model.stages[0].labels)
    plain = PipelineModel([*model.stages[:-1], model.stages[-1].copy().setRawPredictionCol("").setProbabilityCol("")])
    found = plain.transform(rows).groupBy("outcome", "label", "prediction").count().collect()     # "label": an unknown outcome is an error
    return {(r["outcome"], labels[int(r["prediction"])]): r["count"] for r in found}


def _accuracy(counts: dict) -> float:
    return float(sum(n for (outcome, predicted), n in counts.items() if outcome == predicted)) / sum(counts.values()) if counts else float("nan")


def train_match_model(features: DataFrame, *, test_size: float = 0.2, seed: int = 42,
                      folds: int = 5) -> MatchModel:
    """M2-M7: stratified hold-out, fit, accuracy, per-class report, k-fold
    CV mean/std on the training part and feature importances."""
    spark = features.sparkSession
    # Features and split are written to the shared folder: a plan over cached rows holds all that led to them, and
    # Spark describes the whole plan anew for each of some hundred jobs.
    ensure_checkpoint_dir(spark)
    features = features.checkpoint()
    found = stratified_split(features, "outcome", ["match_id"], test_size=test_size, seed=seed, folds=folds).cache()
    sizes = {(r["is_test"], r["fold"], r["outcome"]): r["n"]
             for r in found.groupBy("is_test", "fold", "outcome").agg(F.count("*").alias("n")).collect()}
    n, n_test = sum(sizes.values()), sum(v for (is_test, *_), v in sizes.items() if is_test)
    outcomes = {k: {o for (is_test, fold, o) in sizes if not is_test and fold == k} for k in range(folds)}
    if n < MIN_MATCH_ROWS or not all(outcomes.values()):
        found.unpersist()
        raise ValueError(f"insufficient training data: {n} rows (< {MIN_MATCH_ROWS})" if n < MIN_MATCH_ROWS
                         else f"a fold of {folds} has no rows")
    split = deterministic_order(found, ["match_id"], rows=n, rows_per_task=FOREST_ROWS).checkpoint()
    found.unpersist()
    train = split.filter(~F.col("is_test"))
    test = split.filter(F.col("is_test"))

    def fit(rows: DataFrame, of_folds) -> PipelineModel:
        labels = set().union(*[outcomes[k] for k in of_folds]) - {None}
        return match_pipeline(seed=seed, labels=labels).fit(rows)

    def fold_accuracy(k: int) -> float:
        """M6: CV over the stratified fold column of the training rows."""
        model = fit(train.filter(F.col("fold") != k), set(range(folds)) - {k})
        return _accuracy(_confusion(model, train.filter(F.col("fold") == k)))

    # The model and the folds are independent fits.
    model, *cv = at_once(spark, [lambda: fit(train, range(folds)), *[lambda k=k: fold_accuracy(k) for k in range(folds)]])
    counts = _confusion(model, test)
    labels = list(model.stages[0].labels)
    metrics = _small(
        spark, [(_accuracy(counts), float(np.mean(cv)), float(np.std(cv)), int(n - n_test), int(n_test))],
        "accuracy double, cv_mean double, cv_std double, training_samples long, test_samples long")

    # M5: per-class precision / recall / F1 / support from the confusion counts
    report = _class_report(labels, counts)
    rep = _small(spark, report, "outcome string, precision double, recall double, f1 double, support long")

    # M7: importances keyed by feature name (model metadata, 8 values).
    imp = model.stages[-1].featureImportances.toArray().tolist()
    importances = _small(spark, list(zip(MATCH_FEATURES, map(float, imp))), "feature string, importance double")
    return MatchModel(model, metrics, rep, importances, labels)


def predict_matches(model: PipelineModel, fixture_features: DataFrame) -> DataFrame:
    """M9 + M10: predicted outcome, class probabilities and confidence for
    every fixture row in one ``transform``."""
    labels = list(model.stages[0].labels)
    out = model.transform(fixture_features.withColumn("outcome", F.lit(labels[0])))
    probs = vector_to_array("probability")
    cols = {f"prob_{lab.lower().replace(' ', '_')}": probs[i] for i, lab in enumerate(labels)}
    decode = IndexToString(inputCol="prediction", outputCol="predicted_outcome", labels=labels)
    out = decode.transform(out).withColumns(cols).withColumn("confidence", F.array_max(probs))
    keep = [c for c in fixture_features.columns if c not in MATCH_FEATURES]
    return out.select(*keep, "predicted_outcome", *cols, "confidence")


def save_model(model: PipelineModel, path: str) -> None:
    """Persist the fitted pipeline (indexer, assembler, scaler, model:
    the feature list travels with the assembler)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load a pipeline saved with ``save_model``."""
    return PipelineModel.load(path)


# ------------------------------------------------------------- players
def hash_split(df: DataFrame, id_cols, *, test_size: float, seed: int = 42) -> DataFrame:
    """Seeded hash split (M12's 70/30): deterministic whatever the partitioning."""
    return df.withColumn("is_test", F.pmod(id_hash(id_cols, seed), F.lit(10_000)) < F.lit(int(test_size * 10_000)))


def player_pipeline(metric: str, *, seed: int = 42) -> Pipeline:
    vec = VectorAssembler(inputCols=list(PLAYER_FEATURES), outputCol="raw_features",
                          handleInvalid="keep")
    scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    gbt = GBTRegressor(maxIter=50, maxDepth=4, stepSize=0.1, seed=seed, labelCol=metric,
                       featuresCol="features")
    return Pipeline(stages=[vec, scale, gbt])


@dataclass
class PlayerModel:
    metric: str
    model: PipelineModel
    metrics: DataFrame
    sample: DataFrame


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table of the shared folder, for what reads them more than once."""
    path = scratch_dir(rows.sparkSession, f"{name}/{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def player_split(features: DataFrame, *, seed: int = 42, test_size: float = 0.3) -> DataFrame:
    """Feature rows with M12's ``is_test`` in the fixed order of the fits,
    cached: the rows of every metric are a filter of these."""
    found = hash_split(features, ["player_id", "match_id"], test_size=test_size, seed=seed).cache()
    rows = deterministic_order(found, ["player_id", "match_id"], rows=found.count(), rows_per_task=BOOSTING_ROWS).cache()
    rows.count()
    found.unpersist()
    return rows


def _sampled(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """The rows in which an MLlib tree learner of this seed looks for its cuts (all, or some ten thousand)."""
    if fraction >= 1:
        return rows
    spark = rows.sparkSession
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    taken = rows._jdf.toJavaRDD().sample(False, fraction, draw)
    return DataFrame(spark._jsparkSession.createDataFrame(taken, rows._jdf.schema()), spark)


def _scaled_cuts(values: np.ndarray, expected: float, most: int) -> list[tuple[float, float, float]]:
    """MLlib's candidate cuts of one feature from its sampled values: (cut, value below, value above).  Zeros are what
    the sample lacks of the rows ``expected`` in it."""
    found, counts = np.unique(values[values != 0], return_counts=True)
    weight = dict(zip(found.tolist(), counts.astype(float).tolist()))
    n = float(counts.sum())
    if weight and expected - n > np.finfo(float).eps * n * 100:
        weight[0.0] = expected - n
    at = sorted(weight)
    between = [((a + b) / 2.0, a, b) for a, b in zip(at, at[1:])]
    if len(between) <= most:
        return between
    stride, seen, cuts = expected / (most + 1), weight[at[0]], []
    target = stride
    for cut in between:
        before, seen = seen, seen + weight[cut[2]]
        if abs(before - target) < abs(seen - target):
            cuts.append(cut)
            target += stride
    return cuts


def _least_above(cut: float, low: float, high: float, scaled) -> float:
    """The least value between ``low`` and ``high`` that is scaled to more than ``cut``."""
    while low < (mid := low + (high - low) / 2) < high:
        low, high = (mid, high) if scaled(mid) <= cut else (low, mid)
    return high


def feature_bins(train: DataFrame, n: int, scaler, gbt: GBTRegressor) -> Bucketizer:
    """The bins of ``gbt``'s candidate cuts, on the features before they are scaled (``n``: rows of ``train``).  MLlib
    bins every feature of the scaled rows by at most 31 cuts before the first tree and looks for no others."""
    mean = scaler.mean.toArray()
    scale = np.array([1.0 / v if v != 0 else 0.0 for v in scaler.std.toArray().tolist()])
    if not (np.isfinite(mean).all() and np.isfinite(scale).all()):
        raise ValueError("a feature of the training rows is null, NaN or infinite")
    fraction = min(1.0, max(gbt.getMaxBins() ** 2, 10_000) / n)
    sample = _sampled(train.select(*[F.col(c).cast("double").alias(c) for c in PLAYER_FEATURES]), fraction, gbt.getSeed())
    raw = np.array([tuple(r) for r in sample.collect()]).reshape(-1, len(PLAYER_FEATURES))
    splits = []
    for i in range(len(PLAYER_FEATURES)):
        def scaled(x, i=i):
            return (x - mean[i]) * scale[i]

        # of values that are scaled alike the greatest below a cut and the least above it are as good as any
        of = dict(zip(scaled(raw[:, i]).tolist(), raw[:, i].tolist())) | {0.0: float(mean[i])}
        cuts = _scaled_cuts(scaled(raw[:, i]), fraction * n, min(gbt.getMaxBins(), n) - 1)
        above = [_least_above(t, of[a], of[b], scaled) for t, a, b in cuts] or [np.finfo(float).max]
        splits.append([-math.inf, *above, math.inf])
    return Bucketizer(inputCols=list(PLAYER_FEATURES), outputCols=[f"{c}_bin" for c in PLAYER_FEATURES], splitsArray=splits,
                      handleInvalid="keep")


# More than the bins of any feature, so that the bins of a row are the digits of one integer.
BIN_BASE = 64


def binned_counts(train: DataFrame, metric: str, bins: Bucketizer) -> DataFrame:
    """The different rows of bins, with their number of ``train``'s rows (``samples``) and the mean of their metric.
    Metrics are summed as integers of 1e-6 of their unit, exactly and in any order."""
    cols = bins.getOutputCols()
    place = [BIN_BASE ** i for i in range(len(cols))]
    code = sum((F.col(c).cast("long") * p for c, p in zip(cols, place)), F.lit(0).cast("long"))
    of_code = bins.transform(train).groupBy(code.alias("code")).agg(
        F.count("*").alias("samples"), F.sum(F.round(F.col(metric) * UNITS).cast("long")).alias("units"))
    return of_code.select(
        "code", F.col("samples").cast("double").alias("samples"), (F.col("units") / UNITS / F.col("samples")).alias(metric),
        *[F.pmod(F.floor(F.col("code") / F.lit(p)), F.lit(BIN_BASE)).cast("double").alias(c) for c, p in zip(cols, place)])


def fit_boosted(train: DataFrame, n: int, metric: str, *, seed: int = 42) -> PipelineModel:
    """``player_pipeline`` fitted to ``n`` rows, many of them over their counts.  The trees see of a row nothing but its
    bins, so rows of the same bins share every prediction, and the sums behind a cut and a leaf are those of the rows'
    number and mean.  The fit, some hundred passes, then reads each row of bins once with its number as weight.  Cuts
    of equal gain are told apart by the last bits of sums, here as there."""
    if n <= COUNTED_ROWS:
        return player_pipeline(metric, seed=seed).fit(train)
    vec, scale, gbt = player_pipeline(metric, seed=seed).getStages()
    scaler = scale.fit(vec.transform(train))
    bins = feature_bins(train, n, scaler, gbt)
    ensure_checkpoint_dir(train.sparkSession)
    counted = binned_counts(train, metric, bins).checkpoint()
    k = counted.count()
    row = VectorAssembler(inputCols=bins.getOutputCols(), outputCol="bins", handleInvalid="keep")
    # with so many bins allowed, MLlib reads all different rows of bins and no sample of them for its cuts: one between any two bins
    trees = gbt.copy({gbt.featuresCol: "bins", gbt.weightCol: "samples", gbt.maxBins: max(BIN_BASE, math.isqrt(k) + 1)})
    fitted = trees.fit(row.transform(deterministic_order(counted, ["code"], rows=k, rows_per_task=BOOSTING_ROWS)))
    return PipelineModel([vec, scaler, bins, row, fitted])


def train_player_model(features: DataFrame, metric: str = "rating", *, seed: int = 42,
                       test_size: float = 0.3) -> PlayerModel:
    """M12 + M13: one pooled gradient-boosted model per metric over all
    players' rows (player history is in the features); rows with a NULL
    target are dropped (D10).  MSE / RMSE on the hold-out and a sample of
    actual vs predicted values."""
    return train_player_models(features, (metric,), seed=seed, test_size=test_size)[metric]


def _fit_player_model(split: DataFrame, metric: str, seed: int) -> PlayerModel:
    spark = split.sparkSession
    rows = split.filter(F.col(metric).isNotNull()).withColumn(metric, F.col(metric).cast("double"))
    sizes = {r["is_test"]: r["n"] for r in rows.groupBy("is_test").agg(F.count("*").alias("n")).collect()}
    n, n_train = sum(sizes.values()), sizes.get(False, 0)
    if n < MIN_PLAYER_ROWS:
        raise ValueError(f"insufficient data for player model: {n} rows")
    train, test = rows.filter(~F.col("is_test")), rows.filter(F.col("is_test"))
    model = fit_boosted(train, n_train, metric, seed=seed)
    pred = model.transform(test)
    ev = RegressionEvaluator(labelCol=metric, predictionCol="prediction")
    mse = ev.evaluate(pred, {ev.metricName: "mse"})
    metrics = spark.createDataFrame([(metric, float(mse), float(mse) ** 0.5, int(n_train))],
                                    "metric string, mse double, rmse double, training_samples long")
    first = test.select("player_id", "match_id", *dict.fromkeys([*PLAYER_FEATURES, metric])) \
        .orderBy("player_id", "match_id").limit(5)
    first = spark.createDataFrame(first.collect(), first.schema)       # five rows, read while the rows are still held
    sample = model.transform(first).select(F.lit(metric).alias("metric"), "player_id", "match_id",
                                           F.col(metric).alias("actual"), "prediction")
    sample = spark.createDataFrame(sample.collect(),
                                   "metric string, player_id long, match_id long, actual double, prediction double")
    return PlayerModel(metric, model, metrics, sample)


def train_per_player(features: DataFrame, metric: str = "rating", *, ridge: float = 1.0,
                     min_rows: int = MIN_PLAYER_ROWS) -> DataFrame:
    """M12 with one model per player (``pooled=False``): a ridge regression of
    the metric on the player features for every player with at least
    ``min_rows`` rows.

    The sums of products of a player's rows are all that a linear fit needs;
    they are plain aggregates (combined map-side, so a player may have any
    number of rows), and each task then solves the small systems of its
    players.  Columns: player_id, metric, training_samples, coefficients
    (intercept first), mse, rmse (on the rows fitted, as with few rows there
    is no hold-out)."""
    import pandas as pd
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in PLAYER_FEATURES]]
    y, k = F.col(metric).cast("double"), len(x)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = (features.filter(F.col(metric).isNotNull()).groupBy("player_id").agg(
        F.count("*").alias("n"), F.sum(y * y).alias("yy"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in upper]).alias("xx"), F.array(*[F.sum(c * y) for c in x]).alias("xy"))
        .filter(F.col("n") >= min_rows))

    def solve(batches):
        for b in batches:
            gram = np.zeros((len(b), k, k))
            for at, (i, j) in enumerate(upper):
                gram[:, i, j] = gram[:, j, i] = [v[at] for v in b["xx"]]
            xy = np.array(b["xy"].tolist()).reshape(len(b), k)
            weight = np.linalg.solve(gram + ridge * np.eye(k), xy[:, :, None])[:, :, 0] if len(b) else xy
            error = b["yy"] - 2 * (weight * xy).sum(1) + np.einsum("ni,nij,nj->n", weight, gram, weight)
            yield pd.DataFrame({"player_id": b["player_id"], "metric": metric, "training_samples": b["n"],
                                "coefficients": list(weight), "mse": np.maximum(error / b["n"], 0.0)})

    fitted = sums.mapInPandas(solve, "player_id long, metric string, training_samples long, coefficients array<double>, mse double")
    return fitted.withColumn("rmse", F.sqrt("mse"))


def predict_per_player(models: DataFrame, rows: DataFrame) -> DataFrame:
    """Predictions of ``train_per_player`` models for feature rows of their players."""
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in PLAYER_FEATURES])
    dot = F.aggregate(F.zip_with("coefficients", x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(models.select("player_id", "metric", "coefficients"), "player_id").withColumn("prediction", dot).drop("coefficients")


def latest_player_state(features: DataFrame) -> DataFrame:
    """Each player's most recent feature row (by date, then match id)."""
    latest = features.groupBy("player_id").agg(
        F.max_by(F.struct(*[c for c in features.columns if c != "player_id"]),
                 F.struct("match_date", "match_id")).alias("r"))
    return latest.select("player_id", "r.*")


def predict_players(model: PlayerModel, features: DataFrame, scenario: DataFrame | None = None,
                    *, opposition_strength: int = 1, is_home: int = 1, minutes: int = 90) -> DataFrame:
    """Next-match prediction from each player's latest rolling means and
    a scenario (opposition ordinal, venue, 90 minutes)."""
    return predict_player_models([model], features, scenario, opposition_strength=opposition_strength,
                                 is_home=is_home, minutes=minutes)


def predict_player_models(models, features: DataFrame, scenario: DataFrame | None = None,
                          *, opposition_strength: int = 1, is_home: int = 1, minutes: int = 90) -> DataFrame:
    """``predict_players`` of several models: each player's latest state is
    found once, whatever the number of models."""
    latest = latest_player_state(features)
    if scenario is not None:
        latest = latest.drop("opposition_strength", "is_home", "minutes_played").join(scenario, "player_id")
    else:
        latest = latest.withColumns({"opposition_strength": F.lit(opposition_strength),
                                     "is_home": F.lit(is_home), "minutes_played": F.lit(minutes).cast("long")})
    out, models = latest, list(models)
    for i, m in enumerate(models):
        out = m.model.transform(out).select(*out.columns, F.col("prediction").alias(f"_prediction_{i}"))
    return out.select("player_id", "opposition_strength", "is_home", F.inline(F.array(*[
        F.struct(F.lit(m.metric).alias("metric"), F.col(f"_prediction_{i}").alias("predicted_value"),
                 F.col(f"recent_avg_{m.metric}").alias("recent_average")) for i, m in enumerate(models)]))) \
        .select("player_id", "metric", "predicted_value", "recent_average", "opposition_strength", "is_home")


def train_all(match_features: DataFrame, player_features: DataFrame, key_players: DataFrame,
              *, seed: int = 42) -> dict:
    """The match model plus one pooled model per player metric, trained
    on the key players' rows (A22)."""
    out = {"match_prediction": train_match_model(match_features, seed=seed)}
    rows = player_features.join(key_players.select("player_id").distinct(), "player_id", "left_semi")
    out["player_models"] = train_player_models(rows, seed=seed)
    return out


def train_player_models(rows: DataFrame, metrics=PLAYER_METRICS, *, seed: int = 42, test_size: float = 0.3) -> dict:
    """One pooled model per metric; the fits are independent Spark jobs over
    the same rows and are submitted together so small fits overlap on the
    cluster."""
    rows = rows.select("player_id", "match_id", *dict.fromkeys([*PLAYER_FEATURES, *metrics]))
    split = player_split(rows, seed=seed, test_size=test_size)
    try:
        return dict(zip(metrics, at_once(split.sparkSession, [lambda m=m: _fit_player_model(split, m, seed) for m in metrics])))
    finally:
        split.unpersist()
