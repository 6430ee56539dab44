"""Training, scoring and comparing the purchase and quantity models.

Both models are Spark ML boosted trees on an assembled feature vector.  The
training table is written to the shared folder once, so the many passes of
boosting read files and never recompute the feature joins.
"""

from datetime import datetime, timezone
from functools import partial, reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (SQLTransformer, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from cadenza import constants as C
from cadenza.functions import quantities as qty
from cadenza.operators import boosting, evaluation as ev
from cadenza.operators.ordered import ranked
from cadenza.operators.pair_features import PAIR
from cadenza.operators.sampling import hash_number
from cadenza.session import scratch_path, write_and_read

MIN_POSITIVES = 100


# -- categories --------------------------------------------------------------

def category_encoder(rows: DataFrame):
    """Alphabetical codes of the known categories."""
    return StringIndexer(
        inputCol="categorie", outputCol="categorie_encoded",
        stringOrderType="alphabetAsc", handleInvalid="keep").fit(
        rows.select(F.coalesce("categorie", F.lit(C.UNKNOWN_CATEGORY))
                    .alias("categorie")))


def encode_categories(rows: DataFrame, encoder) -> DataFrame:
    """Codes for ``rows``; a category never seen becomes UNKNOWN.

    UNKNOWN itself may be unseen; it then takes the extra code after the last.
    """
    known = F.col("categorie").isin(*encoder.labels)
    return encoder.transform(rows.withColumn("categorie", F.when(
        known, F.col("categorie")).otherwise(C.UNKNOWN_CATEGORY)))


# -- purchase model ----------------------------------------------------------

def _numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def best_round(losses: list[float], patience: int = C.PATIENCE) -> int:
    """Round (from 1) of the least loss before ``patience`` vain rounds."""
    best, at = float("inf"), 1
    for number, loss in enumerate(losses, 1):
        if loss < best:
            best, at = loss, number
        elif number - at >= patience:
            break
    return at


def fit_rounds(booster, train: DataFrame, losses, patience: int):
    """Fit all rounds once and cut the model after the best one.

    ``losses(model)`` gives the loss of each round.  Returns the model and
    its number of rounds.
    """
    model = booster.fit(train)
    rounds = best_round(losses(model), patience)
    if rounds < model.getNumTrees:
        model = boosting.cut(model, rounds)
    return model, rounds


def train_classifier(dataset: DataFrame, train_cutoff: str,
                     validation_cutoff: str, trees: int = C.TREES,
                     depth: int = C.TREE_DEPTH, seed: int = 42,
                     patience: int = C.PATIENCE,
                     extra_train: DataFrame | None = None,
                     ) -> tuple[PipelineModel, DataFrame]:
    """Fit on the train part, stop early on validation, measure on test.

    The best round is that of the largest area under the precision-recall
    curve of the validation part.  Positives weigh negatives / positives of the train part.  Returns the
    model and one row of metrics.  ``extra_train`` are rows that only ever
    train (answers to proposals, say); its ``weight`` counts a row that many
    times.
    """
    features = C.CLASSIFIER_FEATURES

    def prepared(rows: DataFrame) -> DataFrame:
        if "weight" not in rows.columns:
            rows = rows.withColumn("weight", F.lit(1).cast("long"))
        return _numeric(rows, features).select(
            *features, F.col("target_bought").cast("double").alias("label"),
            "weight", "visit_date", "code_client", "part")

    rows = prepared(ev.temporal_split(dataset, train_cutoff,
                                      validation_cutoff))
    if extra_train is not None:
        rows = rows.unionByName(prepared(
            extra_train.withColumn("part", F.lit("train"))))
    split = write_and_read(rows, "classifier-rows")
    ev.require_parts(split)
    part = F.col("part")
    weights = split.filter(part == "train").agg(
        (F.sum(F.col("weight") * (1 - F.col("label")))
         / F.greatest(F.sum(F.col("weight") * F.col("label")), F.lit(1.0)))
        .alias("w"))
    scale = weights.first()["w"]
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    ready = assembler.transform(split).withColumn(
        "sample_weight", F.col("weight") * F.when(
            F.col("label") == 1, F.lit(scale)).otherwise(1.0))
    booster = GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=C.LEARNING_RATE,
        subsamplingRate=C.ROW_SAMPLING,
        featureSubsetStrategy=C.COLUMN_SAMPLING,
        minInstancesPerNode=C.MIN_ROWS_PER_LEAF, weightCol="sample_weight",
        seed=seed)
    validation = ready.filter(part == "validation")

    def losses(model) -> list[float]:
        curve = boosting.staged_pr_auc(model, validation)
        return [-r["pr_auc"] for r in curve.orderBy("round").collect()]
    model, rounds = fit_rounds(
        booster, ready.filter(part == "train"), losses, patience)
    pipeline = PipelineModel([assembler, model])
    scored = pipeline.transform(split.filter(part == "test"))
    per_part = [f(F.when(part == name, c)).alias(f"{name}_{what}")
                for name in ("train", "validation", "test")
                for what, f, c in (
                    ("rows", F.count, F.lit(1)),
                    ("clients", F.count_distinct, F.col("code_client")),
                    ("positives", F.count_if, F.col("label") == 1))]
    metrics = split.agg(*per_part).withColumns({
        "roc_auc": F.lit(_area(scored, "areaUnderROC")),
        "pr_auc": F.lit(_area(scored, "areaUnderPR")),
        "best_iteration": F.lit(rounds), "rounds_fitted": F.lit(trees),
        "scale_pos_weight": F.lit(scale),
        "n_features": F.lit(len(features))})
    return pipeline, metrics


def classifier_scores(model: PipelineModel, dataset: DataFrame,
                      train_cutoff: str, validation_cutoff: str) -> DataFrame:
    """Test rows as (label, score), for the reports of ``evaluation``."""
    test = ev.temporal_split(dataset, train_cutoff, validation_cutoff).filter(
        F.col("part") == "test")
    return model.transform(_numeric(test, C.CLASSIFIER_FEATURES)).select(
        F.col("target_bought").alias("label"),
        vector_to_array("probability")[1].alias("score"))


def _area(scored: DataFrame, metric: str) -> float:
    return BinaryClassificationEvaluator(
        labelCol="label", metricName=metric).evaluate(scored)


# -- quantity model ----------------------------------------------------------

#: How the target is brought to a scale, and the prediction back to units.
#: Absolute boosting moves by one step a round whatever the target's scale,
#: so it fits the quantity relative to the pair's mean.
SCALES = {
    "plain": (lambda: F.col("target_qty"), "prediction"),
    "log": (lambda: F.log1p("target_qty"), "expm1(prediction)"),
    "relative": (lambda: F.col("target_qty") / F.col("avg_qty"),
                 "prediction * avg_qty"),
}


def train_regressor(dataset: DataFrame, objective: str = "absolute",
                    scale: str | None = None, trees: int = C.TREES,
                    depth: int = C.TREE_DEPTH, seed: int = 42,
                    patience: int = C.PATIENCE,
                    ) -> tuple[PipelineModel, DataFrame]:
    """Fit the quantity on bought rows, split by client.

    ``objective`` is "absolute" or "squared"; ``scale`` is a key of SCALES,
    by default "relative" for absolute and "plain" for squared errors.  A
    relative error weighs its pair's mean, which makes it units again.  The
    fitted pipeline gives the quantity in units as ``quantity``.  The metrics
    row compares it, rounded and as it is, with the mean quantity on the test
    clients.
    """
    features = C.REGRESSOR_FEATURES
    scale = scale or {"absolute": "relative", "squared": "plain"}[objective]
    label, back = SCALES[scale]
    rows = _numeric(dataset.filter(F.col("target_qty") > 0), features)
    weight = F.col("avg_qty") if scale == "relative" else F.lit(1.0)
    rows = rows.select(*features, "target_qty", "code_client").withColumns(
        {"label": label(), "sample_weight": weight})
    split = write_and_read(ev.group_split(rows), "regressor-rows")
    positives = split.count()
    if positives < MIN_POSITIVES:
        raise ValueError(f"{positives} bought rows are too few to train on")
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    ready = assembler.transform(split)
    booster = GBTRegressor(
        lossType=objective, maxIter=trees, maxDepth=depth,
        stepSize=C.LEARNING_RATE, subsamplingRate=C.ROW_SAMPLING,
        featureSubsetStrategy=C.COLUMN_SAMPLING, weightCol="sample_weight",
        minInstancesPerNode=C.MIN_ROWS_PER_LEAF, seed=seed)
    part = F.col("part")
    validation = ready.filter(part == "validation")
    model, rounds = fit_rounds(
        booster, ready.filter(part == "train"),
        lambda model: model.evaluateEachIteration(validation, objective),
        patience)
    pipeline = PipelineModel([assembler, model, SQLTransformer(
        statement=f"SELECT *, {back} AS quantity FROM __THIS__")])
    test = pipeline.transform(split.filter(part == "test")).withColumn(
        "prediction", qty.served_quantity(F.col("quantity"), 0))
    continuous = ev.regression_report(test, guess="quantity").first()
    clients = {r["part"]: r["n"] for r in split.groupBy("part").agg(
        F.count_distinct("code_client").alias("n")).collect()}
    metrics = ev.regression_report(test).withColumns({
        "mae_continuous": F.lit(continuous["mae"]),
        "rmse_continuous": F.lit(continuous["rmse"]),
        "objective": F.lit(objective), "scale": F.lit(scale),
        "best_iteration": F.lit(rounds), "rounds_fitted": F.lit(trees),
        "n_training_positives": F.lit(positives),
        "n_features": F.lit(len(features)),
        "train_clients": F.lit(clients.get("train", 0)),
        "test_clients": F.lit(clients.get("test", 0))})
    return pipeline, metrics


def compare_regressors(dataset: DataFrame, **limits) -> DataFrame:
    """Both objectives and the log target, fitted at the same time."""
    rows = write_and_read(dataset.filter(F.col("target_qty") > 0).select(
        *C.REGRESSOR_FEATURES, "target_qty", "code_client"), "bought-rows")
    reports = [metrics for _, metrics in boosting.side_by_side([
        partial(train_regressor, rows, objective, scale, **limits)
        for objective, scale in (("squared", "plain"),
                                 ("absolute", "relative"),
                                 ("absolute", "log"))])]
    return reduce(DataFrame.unionByName, reports)


# -- use ---------------------------------------------------------------------

def score(snapshots: DataFrame, classifier: PipelineModel,
          regressor: PipelineModel | None) -> DataFrame:
    """Add probability and served quantity to every snapshot."""
    keep = snapshots.columns
    rows = _numeric(snapshots, C.CLASSIFIER_FEATURES)
    rows = classifier.transform(rows).withColumn(
        "probabilite_achat", vector_to_array("probability")[1]).select(
        *keep, "probabilite_achat")
    if regressor is None:
        return rows.withColumn("regressor_qty",
                               F.lit(None).cast("double"))
    sized = regressor.transform(_numeric(rows, C.REGRESSOR_FEATURES))
    return sized.withColumn("regressor_qty", qty.served_quantity(
        F.col("quantity"))).select(
        *keep, "probabilite_achat", "regressor_qty")


def sweep(snapshots: DataFrame, regressor: PipelineModel, column: str,
          values: list[float]) -> DataFrame:
    """Predicted quantity of every row with ``column`` set to each value."""
    rows = _numeric(snapshots, C.REGRESSOR_FEATURES).withColumn(
        column, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    quantity = F.col("quantity")
    return regressor.transform(rows).select(
        *PAIR, F.col(column).alias("tested_value"),
        quantity.alias("prediction"),
        (quantity - F.col("avg_qty")).alias("delta_vs_avg"))


def importances(model: PipelineModel, features: list[str], spark,
                groups: dict[str, list[str]] | None = None,
                near_zero: float = 0.001, alert: float = 0.10) -> DataFrame:
    """Importance per feature (and feature group), flags for noise."""
    trees = next(s for s in model.stages if hasattr(s, "trees"))
    values = dict(zip(features, trees.featureImportances.toArray().tolist()))
    rows = [("feature", n, v, v < near_zero, False)
            for n, v in values.items()]
    for name, members in (groups or {}).items():
        total = float(sum(values.get(m, 0.0) for m in members))
        rows.append(("group", name, total, False, total > alert))
    return spark.createDataFrame(
        rows, "kind string, name string, importance double, "
        "near_zero boolean, above_alert boolean").orderBy(
        F.desc("importance"), "name")


def save(model: PipelineModel, metrics: DataFrame, features: list[str],
         path: str, trained_at: str | None = None, encoder=None) -> None:
    """Model folder, encoder if there is one, and a JSON row of metadata."""
    model.write().overwrite().save(f"{path}/model")
    stages = [] if encoder is None else [encoder]
    PipelineModel(stages).write().overwrite().save(f"{path}/encoder")
    stamp = trained_at or datetime.now(timezone.utc).isoformat()
    (metrics.withColumn("trained_at", F.lit(stamp))
     .withColumn("feature_columns", F.array(*[F.lit(f) for f in features]))
     .coalesce(1).write.mode("overwrite").json(f"{path}/metadata"))


def load(spark, path: str, metrics_schema):
    """(model, metadata, encoder or None) as saved."""
    stages = PipelineModel.load(f"{path}/encoder").stages
    return (PipelineModel.load(f"{path}/model"),
            spark.read.schema(metrics_schema).json(f"{path}/metadata"),
            stages[0] if stages else None)


# -- collaborative score -----------------------------------------------------

def collaborative(pairs: DataFrame, rank: int = 8, iterations: int = 5,
                  model_share: float = 0.6, seed: int = 42) -> DataFrame:
    """0.6 * model probability + 0.4 * implicit-feedback factor score.

    ``pairs`` has code_client, code_article, total_qty, probabilite_achat.
    Factorisation wants integer ids; they come from distributed ranks, not
    from a driver-side label list.
    """
    rows = write_and_read(pairs.select(*PAIR, "total_qty",
                                       "probabilite_achat"), "als-pairs")
    def ids(key, name):
        keys = rows.select(key).distinct().withColumn(
            "_draw", hash_number(key))
        return ranked(keys, "_draw", key, name).select(
            key, F.col(name).cast("int").alias(name))

    numbered = write_and_read(
        rows.join(ids("code_client", "_u"), "code_client")
        .join(ids("code_article", "_i"), "code_article"), "als-numbered")
    model = ALS(rank=rank, maxIter=iterations, implicitPrefs=True, seed=seed,
                userCol="_u", itemCol="_i", ratingCol="total_qty").fit(
        numbered)
    cf = F.least(F.greatest(F.col("prediction").cast("double"), F.lit(0.0)),
                 F.lit(1.0))
    return model.transform(numbered).select(
        *PAIR, "probabilite_achat", cf.alias("cf_score"),
        (F.col("probabilite_achat") * model_share
         + cf * (1 - model_share)).alias("hybrid_score"))


def scratch_model_path(spark) -> str:
    return scratch_path(spark, "model")
