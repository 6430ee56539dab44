"""Queries: model training, scoring and comparison.

A job trains once and uses its models many times: each folder's models are
fitted on the first query that needs them, at the job's default settings, and
kept for the session.  Scores and metrics are floating results of boosting,
so the queries return what another engine can recompute -- sizes of the
parts, keys, weights -- and statements checked on the real fit.  Whether a
visit buys is a coin flip in the test tables, so no statement asks the
classifier to beat chance; the regressor has to beat its baseline.
"""

from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.operators import (evaluation as ev, feedback as fb, models as m,
                               new_products, proposals as pr, ranking, visits)
from cadenza.plans.registry import as_long, query, rounded
from cadenza.session import write_and_read
from cadenza.sources import testbed
from cadenza.sources.testbed import TRAIN_CUTOFF, VALIDATION_CUTOFF

CUTS = {"train_cutoff": TRAIN_CUTOFF, "validation_cutoff": VALIDATION_CUTOFF}
_FITTED: dict[tuple, tuple] = {}


def _fitted(t, name, fit):
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def classifier(t):
    return _fitted(t, "classifier", lambda: m.train_classifier(
        t.dataset_stage(), **CUTS))


def regressor(t):
    return _fitted(t, "regressor", lambda: m.train_regressor(
        t.bought_rows()))


def _checked(metrics):
    return metrics.withColumn(
        "more_than_one_tree", F.col("best_iteration") > 1)


PART_COUNTS = [f"{part}_{what}" for part in ("train", "validation", "test")
               for what in ("rows", "clients", "positives")]


@query
def train_classifier(t):
    row = classifier(t)[1].withColumn(
        "areas_in_range", F.col("roc_auc").between(0, 1)
        & F.col("pr_auc").between(0, 1))
    return as_long(rounded(row, "scale_pos_weight"), "n_features",
                   "rounds_fitted").select(
        *PART_COUNTS, "scale_pos_weight", "n_features", "areas_in_range",
        "rounds_fitted")


@query
def train_regressor(t):
    row = _checked(regressor(t)[1]).withColumn(
        "beats_baseline", F.col("mae") <= F.col("mae_baseline"))
    return as_long(rounded(row, "mae_baseline", "rmse_baseline"),
                   "n_training_positives", "train_clients", "test_clients",
                   "n_features").select(
        "n_rows", "mae_baseline", "rmse_baseline", "objective", "scale",
        "n_training_positives", "train_clients", "test_clients",
        "n_features", "beats_baseline", "more_than_one_tree")


@query
def ab_report(t):
    """Squared, absolute and log errors side by side."""
    report = _fitted(t, "ab", lambda: m.compare_regressors(
        t.bought_rows()))
    return as_long(rounded(_checked(report), "mae_baseline"),
                   "n_training_positives").select(
        "objective", "scale", "n_rows", "mae_baseline",
        "n_training_positives", "more_than_one_tree")


@query
def classifier_confusion(t):
    """Test rows of the fitted classifier by label, over both predictions."""
    scores = m.classifier_scores(classifier(t)[0], t.dataset_stage(), **CUTS)
    return ev.confusion(scores).groupBy("label").agg(
        F.sum("n").alias("n"))


@query
def feature_importance(t):
    """Importances of both models: names, range and total."""
    out = None
    for name, (model, _), features, groups in (
            ("classifier", classifier(t), C.CLASSIFIER_FEATURES,
             {"history": ["frequency", "total_qty"],
              "season": ["best_month", "avg_seasonal_coef"]}),
            ("regressor", regressor(t), C.REGRESSOR_FEATURES, {})):
        table = m.importances(model, features, t.spark, groups)
        total = table.filter(F.col("kind") == "feature").agg(
            F.abs(F.sum("importance") - 1) < 1e-6).scalar()
        table = table.select(
            F.lit(name).alias("model"), "kind", "name",
            F.col("importance").between(0, 1).alias("in_range"),
            total.alias("adds_up"))
        out = table if out is None else out.unionByName(table)
    return out


@query
def model_metadata(t):
    """Save a model with encoder and metadata and read all back."""
    model, metrics = regressor(t)
    path = m.scratch_model_path(t.spark)
    # the columns read here, of all rows of the training set
    rows = write_and_read(t.visit_dataset().select(
        "categorie", *C.REGRESSOR_FEATURES), "model-rows")
    encoder = m.category_encoder(rows)
    m.save(model, metrics, C.REGRESSOR_FEATURES, path, encoder=encoder)
    schema = (metrics.withColumn("trained_at", F.lit(""))
              .withColumn("feature_columns", F.array(F.lit(""))).schema)
    loaded, metadata, codes = m.load(t.spark, path, schema)
    features = m._numeric(rows.select(*C.REGRESSOR_FEATURES),
                          C.REGRESSOR_FEATURES)
    ours = model.transform(features).select(
        *C.REGRESSOR_FEATURES, F.col("quantity").alias("_ours"))
    differing = loaded.transform(ours).filter(
        ~F.col("quantity").eqNullSafe(F.col("_ours"))).count()
    return as_long(metadata, "n_training_positives", "train_clients",
                   "test_clients").select(
        "objective", "scale", "n_training_positives", "train_clients",
        "test_clients", F.size("feature_columns").cast("long")
        .alias("n_feature_columns"),
        F.lit(len(loaded.stages)).cast("long").alias("n_stages"),
        F.array_join(F.array(*[F.lit(c) for c in codes.labels]), ",")
        .alias("categories"), (F.col("trained_at") != "").alias("stamped"),
        F.lit(differing == 0).alias("same_model"))


@query
def score_all(t):
    """Latest snapshots scored by both trained models."""
    return m.score(ranking.latest_snapshot(t.dataset_stage()),
                   classifier(t)[0], regressor(t)[0]).select(
        "code_client", "code_article", "visit_date",
        F.col("probabilite_achat").between(0, 1).alias("is_probability"),
        ((F.col("regressor_qty") >= 1)
         & (F.col("regressor_qty") == F.floor("regressor_qty")))
        .alias("is_quantity"))


@query
def model_proposals(t):
    """From the main table to proposals by the trained models."""
    scored = pr.score_latest(t.main_stage(), t.dataset_stage(),
                             classifier(t)[0], regressor(t)[0],
                             testbed.REFERENCE_DATE)
    rows = pr.suggestions(scored)
    return rows.groupBy("code_client").agg(
        (F.max("rang") <= C.URGENT_CAP + C.RECOMMENDED_CAP).alias("capped"),
        (F.max("rang") == F.count("*")).alias("ranks_are_gapless"),
        F.bool_and(F.col("quantite_suggeree") >= 1).alias("sized"),
        F.bool_and(F.col("score_confiance").between(0, 1)).alias("scored"),
        F.bool_and(F.length("explication") > 0).alias("explained"),
    ).agg(*[F.bool_and(c).alias(c) for c in (
        "capped", "ranks_are_gapless", "sized", "scored", "explained")])


@query
def served_proposals(t):
    """Every suggestion of the trained models, row by row."""
    scored = pr.score_latest(t.main_stage(), t.dataset_stage(),
                             classifier(t)[0], regressor(t)[0],
                             testbed.REFERENCE_DATE)
    return pr.suggestions(scored)


@query
def what_if_sweep(t):
    """Predicted quantity while the last quantity varies."""
    swept = m.sweep(t.latest_dataset(), regressor(t)[0], "last_qty",
                    [9, 50, 100, 146, 200, 300, 500])
    return swept.select(
        "code_client", "code_article", "tested_value",
        F.col("prediction").isNotNull().alias("is_predicted"))


@query
def cf_hybrid(t):
    rows = m.collaborative(t.scored()).select(
        "code_client", "code_article", "probabilite_achat",
        F.col("cf_score").between(0, 1).alias("cf_in_range"),
        (F.abs(F.col("hybrid_score") - F.col("probabilite_achat") * 0.6
               - F.col("cf_score") * 0.4) < 1e-9).alias("is_blend"))
    return rounded(rows, "probabilite_achat")


@query
def cf_new_products(t):
    """Each client's five best products that it has never ordered.

    Every client has ordered some and lacks some of the 28 products, so it
    gets as many as it lacks, five at most.
    """
    found = new_products.suggest(t.scored(), k=5)
    ordered = t.scored().select("code_client", "code_article")
    return found.join(ordered.withColumn("_o", F.lit(True)),
                      ["code_client", "code_article"], "left").groupBy(
        "code_client").agg(
        F.count("*").alias("n_products"),
        (F.max("rank") == F.count("*")).alias("ranks_are_gapless"),
        F.bool_and(F.col("_o").isNull()).alias("never_ordered"),
        F.bool_and(F.abs(F.col("hybrid_score") - F.col("cf_score") * 0.4)
                   < 1e-12).alias("is_blend"))


@query
def retrain(t):
    """Purchase model on order history plus feedback answers."""
    answers = fb.flatten(testbed.raw_feedback(t.spark, t.sf_dir))
    states = visits.order_states(t.main_stage())

    def fit():
        extra = fb.training_rows(answers, states)
        return m.train_classifier(t.dataset_stage(), **CUTS,
                                  extra_train=extra)
    row = _fitted(t, "retrained", fit)[1]
    return as_long(row, "rounds_fitted").select(
        "train_rows", "validation_rows", "test_rows", "train_positives",
        "test_positives", "rounds_fitted")
