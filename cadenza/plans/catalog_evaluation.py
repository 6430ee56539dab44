"""Queries: splits, weights, quality reports, what-if, drift."""

from pyspark.sql import functions as F

from cadenza import session
from cadenza.functions import quantities as qty
from cadenza.operators import (drift, evaluation as ev, models, profiling,
                               visits)
from cadenza.plans.registry import as_long, query, rounded
from cadenza.session import write_and_read
from cadenza.sources.testbed import TRAIN_CUTOFF, VALIDATION_CUTOFF


def _scores(t):
    """Label and a deterministic score: the closer to due, the higher."""
    rows = visits.timed_targets(t.main_stage())
    score = F.round(1 / (1 + F.col("recency_relative")) + 1e-9, 4)
    return rows.select(F.col("target_bought").alias("label"),
                       score.alias("score"))


def _sized_positives(t):
    """Bought rows with a deterministic quantity prediction, written once:
    several reports read them twice."""
    rows = visits.positives(t.visit_dataset(bought=True))
    blend = F.col("median_qty") * 0.75 + F.col("last_qty") * 0.25
    return write_and_read(rows.withColumn("prediction", qty.served_quantity(
        blend)).select(
        "code_facture", "societe", "code_client", "code_article",
        "visit_date", "target_qty", "prediction", "avg_qty", "std_qty",
        "qty_dispersion", "total_qty"), "sized-positives")


@query
def encode_category(t):
    rows = write_and_read(t.visit_dataset().select("categorie"),
                          "categories")
    encoded = models.encode_categories(rows, models.category_encoder(rows))
    return as_long(encoded.groupBy("categorie", "categorie_encoded").agg(
        F.count("*").alias("n_rows")), "categorie_encoded")


@query
def temporal_split(t):
    return ev.split_sizes(ev.temporal_split(
        t.visit_dataset(), TRAIN_CUTOFF, VALIDATION_CUTOFF))


@query
def group_split(t):
    return ev.split_sizes(ev.group_split(visits.positives(
        t.visit_dataset(bought=True))))


@query
def split_leak_check(t):
    rows = session.write_and_read(visits.targets(t.main_stage()).select(
        "code_client", "visit_date"), "targets")
    by_date = ev.leak_check(ev.temporal_split(
        rows, TRAIN_CUTOFF, VALIDATION_CUTOFF))
    by_client = ev.leak_check(ev.group_split(rows))
    return by_date.withColumn("split", F.lit("temporal")).unionByName(
        by_client.withColumn("split", F.lit("client")))


@query
def class_weight(t):
    split = ev.temporal_split(visits.targets(t.main_stage()), TRAIN_CUTOFF,
                              VALIDATION_CUTOFF)
    return rounded(ev.class_weight(split.filter(F.col("part") == "train")),
                   "scale_pos_weight")


@query
def auc_from_scores(t):
    return rounded(ev.ranking_quality(_scores(t)), "roc_auc", "pr_auc")


@query
def confusion_matrix(t):
    return as_long(ev.confusion(_scores(t)), "label", "predicted")


@query
def classification_report(t):
    return rounded(ev.classification_report(_scores(t)), "precision",
                   "recall", "f1")


@query
def regression_report(t):
    return rounded(ev.regression_report(_sized_positives(t)), "mae", "rmse",
                   "mae_baseline", "rmse_baseline", "improvement_mae_pct",
                   "improvement_rmse_pct")


@query
def error_quantiles(t):
    return rounded(ev.error_quantiles(_sized_positives(t)), "p50", "p90",
                   "p99")


@query
def prediction_distribution(t):
    return rounded(profiling.describe(_sized_positives(t), "prediction"),
                   "mean", "std")


@query
def cv_threshold_eval(t):
    test = ev.group_split(_sized_positives(t)).filter(
        F.col("part") == "test")
    return rounded(ev.threshold_report(test), "mae", "rmse", "gain_pct")


@query
def cv_curve(t):
    """Error of the hybrid at every variation that occurs in the test part."""
    test = ev.group_split(_sized_positives(t)).filter(
        F.col("part") == "test")
    return rounded(ev.threshold_curve(test), "mae", "rmse")


@query
def cv_frontier(t):
    return rounded(ev.frontier_report(_sized_positives(t), 0.5, 0.7),
                   "mae_model", "rmse_model", "mae_history", "rmse_history",
                   "share_pct")


@query
def cv_switches(t):
    return rounded(as_long(ev.switch_report(_sized_positives(t), 0.5, 0.7),
                           "position"), "cv")


@query
def case_rows(t):
    return rounded(ev.case_rows(t.visit_dataset(bought=True)).select(
        "code_client", "code_article", "code_facture", "societe",
        "visit_date", "target_qty", "avg_qty", "median_qty"), "avg_qty")


@query
def winsorise(t):
    full = t.matrix_stage().select(
        "code_client", "code_article", "avg_qty", "max_qty")
    capped = drift.winsorise(drift.winsorise(full, "avg_qty", 0.95),
                             "max_qty", 0.99)
    return rounded(capped, "avg_qty", "avg_qty_capped", "max_qty_capped")


@query
def drift_psi(t):
    main = t.main_stage()
    new = F.col("date_commande") > F.lit(VALIDATION_CUTOFF).cast("date")
    return rounded(drift.stability_index(main, new, {
        "categorie": F.col("categorie"), "code_article": F.col("code_article"),
        "quantite": F.least(F.floor(F.col("quantite") / 10),
                            F.lit(10).cast("long"))}), "psi")
