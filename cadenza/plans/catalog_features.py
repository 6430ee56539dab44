"""Queries: pair, client and product features, feature matrix, visits."""

from pyspark.sql import functions as F

from cadenza.functions import calendar as cal
from cadenza.operators import (entity_features, increments, pair_features,
                               sampling, visits as v)
from cadenza.plans.registry import as_long, query, rounded
from cadenza.session import write_and_read
from cadenza.sources import testbed
from cadenza.sources.testbed import REFERENCE_DATE


@query
def pair_qty_stats(t):
    return rounded(pair_features.quantity_stats(t.main()), "avg_qty")


@query
def pair_std_both(t):
    return rounded(pair_features.both_deviations(t.main()),
                   "std_qty_matrix", "std_qty_visit")


@query
def pair_last_qty(t):
    return pair_features.last_quantity(t.main())


@query
def pair_recency(t):
    return as_long(pair_features.recency(t.main(), REFERENCE_DATE),
                   "recency_days")


@query
def order_gaps(t):
    return as_long(pair_features.gaps(t.main()), "date_diff")


@query
def line_gaps(t):
    return as_long(pair_features.line_gaps(t.main_stage()), "gap_days")


@query
def pair_cadence(t):
    return rounded(as_long(
        pair_features.cadence(t.main(), REFERENCE_DATE), "recency_days"),
        "avg_delay_days", "avg_delay_days_visit", "recency_relative",
        "recency_relative_visit")


@query
def pair_trend(t):
    return rounded(pair_features.trends(t.main()), "trend")


@query
def pair_company(t):
    return as_long(pair_features.first_company(t.main()), "company_encoded")


@query
def pair_season(t):
    return rounded(pair_features.season(t.main(), REFERENCE_DATE),
                   "avg_seasonal_coef_matrix", "avg_seasonal_coef_visit")


@query
def pair_best_month(t):
    return as_long(pair_features.best_month(t.main()), "best_month")


@query
def pair_cv(t):
    return rounded(pair_features.pair_variation(t.main()),
                   "avg_qty", "cv_matrix", "cv_visit")


@query
def season_lookup(t):
    """Season coefficient and company code of every invoice, as counts."""
    inv = t.invoices()
    return as_long(inv.groupBy("mois", "societe").agg(
        F.count("*").alias("n_invoices"))
        .withColumn("month_coef", cal.season_coefficient(F.col("mois")))
        .withColumn("unmapped_coef", cal.season_coefficient(
            F.col("mois") + 6))
        .withColumn("unmapped_default", cal.season_coefficient(
            F.col("mois") + 6, default=F.lit(1.0)))
        .withColumn("company_encoded", pair_features.company_code()),
        "mois", "company_encoded")


@query
def cyclic_month(t):
    inv = t.invoices().groupBy("mois").agg(F.count("*").alias("n_invoices"))
    return rounded(as_long(
        inv.withColumn("month_sin", cal.month_sin(F.col("mois")))
        .withColumn("month_cos", cal.month_cos(F.col("mois"))), "mois"),
        "month_sin", "month_cos")


@query
def client_geo(t):
    return entity_features.client_geo(t.main())


@query
def product_profile(t):
    return as_long(entity_features.product_profile(t.main_stage(), REFERENCE_DATE),
                   "days_since_first_order")


@query
def client_profile(t):
    return rounded(entity_features.client_profile(t.main_stage()),
                   "client_avg_basket_size")


MATRIX_DOUBLES = ["avg_qty", "std_qty", "avg_delay_days", "recency_relative",
                  "trend", "avg_seasonal_coef", "client_avg_basket_size"]
MATRIX_INTS = ["recency_days", "company_encoded", "best_month",
               "days_since_first_order"]


@query
def feature_matrix(t):
    return rounded(as_long(t.matrix(), *MATRIX_INTS), *MATRIX_DOUBLES)


@query
def negative_pairs(t):
    """Never-bought pairs, three per bought pair, with default features."""
    full = t.matrix_stage()
    return rounded(as_long(
        sampling.negative_features(
            sampling.negative_pairs(full), full, REFERENCE_DATE),
        "company_encoded", "best_month", "days_since_first_order",
        "frequency"),
        "recency_relative", "client_avg_basket_size")


@query
def visits(t):
    return v.visits(t.main())


@query
def eligible_visits(t):
    return v.eligible_visits(t.main_stage())


@query
def visit_history(t):
    return v.visit_history(t.main_stage())


@query
def visit_state_asof(t):
    return v.state_before(t.main_stage())


@query
def visit_candidates(t):
    return v.candidates(t.main_stage(), min_appearances=2)


VISIT_DOUBLES = ["avg_qty", "std_qty", "avg_delay_days", "recency_relative",
                 "trend", "avg_seasonal_coef"]


@query
def visit_features(t):
    return rounded(as_long(
        t.visit_dataset().drop("target_bought", "target_qty"),
        "best_month"), *VISIT_DOUBLES)


@query
def visit_increments(t):
    """The whole training set from a base and two increments."""
    main, day = t.main_stage(), F.col("date_commande")
    cuts = [F.lit(c).cast("date") for c in (testbed.TRAIN_CUTOFF,
                                            testbed.VALIDATION_CUTOFF)]
    state, rows = None, None
    for part in (day <= cuts[0], (day > cuts[0]) & (day <= cuts[1]),
                 day > cuts[1]):
        built = increments.extend(state, main.filter(part), write_and_read)
        state = built.state
        rows = built.rows if rows is None else rows.unionByName(built.rows)
    return rounded(as_long(rows, "best_month", "target_bought"),
                   *VISIT_DOUBLES)


@query
def visit_targets(t):
    return as_long(v.targets(t.main_stage()), "target_bought")


@query
def visit_summary(t):
    return rounded(v.summary(t.main_stage()), "positive_rate")


@query
def positives(t):
    rows = v.targets(t.main_stage())
    return rounded(rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("target_qty") > 0).alias("n_positives"),
        F.sum("target_qty").alias("total_qty"),
        (F.count_if(F.col("target_qty") > 0) >= 100).alias("enough_to_train"))
        .withColumn("positive_share", F.col("n_positives") * 100.0
                    / F.col("n_rows")), "positive_share")
