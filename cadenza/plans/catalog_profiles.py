"""Queries: profiles, series, seasonality, top-k."""

from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.operators import (joining, profiling as p, seasonality as s,
                               sketches)
from cadenza.plans.registry import as_long, query, rounded
from cadenza.session import write_and_read


@query
def null_report(t):
    lines = joining.lines_with_invoices(t.lines(), t.invoices(), "left")
    return rounded(p.null_report(
        lines.drop("_matched").join(t.clients(), ["code_client", "societe"],
                                    "left")), "pct")


@query
def dup_report(t):
    return rounded(p.duplicate_report(
        t.raw_lines(), ["code_facture", "societe_ligne", "code_article"]),
        "pct")


@query
def describe_qty(t):
    return rounded(p.describe(t.main_stage(), "quantite"), "mean", "std")


@query
def qty_thresholds(t):
    return rounded(p.thresholds(t.raw_lines(), "quantite"),
                   "pct_up_to_10", "pct_up_to_50")


@query
def qty_quantiles(t):
    return rounded(p.tail_quantiles(t.main_stage(), "quantite"),
                   "p50", "p90", "p95", "p99")


@query
def sketched_months(t):
    """Months from daily sketches: exact sums, and errors within bounds.

    Distinct counts within 5 % (three standard errors), quantiles within
    2 % of the wanted rank.
    """
    main = t.main_stage()
    month = F.date_format("date_commande", "yyyy-MM")
    days = write_and_read(sketches.daily(main), "daily-sketches")
    found = sketches.errors(sketches.estimates(sketches.merged(
        days, month.alias("period"))), main, month)
    return found.select(
        "period", "n_lines", "total_qty",
        *[f"exact_{k}" for k in sketches.KEYS],
        *[(F.col(f"error_{k}") <= 0.05).alias(f"{k}_within")
          for k in sketches.KEYS],
        *[(F.col(f"error_{p}") <= 0.02).alias(f"{p}_within")
          for p in sketches.SHARES])


@query
def key_numbers(t):
    return rounded(p.key_numbers(t.main_stage()), "avg_qty_line",
                   "avg_invoices_client", "avg_lines_invoice")


@query
def gps_coverage(t):
    return rounded(p.gps_coverage(t.main()), "pct_fully_located")


@query
def value_counts(t):
    raw = t.raw_lines()
    return p.value_counts(raw, "categorie").unionByName(
        p.value_counts(raw, "societe_ligne"))


@query
def client_cadence(t):
    return rounded(p.client_cadence(t.main()), "avg_days_between_orders")


@query
def client_behaviour(t):
    return rounded(p.client_behaviour(t.main_stage()), "avg_days_between_orders")


@query
def monthly_activity(t):
    return as_long(p.monthly(t.main()), "annee", "mois")


@query
def weekly_activity(t):
    return p.weekly(t.main_stage())


@query
def weekly_rolling(t):
    return rounded(s.weekly_rolling(t.main_stage()), "nb_commandes_ma",
                   "total_qte_ma", "nb_clients_ma")


@query
def week_outliers(t):
    return rounded(s.week_outliers(t.main_stage()), "z")


@query
def day_coverage(t):
    return rounded(p.day_coverage(t.main()), "coverage_pct")


@query
def gap_days(t):
    return p.gap_days(t.main_stage())


@query
def month_year_pivot(t):
    return as_long(p.month_year_pivot(t.main_stage()), "mois")


@query
def sparsity(t):
    return rounded(p.sparsity(t.main_stage()), "sparsity_pct")


@query
def feature_corr(t):
    return rounded(p.correlations(
        t.matrix(),
        C.CORRELATED_FEATURES), "corr")


@query
def histograms(t):
    """Distributions of the feature matrix, clipped as in the reports."""
    full = t.matrix().withColumn(
        "cv", F.when(F.col("avg_qty") > 0, F.col("std_qty")
                     / F.col("avg_qty")).otherwise(F.lit(0.0)))
    return p.histograms(full, {
        "frequency": (0, 30, 30), "recency_days": (0, 365, 35),
        "avg_qty": (0, 150, 50), "client_total_invoices": (0, 50, 50),
        "last_qty": (0, 500, 100)}).drop("bin_start")


@query
def client_month_intensity(t):
    return rounded(p.client_month_intensity(t.main()),
                   "avg_orders_per_client")


@query
def active_clients_summary(t):
    return rounded(p.active_clients(t.main()), "mean_clients", "cov_pct")


@query
def mom_yoy(t):
    return rounded(as_long(s.month_changes(t.main()), "annee", "mois"),
                   "mom_pct", "yoy_pct")


@query
def seasonal_profile(t):
    return rounded(as_long(s.profile(t.main()).drop("seasonal_index"),
                           "mois"),
                   "avg_commandes", "avg_qte", "std_commandes")


@query
def seasonal_index(t):
    return rounded(as_long(s.profile(t.main()).select(
        "mois", "avg_commandes", "seasonal_index"), "mois"),
        "avg_commandes", "seasonal_index")


@query
def seasonal_norm(t):
    return rounded(as_long(s.year_normalised(t.main()), "annee", "mois"),
                   "seasonal_index")


@query
def month_vs_mean(t):
    return rounded(as_long(s.month_against_mean(t.main()), "mois"),
                   "avg_qty", "overall_avg")


@query
def top_category_rows(t):
    return as_long(s.top_category_months(t.main_stage()), "annee", "mois")


@query
def category_season(t):
    return rounded(as_long(s.category_season(t.main_stage()), "mois"),
                   "avg_lignes", "seasonal_index")


@query
def category_season_all(t):
    """Season coefficients of every category."""
    return rounded(as_long(s.category_season(t.main_stage(), None), "mois"),
                   "avg_lignes", "seasonal_index")


@query
def weekday_profile(t):
    return as_long(s.weekday_profile(t.main()), "jour_semaine")


@query
def weekday_share(t):
    return rounded(as_long(s.weekday_share(t.main()), "jour_semaine"),
                   "share_pct")


@query
def seasonal_decompose(t):
    return rounded(as_long(s.decompose(t.main()), "annee", "mois"),
                   "trend", "seasonal", "resid")


@query
def seasonal_strength(t):
    return rounded(s.strength(t.main()), "var_seasonal", "var_resid",
                   "strength")


@query
def month_cv(t):
    return rounded(as_long(s.month_variation(t.main()), "mois"), "cv_pct")


@query
def kruskal_h(t):
    return rounded(s.kruskal(t.main()), "h_stat", "p_value")


@query
def acf(t):
    return rounded(as_long(s.autocorrelation(t.main_stage()), "lag"), "acf")


@query
def season_verdict(t):
    return rounded(s.verdict(t.main()), "cv_pct")


@query
def top_products(t):
    return p.top_products(t.main())


@query
def category_quantities(t):
    return p.category_quantities(t.main())


@query
def top_lines(t):
    return p.top_lines(t.main())


@query
def pair_history(t):
    return rounded(p.pair_history(t.main_stage()), "avg_qty", "std_qty")


@query
def outlier_weight(t):
    return rounded(p.outlier_weight(t.main_stage(), "quantite"), "mean_qty",
                   "square_large", "square_normal", "large_vs_normal_pct")


@query
def scalar_pack(t):
    """Scalar functions used nowhere else, on every clean invoice."""
    day, key = F.col("date_commande"), F.col("code_facture")
    number = F.substring(key, 2, 20).cast("double")
    return rounded(t.invoices().select(
        key, "societe",
        F.weekofyear(day).cast("long").alias("iso_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.date_format(day, "MMM").alias("month_name"),
        F.trunc(day, "month").alias("month_start"),
        F.make_date(F.year(day), F.month(day), F.lit(1)).alias("made_date"),
        F.date_add(day, 30).alias("plus_30"),
        F.log1p(number).alias("log1p"),
        F.expm1(F.log1p(number)).alias("expm1"),
        F.sqrt(number).alias("root"),
        F.abs(number - 2500).alias("distance"),
        F.rint(number / 2).alias("half_even"),
        F.ceil(number / 7).alias("up"),
        (number / 7).cast("long").alias("cut"),
        F.lower("ref_commercial").contains("urgent").alias("is_urgent"),
        F.coalesce(F.nullif(F.month(day), F.lit(6)).cast("long"),
                   F.lit(0).cast("long")).alias("no_june"),
        F.col("societe").isin("CO1", "CO3").cast("int").alias("in_list"),
        F.to_json(F.struct(key.alias("facture"), F.col("societe")))
        .alias("as_json"),
        F.get_json_object(F.to_json(F.struct(key.alias("facture"))),
                          "$.facture").alias("from_json"),
        F.upper(F.substring("ref_commercial", 3, 4)).alias("priority"),
    ), "log1p", "expm1", "root")
