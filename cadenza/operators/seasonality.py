"""Seasonality and time-series statistics.

Every function here starts from one row per month, week or weekday, a size set
by the calendar and not by the data, so unpartitioned windows are safe.
"""

import math

from pyspark.sql import DataFrame, Window, functions as F

from cadenza import constants as C
from cadenza.operators.profiling import activity, monthly, weekly


def _all():
    return Window.partitionBy()


def _by_month():
    return Window.orderBy("annee", "mois")


def rolling(df: DataFrame, order: str, columns: list[str], width: int,
            ) -> DataFrame:
    """Mean over the last ``width`` rows, NULL until the frame is full."""
    frame = Window.orderBy(order).rowsBetween(1 - width, 0)
    return df.withColumns({
        f"{c}_ma": F.when(F.count(c).over(frame) == width,
                          F.avg(c).over(frame)) for c in columns})


def weekly_rolling(main: DataFrame, width: int = 4) -> DataFrame:
    return rolling(weekly(main), "week_end",
                   ["nb_commandes", "total_qte", "nb_clients"], width)


def week_outliers(main: DataFrame, limit: float = 2.0) -> DataFrame:
    """Weeks whose invoice count lies beyond ``limit`` deviations."""
    z = ((F.col("nb_commandes") - F.avg("nb_commandes").over(_all()))
         / F.stddev_samp("nb_commandes").over(_all()))
    return (weekly(main).withColumn("z", z)
            .filter(F.abs("z") > limit)
            .select("week_end", "nb_commandes", "total_qte", "z"))


def month_changes(main: DataFrame) -> DataFrame:
    """Percent change to the previous and the twelfth-previous month row."""
    x = F.col("nb_commandes")
    def change(step):
        old = F.lag("nb_commandes", step).over(_by_month())
        return (x / old - 1) * 100
    return monthly(main).select("annee", "mois", "nb_commandes",
                                change(1).alias("mom_pct"),
                                change(12).alias("yoy_pct"))


def profile(main: DataFrame) -> DataFrame:
    """Mean and deviation per calendar month across years, with its index."""
    months = monthly(main).groupBy("mois").agg(
        F.avg("nb_commandes").alias("avg_commandes"),
        F.avg("total_qte").alias("avg_qte"),
        F.stddev_samp("nb_commandes").alias("std_commandes"))
    return months.withColumn(
        "seasonal_index",
        F.col("avg_commandes") / F.avg("avg_commandes").over(_all()))


def month_variation(main: DataFrame) -> DataFrame:
    return profile(main).select(
        "mois",
        (F.col("std_commandes") / F.col("avg_commandes") * 100)
        .alias("cv_pct"))


def year_normalised(main: DataFrame) -> DataFrame:
    year = Window.partitionBy("annee")
    return monthly(main).select(
        "annee", "mois",
        (F.col("nb_commandes") / F.avg("nb_commandes").over(year))
        .alias("seasonal_index"))


def month_against_mean(main: DataFrame) -> DataFrame:
    """Mean line quantity per calendar month against the overall mean."""
    months = main.groupBy("mois").agg(
        F.count("quantite").alias("_n"), F.sum("quantite").alias("_q"))
    overall = F.sum("_q").over(_all()) / F.sum("_n").over(_all())
    return months.select(
        "mois", (F.col("_q") / F.col("_n")).alias("avg_qty"),
        overall.alias("overall_avg"),
    ).withColumn("above_mean", F.col("avg_qty") > F.col("overall_avg"))


def top_categories(main: DataFrame, k: int = 5) -> DataFrame:
    return (main.groupBy("categorie").agg(F.count("*").alias("n_lines"))
            .orderBy(F.desc("n_lines"), "categorie").limit(k))


def top_category_months(main: DataFrame, k: int | None = 5) -> DataFrame:
    """Lines per month of the k largest categories, or of all.

    Lines are counted per (category, month) before the semi join, which then
    handles a few rows per category.
    """
    counts = main.groupBy("categorie", "annee", "mois").agg(
        F.count("*").alias("nb_lignes"))
    if k is None:
        return counts
    return counts.join(top_categories(main, k), "categorie", "left_semi")


def category_season(main: DataFrame, k: int | None = 5) -> DataFrame:
    """Mean lines and season coefficient per category and calendar month."""
    category = Window.partitionBy("categorie")
    months = top_category_months(main, k).groupBy("categorie", "mois").agg(
        F.avg("nb_lignes").alias("avg_lignes"))
    return months.withColumn(
        "seasonal_index",
        F.col("avg_lignes") / F.avg("avg_lignes").over(category))


def weekday_profile(main: DataFrame) -> DataFrame:
    """Totals per weekday, Monday first; absent weekdays stay as NULL."""
    spark = main.sparkSession
    spine = spark.range(7).select(
        F.col("id").cast("int").alias("jour_semaine"),
        F.element_at(F.array(*[F.lit(d) for d in C.WEEKDAY_NAMES]),
                     (F.col("id") + 1).cast("int")).alias("day_name"))
    seen = activity(main, F.col("jour_semaine")).select(
        F.col("_k0").alias("jour_semaine"), "nb_commandes", "total_qte")
    return spine.join(seen, "jour_semaine", "left")


def weekday_share(main: DataFrame) -> DataFrame:
    days = weekday_profile(main).dropna(subset=["nb_commandes"])
    return days.withColumn(
        "share_pct", F.col("nb_commandes") * 100.0
        / F.sum("nb_commandes").over(_all()))


def decompose(main: DataFrame, period: int = 12) -> DataFrame:
    """Additive trend, season and rest of monthly invoices.

    The trend is the centred mean over ``period`` months with half weights at
    both ends; the first and last half period follow a straight line fitted to
    the nearest ``period`` trend values.
    """
    half = period // 2
    series = monthly(main).select(
        "annee", "mois", F.col("nb_commandes").cast("double").alias("observed"),
        F.row_number().over(_by_month()).alias("_i"))
    row = Window.orderBy("_i")
    inner = F.sum("observed").over(row.rowsBetween(1 - half, half - 1))
    edges = (F.lag("observed", half).over(row)
             + F.lead("observed", half).over(row)) / 2
    series = series.withColumn("_trend", (inner + edges) / period)
    known = F.col("_trend").isNotNull()
    first = F.min(F.when(known, F.col("_i"))).over(_all())
    last = F.max(F.when(known, F.col("_i"))).over(_all())
    series = series.withColumns({"_first": first, "_last": last})
    head = F.when(F.col("_i") < F.col("_first") + period, F.col("_trend"))
    tail = F.when(F.col("_i") > F.col("_last") - period, F.col("_trend"))

    def line(y):
        x = F.when(y.isNotNull(), F.col("_i").cast("double"))
        slope = F.regr_slope(y, x).over(_all())
        level = F.regr_intercept(y, x).over(_all())
        return slope * F.col("_i") + level

    series = series.withColumns({"_head": line(head), "_tail": line(tail)})
    trend = (F.when(F.col("_i") < F.col("_first"), F.col("_head"))
             .when(F.col("_i") > F.col("_last"), F.col("_tail"))
             .otherwise(F.col("_trend")))
    series = series.withColumn("trend", trend).withColumn(
        "_phase", (F.col("_i") - 1) % period)
    phase = Window.partitionBy("_phase")
    series = series.withColumn(
        "_season", F.avg(F.col("observed") - F.col("trend")).over(phase))
    centre = F.avg(F.when(F.col("_i") <= period, F.col("_season"))).over(_all())
    return (series.withColumn("seasonal", F.col("_season") - centre)
            .withColumn("resid", F.col("observed") - F.col("trend")
                        - F.col("seasonal"))
            .select("annee", "mois", "observed", "trend", "seasonal", "resid",
                    F.col("_trend").isNotNull().alias("is_interior")))


def strength(main: DataFrame) -> DataFrame:
    """max(0, 1 - var(rest) / (var(season) + var(rest)))."""
    return decompose(main).agg(
        F.var_pop("seasonal").alias("var_seasonal"),
        F.var_pop("resid").alias("var_resid"),
    ).withColumn("strength", F.greatest(F.lit(0.0), 1 - F.col("var_resid") / (
        F.col("var_seasonal") + F.col("var_resid"))))


def kruskal(main: DataFrame) -> DataFrame:
    """Kruskal-Wallis H over calendar months, corrected for ties, and its p."""
    order = Window.orderBy("nb_commandes")
    same = Window.partitionBy("nb_commandes")
    ranks = monthly(main).select("mois", "nb_commandes").withColumns({
        "_t": F.count("*").over(same),
        "_r": F.rank().over(order) + (F.count("*").over(same) - 1) / 2.0})
    groups = ranks.groupBy("mois").agg(
        F.count("*").alias("_n"), F.sum("_r").alias("_sum"),
        F.sum((F.col("_t") * F.col("_t") - 1).cast("double")).alias("_ties"))
    total = groups.agg(
        F.sum("_n").cast("double").alias("n"),
        F.sum(F.col("_sum") * F.col("_sum") / F.col("_n")).alias("_s"),
        F.sum("_ties").alias("_ties"), (F.count("*") - 1).alias("df"))
    n = F.col("n")
    raw = 12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    out = total.select(
        (raw / (1 - F.col("_ties") / (n * n * n - n))).alias("h_stat"), "df",
        n.cast("long").alias("n_months"))
    return out.withColumn("p_value", chi_square_tail(
        F.col("h_stat"), F.col("df"))).withColumn(
        "is_seasonal", F.col("p_value") < 0.05)


def chi_square_tail(x, df, terms: int = 2000):
    """P(chi-square > x): one less the series of the incomplete gamma.

    The series t^a e^-t / gamma(a + 1) * (1 + t/(a+1) + t^2/((a+1)(a+2)) ..)
    with a = df / 2 and t = x / 2 is summed for ``terms`` terms, which settles
    it for t up to about 1800; beyond, the tail is 0 for any df of months.
    """
    a, t = df / 2, F.greatest(x, F.lit(0.0)) / 2
    # ln gamma(a + 1) for halves: a (a-1) .. down to 1, or 1/2 and sqrt(pi)
    steps = F.sequence(F.lit(0), F.greatest(
        F.ceil(a) - 1, F.lit(0)).cast("int"))
    log_gamma = F.aggregate(
        steps, F.when(df % 2 == 1, F.lit(math.log(math.pi) / 2))
        .otherwise(F.lit(0.0)), lambda total, i: total + F.log(F.greatest(
            a - i, F.lit(0.5))))
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state, i):
        term = state["term"] * t / (a + i)
        return F.struct(term.alias("term"),
                        (state["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), begin, add,
                         lambda state: state["sum"])
    below = F.exp(a * F.log(t) - t - log_gamma + F.log(series))
    return F.when(t <= 0, 1.0).otherwise(F.least(F.greatest(
        1 - below, F.lit(0.0)), F.lit(1.0)))


def autocorrelation(main: DataFrame, max_lag: int = 24) -> DataFrame:
    """Autocorrelation of monthly invoices up to min(24, n/2 - 1)."""
    x = F.col("nb_commandes").cast("double")
    series = monthly(main).select(
        F.row_number().over(_by_month()).alias("_i"),
        (x - F.avg(x).over(_all())).alias("_d"), F.count("*").over(_all())
        .alias("_n"))
    lagged = series.select(
        "_i", "_d", F.explode(F.expr(
            f"sequence(0, cast(least({max_lag}, floor(_n / 2) - 1) as int))"))
        .alias("lag"))
    later = series.select(F.col("_i").alias("_j"), F.col("_d").alias("_e"))
    base = series.agg(F.sum(F.col("_d") * F.col("_d")))
    return (lagged.withColumn("_j", F.col("_i") + F.col("lag"))
            .join(later, "_j").groupBy("lag")
            .agg(F.sum(F.col("_d") * F.col("_e")).alias("_c"))
            .withColumn("acf", F.col("_c") / base.scalar()).drop("_c"))


def verdict(main: DataFrame) -> DataFrame:
    """Strong and weak months and the class of the index's variation."""
    months = profile(main)
    index = F.col("seasonal_index")
    cv = F.col("cv_pct")
    return months.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(
            F.when(index > C.STRONG_MONTH, F.col("mois")))),
            lambda m: m.cast("string")), ",").alias("strong_months"),
        F.array_join(F.transform(F.sort_array(F.collect_list(
            F.when(index < C.WEAK_MONTH, F.col("mois")))),
            lambda m: m.cast("string")), ",").alias("weak_months"),
        (F.stddev_samp(index) / F.avg(index) * 100).alias("cv_pct"),
    ).withColumn("verdict", F.when(cv > C.CV_MARKED, "marked")
                 .when(cv > C.CV_MODERATE, "moderate").otherwise("weak"))
