"""Reorder features of a (client, product) pair.

A pair is ordered by (date, quantity); lines equal on both are interchangeable
for every quantity feature.  So lines are first counted per (pair, date,
quantity) -- a map-side combine -- and windows run on those counts.  However
many lines one pair holds, its window sees at most days x distinct quantities
rows.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza import constants as C
from cadenza.functions import calendar as cal, quantities as qty

PAIR = ["code_client", "code_article"]


def order_counts(main: DataFrame, extra: dict[str, Column] | None = None,
                 ) -> DataFrame:
    """(pair, date, quantity) -> number of lines ``n``."""
    extra = extra or {}
    return main.groupBy(*PAIR, "date_commande", "quantite").agg(
        F.count("*").alias("n"), *[c.alias(k) for k, c in extra.items()])


def _ordered():
    return Window.partitionBy(*PAIR).orderBy("date_commande", "quantite")


def _running():
    return _ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)


# -- single features, each one aggregate with a map-side combine -------------

def quantity_stats(main: DataFrame) -> DataFrame:
    q = F.col("quantite")
    return main.groupBy(*PAIR).agg(
        F.avg(q).alias("avg_qty"), F.median(q).alias("median_qty"),
        F.min(q).alias("min_qty"), F.max(q).alias("max_qty"),
        F.sum(q).alias("total_qty"), F.count(q).alias("frequency"))


def both_deviations(main: DataFrame) -> DataFrame:
    """Sample deviation (matrix) and population deviation (visit set)."""
    return main.groupBy(*PAIR).agg(
        F.coalesce(F.stddev_samp("quantite"), F.lit(0.0))
        .alias("std_qty_matrix"),
        F.stddev_pop("quantite").alias("std_qty_visit"))


def last_quantity(main: DataFrame) -> DataFrame:
    return main.groupBy(*PAIR).agg(
        F.max_by("quantite", F.struct("date_commande", "quantite"))
        .alias("last_qty"))


def recency(main: DataFrame, reference_date: str) -> DataFrame:
    return main.groupBy(*PAIR).agg(
        F.max("date_commande").alias("last_date")).withColumn(
        "recency_days",
        F.datediff(F.lit(reference_date).cast("date"), "last_date"))


def gap_mean(first: Column, last: Column, lines: Column) -> Column:
    """Mean gap between consecutive lines; the gaps telescope to last-first."""
    return F.when(lines > 1, F.datediff(last, first) / (lines - 1))


def cadence(main: DataFrame, reference_date: str) -> DataFrame:
    """Mean gap, recency and overdue flag under both published rules."""
    base = main.groupBy(*PAIR).agg(
        F.min("date_commande").alias("_first"),
        F.max("date_commande").alias("_last"),
        F.count("*").alias("frequency"))
    gap = F.coalesce(gap_mean(F.col("_first"), F.col("_last"),
                              F.col("frequency")), F.lit(C.DEFAULT_GAP_DAYS))
    days = F.datediff(F.lit(reference_date).cast("date"), F.col("_last"))
    return (base
            .withColumns({"recency_days": days, "avg_delay_days": gap})
            .withColumn("avg_delay_days_visit",
                        F.greatest("avg_delay_days", F.lit(1.0)))
            .withColumn("recency_relative", qty.relative_recency(
                F.col("recency_days"), F.col("avg_delay_days")))
            .withColumn("recency_relative_visit",
                        F.col("recency_days") / F.col("avg_delay_days_visit"))
            .withColumn("is_overdue", F.col("recency_relative") >= 1.0)
            .drop("_first", "_last"))


def line_gaps(main: DataFrame) -> DataFrame:
    """Every line with its invoice, the day of the pair's line before it and
    the gap in days.

    Lines follow each other by day, quantity, invoice and company.  All but
    the first line of a day follow one of the same day, so that a window has
    to hold no more than a pair's lines of one day; the day before comes from
    the pair's distinct days.
    """
    day = Window.partitionBy(*PAIR, "date_commande").orderBy(
        "quantite", "code_facture", "societe")
    days = main.select(*PAIR, "date_commande").distinct().withColumn(
        "_before", F.lag("date_commande").over(
            Window.partitionBy(*PAIR).orderBy("date_commande")))
    placed = main.select(
        *PAIR, "code_facture", "societe", "date_commande", "quantite",
        F.row_number().over(day).alias("_place"))
    previous = F.when(F.col("_place") > 1, F.col("date_commande")).otherwise(
        F.col("_before"))
    return placed.join(days, [*PAIR, "date_commande"]).select(
        *PAIR, "code_facture", "societe", "date_commande", "quantite",
        previous.alias("previous_date"),
        F.datediff("date_commande", previous).alias("gap_days"))


def gaps(main: DataFrame) -> DataFrame:
    """Previous quantity and gap in days of every line, with multiplicity.

    Lines equal in pair, date, quantity, previous quantity and gap share one
    row and are counted in ``n_lines``: of n equal lines the first follows the
    previous entry, the other n-1 follow an equal line of the same day.
    """
    counted = order_counts(main)
    step = counted.select(
        *PAIR, "date_commande", "quantite", "n",
        F.lag("quantite").over(_ordered()).alias("prev"),
        F.datediff("date_commande", F.lag("date_commande").over(_ordered()))
        .alias("gap"))
    one = F.struct(F.col("prev").alias("quantite_lag1"),
                   F.col("gap").alias("date_diff"),
                   F.lit(1).cast("long").alias("n_lines"))
    rest = F.struct(F.col("quantite").alias("quantite_lag1"),
                    F.lit(0).alias("date_diff"),
                    (F.col("n") - 1).alias("n_lines"))
    rows = step.select(
        *PAIR, "date_commande", "quantite",
        F.inline(F.when(F.col("n") > 1, F.array(one, rest))
                 .otherwise(F.array(one))))
    # the rest may equal the first copy when the previous entry is of the
    # same day and quantity, which counting has already excluded
    return rows


def trends(main: DataFrame) -> DataFrame:
    """Change of the mean between the earlier and the later half."""
    return _halves(_positions(order_counts(main))).select(*PAIR, "trend")


def _positions(counts: DataFrame) -> DataFrame:
    # in the order of the running sum, so that one window step gives both
    whole = _ordered().rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumns({
        "_before": F.sum("n").over(_running()) - F.col("n"),
        "_lines": F.sum("n").over(whole),
    })


def _early_quantity() -> Column:
    """Quantity of this entry's lines that lie in the earlier half."""
    half = F.floor(F.col("_lines") / 2)
    inside = F.greatest(
        F.lit(0).cast("long"), F.least(F.col("n"), half - F.col("_before")))
    return F.col("quantite") * inside


def _halves(positions: DataFrame) -> DataFrame:
    sums = positions.groupBy(*PAIR).agg(
        F.sum("n").alias("frequency"),
        F.sum(F.col("quantite") * F.col("n")).alias("total_qty"),
        F.sum(_early_quantity()).alias("_early"))
    return sums.withColumn("trend", qty.trend(
        F.col("_early"), F.floor(F.col("frequency") / 2),
        F.col("total_qty"), F.col("frequency"))).drop("_early")


def company_code(codes: dict | None = None) -> Column:
    return cal.lookup(codes or C.COMPANY_CODES, F.col("societe"))


def first_company(main: DataFrame, codes: dict | None = None) -> DataFrame:
    """Company of the pair's earliest line, with its code."""
    first = main.groupBy(*PAIR).agg(
        F.min(F.struct("date_commande", "societe"))["societe"]
        .alias("societe"))
    return first.withColumn("company_encoded", company_code(codes))


def month_quantities(main: DataFrame) -> DataFrame:
    """(pair, month) -> lines and quantity."""
    return main.groupBy(*PAIR, "mois").agg(
        F.count("*").alias("_n"), F.sum("quantite").alias("_q"))


def season(main: DataFrame, reference_date: str) -> DataFrame:
    """Season coefficient: mean over lines, quantity-weighted, current."""
    by_month = month_quantities(main)
    coef = cal.season_coefficient(F.col("mois"))
    mean = F.col("_q") / F.col("_n")
    return by_month.groupBy(*PAIR).agg(
        (F.sum(coef * F.col("_n")) / F.sum("_n"))
        .alias("avg_seasonal_coef_matrix"),
        (F.sum(coef * mean) / F.greatest(F.sum(mean), F.lit(1.0)))
        .alias("avg_seasonal_coef_visit"),
    ).withColumn("current_month_coef", cal.season_coefficient(
        F.month(F.lit(reference_date).cast("date"))))


def best_month(main: DataFrame) -> DataFrame:
    """Month with the highest mean quantity; ties take the lowest month."""
    return month_quantities(main).groupBy(*PAIR).agg(
        F.min_by("mois", F.struct(-F.col("_q") / F.col("_n"), F.col("mois")))
        .alias("best_month"))


def pair_variation(main: DataFrame) -> DataFrame:
    """Std over mean under the sample and the population deviation."""
    stats = main.groupBy(*PAIR).agg(
        F.avg("quantite").alias("avg_qty"),
        F.coalesce(F.stddev_samp("quantite"), F.lit(0.0)).alias("_samp"),
        F.stddev_pop("quantite").alias("_pop"))
    return stats.select(
        *PAIR, "avg_qty",
        qty.variation(F.col("_samp"), F.col("avg_qty")).alias("cv_matrix"),
        qty.variation(F.col("_pop"), F.col("avg_qty"), 0.0).alias("cv_visit"))


# -- all of group 1 and 2 at once --------------------------------------------

def pair_matrix(main: DataFrame, reference_date: str,
                codes: dict | None = None) -> DataFrame:
    """Order-history and season features of every pair in two shuffles.

    Shuffle 1 finishes the (pair, date, quantity) counts, shuffle 2 brings a
    pair together; windows and final aggregate reuse the second.  Median, last
    quantity and first company are picked by their place in the pair's order:
    no aggregate holds a map of quantities.
    """
    day = F.col("date_commande")
    counts = _middle_quantities(order_counts(
        main, {"_company": F.min("societe")}))
    rows = _positions(counts).withColumns({
        "_w": F.col("quantite") * F.col("n"),
        "_early": _early_quantity(),
        "_month": F.month(day),
    })
    per_month = {}
    for m in C.SEASON_COEFFICIENTS:
        here = F.col("_month") == m
        per_month[f"_q{m}"] = F.sum(F.when(here, F.col("_w")))
        per_month[f"_n{m}"] = F.sum(F.when(here, F.col("n")))
    ref = F.lit(reference_date).cast("date")
    q, n = F.col("quantite"), F.col("n")
    stats = rows.groupBy(*PAIR).agg(
        F.sum("n").alias("frequency"), F.sum("_w").alias("total_qty"),
        F.sum(F.col("_above") * n).alias("_above_sum"),
        F.sum(F.col("_above") * F.col("_above") * n).alias("_squares"),
        F.min(q).alias("min_qty"), F.max(q).alias("max_qty"),
        (F.max("_low") * 0.5 + F.max("_high") * 0.5).alias("median_qty"),
        F.max(F.when(F.col("_before") + n == F.col("_lines"), q))
        .alias("last_qty"),
        F.min(day).alias("_first"), F.max(day).alias("_last"),
        F.sum("_early").alias("_early"),
        F.min(F.struct(day, F.col("_company")))["_company"]
        .alias("societe"),
        *[c.alias(k) for k, c in per_month.items()])
    freq, total = F.col("frequency"), F.col("total_qty")
    spread = variance(freq, F.col("_above_sum"), F.col("_squares"), freq - 1)
    coefs = C.SEASON_COEFFICIENTS
    weighted = sum((F.coalesce(F.col(f"_n{m}"), F.lit(0)) * F.lit(c)
                    for m, c in coefs.items()), F.lit(0.0))
    means = [(F.col(f"_q{m}") / F.col(f"_n{m}"), m) for m in coefs]
    return (stats
            .withColumns({
                "avg_qty": total / freq,
                "std_qty": F.when(freq > 1, F.sqrt(spread))
                .otherwise(F.lit(0.0)),
                "recency_days": F.datediff(ref, F.col("_last")),
                "avg_delay_days": F.coalesce(
                    gap_mean(F.col("_first"), F.col("_last"), freq),
                    F.lit(C.DEFAULT_GAP_DAYS)),
                "trend": qty.trend(F.col("_early"), F.floor(freq / 2), total,
                                   freq),
                "company_encoded": company_code(codes),
                "avg_seasonal_coef": weighted / freq,
                "best_month": first_maximum(means),
                "current_month_coef": cal.season_coefficient(F.month(ref)),
            })
            .withColumn("recency_relative", qty.relative_recency(
                F.col("recency_days"), F.col("avg_delay_days")))
            .select(*PAIR, "avg_qty", "median_qty", "std_qty", "min_qty",
                    "max_qty", "total_qty", "frequency", "last_qty",
                    "recency_days", "avg_delay_days", "recency_relative",
                    "trend", "company_encoded", "current_month_coef",
                    "avg_seasonal_coef", "best_month"))


def _middle_quantities(counts: DataFrame) -> DataFrame:
    """Add ``_low`` and ``_high``: the quantity of the pair's middle line, or
    of the two in the middle, on the rows that hold them, and ``_above``.

    Deviations are summed from the pair's smallest quantity on: equal
    quantities give exact zeros, and large ones keep their digits.
    """
    q = F.col("quantite")
    known = F.when(q.isNotNull(), F.col("n")).otherwise(0)
    order = Window.partitionBy(*PAIR).orderBy("quantite")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    placed = counts.withColumns({
        "_upto": F.sum(known).over(upto), "_known": F.sum(known).over(whole),
        "_lowest": F.min(q).over(whole)})

    def at(rank: Column) -> Column:
        return F.when((F.col("_upto") - known < rank)
                      & (rank <= F.col("_upto")), q)
    return placed.withColumns({
        "_low": at(F.floor((F.col("_known") + 1) / 2)),
        "_high": at(F.floor(F.col("_known") / 2) + 1),
        "_above": q - F.col("_lowest"),
    }).drop("_upto", "_known", "_lowest")


def variance(n: Column, total: Column, squares: Column,
             divisor: Column) -> Column:
    """From sums of deviations from any one value; rounding stays above 0."""
    return F.greatest(squares - total * total / n, F.lit(0.0)) / divisor


def first_maximum(candidates: list[tuple[Column, int]]) -> Column:
    """Label of the greatest non-null value; the earliest label wins ties.

    A search in an array: a ladder of comparisons that each name all values
    makes a generated method too long for the JVM to compile.
    """
    values = F.array(*[v for v, _ in candidates])
    labels = F.array(*[F.lit(label) for _, label in candidates])
    return F.get(labels, F.array_position(
        values, F.array_max(values)).cast("int") - 1)
