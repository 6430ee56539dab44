"""Profiles, quality reports and business numbers."""

from pyspark.sql import DataFrame, Window, functions as F

from cadenza.functions import calendar as cal, quantities as qty
from cadenza.operators.entity_features import client_profile
from cadenza.operators.ordered import as_struct_scalar, quantiles

INVOICE = ["code_facture", "societe"]


def load_profile(invoices: DataFrame, lines: DataFrame,
                 clients: DataFrame) -> DataFrame:
    """Rows, distinct clients and products, date range per extract."""
    nothing, no_day = F.lit(None).cast("long"), F.lit(None).cast("date")

    def row(df, name, n_clients=nothing, n_products=nothing, low=no_day,
            high=no_day):
        return df.agg(F.count("*").alias("n_rows"),
                      n_clients.alias("n_clients"),
                      n_products.alias("n_products"),
                      low.alias("date_min"), high.alias("date_max")
                      ).withColumn("table_name", F.lit(name))

    return (row(invoices, "commandes", F.countDistinct("code_client"),
                low=F.min("date_commande"), high=F.max("date_commande"))
            .unionByName(row(lines, "lignes",
                             n_products=F.countDistinct("code_article")))
            .unionByName(row(clients, "gps", F.countDistinct("code_client"))))


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, rows, columns and date range of several tables."""
    out = None
    for name, df in tables.items():
        day = next((c for c in df.columns if "date" in c.lower()), None)
        low = F.min(day) if day else F.lit(None).cast("date")
        high = F.max(day) if day else F.lit(None).cast("date")
        row = df.agg(F.count("*").alias("n_rows"), low.alias("date_min"),
                     high.alias("date_max")).select(
            F.lit(name).alias("table_name"), "n_rows",
            F.lit(len(df.columns)).cast("long").alias("n_columns"),
            "date_min", "date_max")
        out = row if out is None else out.unionByName(row)
    return out


def null_report(df: DataFrame) -> DataFrame:
    """Columns holding nulls, with count and percent; one pass."""
    row = df.agg(F.count("*").alias("_total"), *[
        F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (row.unpivot(["_total"], df.columns, "column_name", "n_null")
            .filter(F.col("n_null") > 0)
            .select("column_name", "n_null",
                    (F.col("n_null") * 100.0 / F.col("_total")).alias("pct"))
            .orderBy(F.desc("n_null"), "column_name"))


def duplicate_report(df: DataFrame, key: list[str]) -> DataFrame:
    copies = df.groupBy(*key).agg(F.count("*").alias("_n"))
    return copies.agg(
        F.sum("_n").alias("n_rows"),
        F.sum(F.col("_n") - 1).alias("n_duplicates"),
        F.count_if(F.col("_n") > 1).alias("n_repeated_keys"),
    ).withColumn("pct", F.col("n_duplicates") * 100.0 / F.col("n_rows"))


def describe(df: DataFrame, column: str) -> DataFrame:
    cuts = quantiles(df, column, {"p25": .25, "p50": .5, "p75": .75})
    return (df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"),
                   F.stddev_samp(column).alias("std"),
                   F.min(column).alias("min"), F.max(column).alias("max"))
            .withColumn("_q", as_struct_scalar(cuts, "p25", "p50", "p75"))
            .select("n", "mean", "std", "min", "_q.p25", "_q.p50", "_q.p75",
                    "max"))


def tail_quantiles(df: DataFrame, column: str) -> DataFrame:
    cuts = quantiles(df, column, {"p50": .5, "p90": .9, "p95": .95,
                                  "p99": .99})
    return cuts.withColumn("max", df.agg(F.max(column)).scalar())


def thresholds(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(x <= 0).alias("n_not_positive"),
        F.count_if(x > 100).alias("n_over_100"),
        F.count_if(x > 500).alias("n_over_500"),
        F.count_if(x > 1000).alias("n_over_1000"),
        F.count_if(x <= 10).alias("n_up_to_10"),
        F.count_if(x <= 50).alias("n_up_to_50"),
    ).withColumns({
        "pct_up_to_10": F.col("n_up_to_10") * 100.0 / F.col("n_rows"),
        "pct_up_to_50": F.col("n_up_to_50") * 100.0 / F.col("n_rows")})


def gps_coverage(main: DataFrame) -> DataFrame:
    """Clients with a located line, clients with an unlocated line."""
    located = F.col("latitude").isNotNull().cast("int")
    clients = main.groupBy("code_client").agg(
        F.max(located).alias("_some"), F.min(located).alias("_all"))
    return clients.agg(
        F.count("*").alias("n_clients"),
        F.count_if(F.col("_some") == 1).alias("with_any_gps"),
        F.count_if(F.col("_all") == 0).alias("with_missing_gps"),
    ).withColumns({
        "fully_located": F.col("n_clients") - F.col("with_missing_gps"),
        "pct_fully_located": (F.col("n_clients") - F.col("with_missing_gps"))
        * 100.0 / F.col("n_clients")})


def key_numbers(main: DataFrame) -> DataFrame:
    """Business numbers in one row.

    Each distinct count is taken from a narrow distinct table instead of one
    aggregate with six distinct columns, which would multiply every line by
    the number of distinct groups before the shuffle.
    """
    def n_distinct(*columns):
        return main.select(*columns).distinct().agg(F.count("*")).scalar()

    return (main.agg(
        F.count("*").alias("n_lines"), F.avg("quantite").alias("avg_qty_line"),
        F.min("date_commande").alias("date_min"),
        F.max("date_commande").alias("date_max"))
        .withColumns({
            "n_invoices": n_distinct(*INVOICE),
            "n_clients": n_distinct("code_client"),
            "n_products": n_distinct("code_article"),
            "n_categories": n_distinct("categorie"),
            "n_salespeople": n_distinct("ref_commercial"),
            "clients_with_gps": main.filter(F.col("latitude").isNotNull())
            .select("code_client").distinct().agg(F.count("*")).scalar(),
        })
        .withColumns({
            "clients_without_gps":
                F.col("n_clients") - F.col("clients_with_gps"),
            "avg_invoices_client": F.col("n_invoices") / F.col("n_clients"),
            "avg_lines_invoice": F.col("n_lines") / F.col("n_invoices")}))


def value_counts(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    """Most frequent values, NULL included."""
    return (df.groupBy(column).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(top)
            .select(F.lit(column).alias("column_name"),
                    F.col(column).cast("string").alias("value"), "n"))


def client_cadence(main: DataFrame) -> DataFrame:
    """Mean gap between a client's distinct order days; NULL for one day.

    Gaps between sorted days add up to last minus first.
    """
    days = main.select("code_client", "date_commande").distinct()
    return days.groupBy("code_client").agg(
        F.count("*").alias("n_days"),
        F.min("date_commande").alias("first_order"),
        F.max("date_commande").alias("last_order"),
    ).withColumn("avg_days_between_orders", F.when(
        F.col("n_days") > 1, F.datediff("last_order", "first_order")
        / (F.col("n_days") - 1)))


def client_behaviour(main: DataFrame) -> DataFrame:
    profile = client_profile(main).select(
        "code_client", F.col("client_total_invoices").alias("nb_invoices"),
        F.col("client_total_products").alias("nb_products"))
    volume = main.groupBy("code_client").agg(
        F.sum("quantite").alias("total_qty"))
    return (profile.join(volume, "code_client")
            .join(client_cadence(main).drop("n_days"), "code_client"))


def sparsity(main: DataFrame) -> DataFrame:
    """Shape and fill of the client x product matrix, never materialised."""
    pairs = main.groupBy("code_client", "code_article").agg(
        F.sum("quantite").alias("_q"))
    cells = F.col("n_clients") * F.col("n_products")
    row = (pairs.agg(F.count_if(F.col("_q") > 0).alias("non_zero"))
           .withColumns({
               "n_clients": pairs.select("code_client").distinct()
               .agg(F.count("*")).scalar(),
               "n_products": pairs.select("code_article").distinct()
               .agg(F.count("*")).scalar()})
           .withColumn("total_cells", cells)
           .withColumn("zero_cells", cells - F.col("non_zero"))
           .withColumn("sparsity_pct", F.col("zero_cells") * 100.0 / cells))
    return row.withColumn("density_class", F.when(
        F.col("sparsity_pct") > 95, "very_sparse").when(
        F.col("sparsity_pct") > 80, "sparse").otherwise("dense"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair, in one pass."""
    names = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1:]]
    row = df.agg(*[F.corr(F.col(x).cast("double"), F.col(y).cast("double"))
                   .alias(f"{x}|{y}") for x, y in names])
    cells = F.array(*[F.struct(
        F.lit(x).alias("feature_x"), F.lit(y).alias("feature_y"),
        F.col(f"`{x}|{y}`").alias("corr")) for x, y in names])
    return row.select(F.inline(cells))


def histograms(df: DataFrame, ranges: dict[str, tuple[float, float, int]],
               ) -> DataFrame:
    """Bin counts of several columns, values clipped to (low, high)."""
    bins = []
    for name, (low, high, count) in ranges.items():
        value = qty.clip(F.col(name).cast("double"), low, high)
        width = (high - low) / count
        index = F.least(F.floor((value - low) / width),
                        F.lit(count - 1).cast("long"))
        bins.append(F.struct(
            F.lit(name).alias("column_name"), index.alias("bin"),
            (F.lit(float(low)) + index * width).alias("bin_start")))
    return (df.select(F.explode(F.array(*bins)).alias("b")).select("b.*")
            .filter(F.col("bin").isNotNull())
            .groupBy("column_name", "bin", "bin_start")
            .agg(F.count("*").alias("n")))


# -- activity series ---------------------------------------------------------

def activity(main: DataFrame, *keys) -> DataFrame:
    """Invoices, quantity, clients and lines per key.

    Lines are reduced to one row per (key, invoice, client) first, so the
    distinct counts run on invoices rather than lines.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    base = main.select(*[k.alias(n) for k, n in zip(keys, names)], *INVOICE,
                       "code_client", "quantite")
    per_invoice = base.groupBy(*names, *INVOICE, "code_client").agg(
        F.count("*").alias("_n"), F.sum("quantite").alias("_q"))
    return per_invoice.groupBy(*names).agg(
        F.countDistinct(*INVOICE).alias("nb_commandes"),
        F.sum("_q").alias("total_qte"),
        F.countDistinct("code_client").alias("nb_clients"),
        F.sum("_n").alias("nb_lignes"))


def monthly(main: DataFrame) -> DataFrame:
    return activity(main, F.col("annee"), F.col("mois")).withColumnsRenamed(
        {"_k0": "annee", "_k1": "mois"})


def weekly(main: DataFrame) -> DataFrame:
    """Weeks ending on Sunday from the first to the last, empty ones as 0."""
    seen = activity(main, cal.week_ending_sunday(F.col("date_commande")))
    seen = seen.withColumnRenamed("_k0", "week_end")
    spine = main.agg(
        F.min(cal.week_ending_sunday(F.col("date_commande"))).alias("a"),
        F.max(cal.week_ending_sunday(F.col("date_commande"))).alias("b"),
    ).select(F.explode(F.expr("sequence(a, b, interval 7 days)"))
             .alias("week_end"))
    return spine.join(seen, "week_end", "left").fillna(
        0, ["nb_commandes", "total_qte", "nb_clients", "nb_lignes"])


def day_coverage(main: DataFrame) -> DataFrame:
    days = main.select("date_commande").distinct()
    span = F.datediff("date_max", "date_min")
    return days.agg(
        F.count("*").alias("active_days"),
        F.min("date_commande").alias("date_min"),
        F.max("date_commande").alias("date_max"),
    ).withColumns({
        "calendar_days": span.cast("long"),
        "coverage_pct": F.col("active_days") * 100.0 / span,
        "days_without_orders": (span + 1 - F.col("active_days")).cast("long"),
        "weekend_days_estimate": (F.floor((span + 1) / 7) * 2).cast("long")})


def gap_days(main: DataFrame) -> DataFrame:
    """Calendar days between the first and last order without any order."""
    days = main.select(F.col("date_commande").alias("day")).distinct()
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(
        F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))
    return spine.join(days, "day", "left_anti")


def order_years(main: DataFrame) -> list[int]:
    """Years with orders, few by the calendar."""
    return sorted(r["annee"] for r in
                  main.select("annee").distinct().collect())


def month_year_pivot(main: DataFrame,
                     years: list[int] | None = None) -> DataFrame:
    """One pair of columns per year: those given, or all that have orders."""
    years = order_years(main) if years is None else years
    return monthly(main).groupBy("mois").pivot("annee", years).agg(
        F.max("nb_commandes").alias("cmd"), F.max("total_qte").alias("qte"))


def client_month_intensity(main: DataFrame) -> DataFrame:
    """Mean invoices per active client, by month."""
    orders = main.select("code_client", "annee_mois", *INVOICE).distinct()
    per_client = orders.groupBy("annee_mois", "code_client").agg(
        F.count("*").alias("_n"))
    return per_client.groupBy("annee_mois").agg(
        F.count("*").alias("active_clients"),
        F.avg("_n").alias("avg_orders_per_client"))


def active_clients(main: DataFrame) -> DataFrame:
    """Mean, extremes (earliest month on ties) and variation by month."""
    months = (main.select("annee_mois", "code_client").distinct()
              .groupBy("annee_mois").agg(F.count("*").alias("n")))
    return months.agg(
        F.avg("n").alias("mean_clients"), F.max("n").alias("max_clients"),
        F.min_by("annee_mois", F.struct(-F.col("n"), F.col("annee_mois")))
        .alias("max_month"),
        F.min("n").alias("min_clients"),
        F.min_by("annee_mois", F.struct("n", "annee_mois"))
        .alias("min_month"),
        (F.stddev_samp("n") / F.avg("n") * 100).alias("cov_pct"))


# -- top-k -------------------------------------------------------------------

def top_products(main: DataFrame, k: int = 15) -> DataFrame:
    return (main.groupBy("code_article", "designation")
            .agg(F.sum("quantite").alias("total_qty"))
            .orderBy(F.desc("total_qty"), "code_article", "designation")
            .limit(k)
            .withColumn("label", F.concat(
                F.col("code_article"), F.lit(" — "),
                F.substring("designation", 1, 30))))


def category_quantities(main: DataFrame) -> DataFrame:
    return main.groupBy("categorie").agg(
        F.sum("quantite").alias("total_qty"))


def top_lines(main: DataFrame, k: int = 20) -> DataFrame:
    return (main.select("code_facture", "societe", "code_article",
                        "designation", "quantite", "code_client")
            .orderBy(F.desc("quantite"), "code_facture", "societe",
                     "code_article").limit(k))


def pair_history(main: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Order lines of the given (or all) pairs with the pair's statistics.

    ``position`` numbers a pair's lines by date, invoice and company.
    """
    keys = ["code_client", "code_article"]
    rows = main if pairs is None else main.join(pairs, keys, "left_semi")
    stats = rows.groupBy(*keys).agg(
        F.min("quantite").alias("min_qty"), F.max("quantite").alias("max_qty"),
        F.avg("quantite").alias("avg_qty"),
        F.median("quantite").alias("median_qty"),
        F.stddev_pop("quantite").alias("std_qty"),
        F.max("date_commande").alias("last_date"))
    order = Window.partitionBy(*keys).orderBy(
        "date_commande", "code_facture", "societe", "quantite")
    return rows.select(
        *keys, "date_commande", "code_facture", "societe", "quantite",
        F.row_number().over(order).cast("long").alias("position")).join(
        stats, keys)


def outlier_weight(df: DataFrame, column: str, large: float = 20) -> DataFrame:
    """Share of the squared deviation that large orders cause."""
    x = F.col(column)
    mean = df.agg(F.avg(column)).scalar()
    rows = df.withColumn("_mean", mean).withColumn(
        "_square", (x - F.col("_mean")) * (x - F.col("_mean")))
    big = x >= large
    return rows.agg(
        F.count("*").alias("n_orders"), F.count_if(big).alias("n_large"),
        F.max("_mean").alias("mean_qty"),
        F.sum(F.when(big, F.col("_square"))).alias("square_large"),
        F.sum(F.when(~big, F.col("_square"))).alias("square_normal"),
    ).withColumn("large_vs_normal_pct",
                 F.col("square_large") / F.col("square_normal") * 100)
