"""Cleaning of invoices, order lines and client coordinates."""

from pyspark.sql import DataFrame, Window, functions as F

from cadenza import constants as C
from cadenza.functions import calendar as cal

LINE_KEY = ["code_facture", "societe_ligne", "code_article"]

# Position of a line in its file, if the extract has it.
LINE_NUMBER = "numero_ligne"
# Copies of a key are interchangeable up to these columns.
LINE_ORDER = ["quantite", "designation", "categorie"]


def trim_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Trim present columns; NULL stays NULL."""
    return df.withColumns({
        c: F.trim(F.col(c).cast("string")) for c in columns if c in df.columns})


def add_calendar(df: DataFrame, day: str = "date_commande") -> DataFrame:
    d = F.col(day)
    return df.withColumns({
        "mois": cal.month(d),
        "annee": F.year(d),
        "annee_mois": cal.year_month(d),
        "jour_semaine": cal.weekday_from_monday(d),
        "trimestre": F.quarter(d),
    })


def clean_invoices(raw: DataFrame) -> DataFrame:
    kept = raw.dropna(subset=["code_facture", "code_client"])
    return add_calendar(trim_text(
        kept, ["code_facture", "code_client", "ref_commercial", "societe"]))


def dedup_lines(lines: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One line per (invoice, company, product): the first of its copies.

    First is the lowest line number.  Lines without one, or equal in it, are
    ordered by ``LINE_ORDER`` with positive quantities before zeros and
    returns, so that a return never stands for a sale.

    Filtering the row number to 1 lets Spark keep one row per key in every
    map task before the shuffle, so a heavily copied key stays small.  Pass
    ``key=["code_facture", "code_article"]`` to ignore the company.
    """
    number = [LINE_NUMBER] if LINE_NUMBER in lines.columns else []
    sale = F.coalesce(F.col("quantite") > 0, F.lit(False))
    window = Window.partitionBy(*(key or LINE_KEY)).orderBy(
        *[F.col(c).asc_nulls_last() for c in number], sale.desc(),
        *[F.col(c).asc_nulls_last() for c in LINE_ORDER])
    return (lines.withColumn("_copy", F.row_number().over(window))
            .filter(F.col("_copy") == 1).drop("_copy"))


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent non-null ``value`` per ``key``; ties take the smallest.

    Counting first shrinks a hot key to one row per distinct value before the
    pick, and both steps combine on the map side.
    """
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(key, value).agg(F.count("*").alias("_n")))
    return counts.groupBy(key).agg(
        F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value)))
        .alias(f"{value}_mode"))


def _lazy(df: DataFrame, name: str) -> DataFrame:
    return df


def impute_category(lines: DataFrame, stage=_lazy) -> DataFrame:
    """Fill a missing category from the product's most frequent one.

    Runs on the text as delivered, before trimming and upper-casing, so
    spelling variants count separately.  With ``stage=write_and_read`` the
    lines are deduplicated once although they are read twice, and the category
    table has a known size: small, it is broadcast and the lines are not
    shuffled by product; large, it is merged.
    """
    lines = stage(lines, "unique-lines")
    modes = stage(most_frequent(lines, "code_article", "categorie"),
                  "category-modes")
    return (lines.join(modes, "code_article", "left")
            .withColumn("categorie", F.coalesce("categorie", "categorie_mode"))
            .drop("categorie_mode"))


def keyed_lines(raw: DataFrame) -> DataFrame:
    return raw.dropna(subset=["code_facture", "code_article"])


def clean_lines(raw: DataFrame, key: list[str] | None = None,
                stage=_lazy) -> DataFrame:
    lines = impute_category(dedup_lines(keyed_lines(raw), key), stage)
    lines = lines.withColumns({
        "categorie": F.coalesce("categorie", F.lit(C.UNKNOWN_CATEGORY)),
        "designation": F.coalesce("designation", "code_article"),
    })
    lines = trim_text(lines, ["code_facture", "code_article", "designation",
                              "categorie", "societe_ligne"])
    return (lines
            .withColumn("categorie", F.upper("categorie"))
            .withColumn("is_bulk_order", bulk_flag())
            .filter(F.col("quantite") > 0).drop(LINE_NUMBER))


def bulk_flag(threshold: float = C.BULK_QUANTITY):
    return F.coalesce(F.col("quantite") > threshold, F.lit(False))


def clean_clients(raw: DataFrame) -> DataFrame:
    return trim_text(raw.dropna(subset=["code_client"]),
                     ["code_client", "societe"])


def clean_all(invoices: DataFrame, lines: DataFrame, clients: DataFrame,
              stage=_lazy) -> dict[str, DataFrame]:
    return {
        "commandes_clean": clean_invoices(invoices),
        "lignes_clean": clean_lines(lines, stage=stage),
        "gps_clean": clean_clients(clients),
    }


def audit(raw_invoices: DataFrame, raw_lines: DataFrame,
          raw_clients: DataFrame, stage=_lazy) -> DataFrame:
    """One row per table: rows read, dropped, copies, filled, kept."""
    def invoice_like(df, table, keys):
        keyed = F.lit(True)
        for k in keys:
            keyed = keyed & F.col(k).isNotNull()
        return df.agg(
            F.count("*").alias("rows_read"),
            F.count_if(~keyed).alias("rows_without_key"),
            F.count_if(keyed).alias("rows_kept"),
        ).select(
            F.lit(table).alias("table_name"), "rows_read", "rows_without_key",
            F.lit(0).cast("long").alias("copies_removed"),
            F.lit(0).cast("long").alias("categories_missing"),
            F.lit(0).cast("long").alias("categories_unknown"),
            F.lit(0).cast("long").alias("designations_missing"),
            F.lit(0).cast("long").alias("quantities_rejected"), "rows_kept")

    keyed = keyed_lines(raw_lines)
    unique = dedup_lines(keyed)
    filled = impute_category(unique.withColumn(
        "_no_category", F.col("categorie").isNull()), stage)
    after = filled.agg(
        F.count("*").alias("unique_rows"),
        F.count_if("_no_category").alias("categories_missing"),
        F.count_if(F.col("categorie").isNull()).alias("categories_unknown"),
        F.count_if(F.col("designation").isNull()).alias("designations_missing"),
        F.count_if(~F.coalesce(F.col("quantite") > 0, F.lit(False)))
        .alias("quantities_rejected"))
    has_key = (F.col("code_facture").isNotNull()
               & F.col("code_article").isNotNull())
    before = raw_lines.agg(
        F.count("*").alias("rows_read"),
        F.count_if(has_key).alias("keyed_rows"))
    lines = (after
             .withColumn("rows_read", before.select("rows_read").scalar())
             .withColumn("keyed_rows", before.select("keyed_rows").scalar())
             .select(
                 F.lit("lignes").alias("table_name"), "rows_read",
                 (F.col("rows_read") - F.col("keyed_rows"))
                 .alias("rows_without_key"),
                 (F.col("keyed_rows") - F.col("unique_rows"))
                 .alias("copies_removed"),
                 "categories_missing", "categories_unknown",
                 "designations_missing", "quantities_rejected",
                 (F.col("unique_rows") - F.col("quantities_rejected"))
                 .alias("rows_kept")))
    return (invoice_like(raw_invoices, "commandes",
                         ["code_facture", "code_client"])
            .unionByName(lines)
            .unionByName(invoice_like(raw_clients, "gps", ["code_client"])))


def uncategorised_by_invoice(raw_lines: DataFrame,
                             stage=_lazy) -> DataFrame:
    """Lines whose product has no known category, one row per invoice.

    Copies are removed first, so the joined text holds at most one entry per
    product of the invoice.
    """
    left = (impute_category(dedup_lines(keyed_lines(raw_lines)), stage)
            .filter(F.col("categorie").isNull()))
    return left.groupBy("code_facture").agg(
        F.min("societe_ligne").alias("company"),
        F.count("*").alias("nb_lignes"),
        F.array_join(F.sort_array(F.collect_list("designation")), " | ")
        .alias("designation"))
