"""Joins of lines, invoices and coordinates.

No side carries a broadcast hint: the optimizer broadcasts what is small
enough by its own size check and otherwise sorts and merges, where adaptive
execution splits a key that dominates the line side.
"""

from pyspark.sql import DataFrame, functions as F


def lines_with_invoices(lines: DataFrame, invoices: DataFrame,
                        how: str = "inner") -> DataFrame:
    """Join on invoice number and company; neither alone is a key."""
    renamed = invoices.withColumnRenamed("code_facture", "_facture")
    joined = lines.join(
        renamed,
        (F.col("code_facture") == F.col("_facture"))
        & (F.col("societe_ligne") == F.col("societe")),
        how)
    return joined.withColumn(
        "_matched", F.col("_facture").isNotNull()).drop("_facture")


def main_table(lines: DataFrame, invoices: DataFrame,
               clients: DataFrame) -> DataFrame:
    """One row per line of a known invoice, with coordinates if any.

    Coordinates depend on the invoice, so they are joined to the invoices,
    a tenth of the lines, and the lines are shuffled once.
    """
    located = invoices.join(clients, ["code_client", "societe"], "left")
    return lines_with_invoices(lines, located).drop("_matched")


def coverage(lines: DataFrame, invoices: DataFrame,
             clients: DataFrame) -> DataFrame:
    """Left variant: how many lines find an invoice and coordinates."""
    joined = (lines_with_invoices(lines, invoices, "left")
              .join(clients, ["code_client", "societe"], "left"))
    return joined.agg(
        F.count("*").alias("lines_total"),
        F.count_if("_matched").alias("lines_with_invoice"),
        F.count_if(~F.col("_matched")).alias("lines_without_invoice"),
        F.count_if(F.col("latitude").isNotNull()).alias("lines_with_gps"),
        F.count_if(F.col("latitude").isNull()).alias("lines_without_gps"))


def fanout(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """Rows a join on the invoice number alone would yield, and the excess.

    Counting per number and company on each side first means the join sees
    one row per (number, company) instead of every line.
    """
    n_lines = (lines.groupBy("code_facture", "societe_ligne")
               .agg(F.count("*").alias("n_lines")))
    n_invoices = (invoices.groupBy("code_facture")
                  .agg(F.count("*").alias("n_invoices")))
    own = (invoices.groupBy("code_facture", "societe")
           .agg(F.count("*").alias("n_own"))
           .withColumnRenamed("societe", "societe_ligne"))
    pairs = (n_lines.join(n_invoices, "code_facture")
             .join(own, ["code_facture", "societe_ligne"], "left"))
    return pairs.agg(
        F.sum(F.col("n_lines") * F.col("n_invoices"))
        .alias("rows_on_number"),
        F.sum(F.col("n_lines") * F.coalesce("n_own", F.lit(0)))
        .alias("rows_on_number_and_company"),
    ).withColumn("rows_across_companies",
                 F.col("rows_on_number") - F.col("rows_on_number_and_company"))
