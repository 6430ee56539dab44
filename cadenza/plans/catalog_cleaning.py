"""Queries: extracts, cleaning, joins, sinks."""

from pyspark.sql import functions as F

from cadenza import schemas, session
from cadenza.operators import cleaning, joining, profiling, sampling
from cadenza.plans.registry import query
from cadenza.sources import quarantine, sinks


@query
def src_invoices(t):
    return t.raw_invoices()


@query
def src_lines(t):
    return t.raw_lines()


@query
def src_clients(t):
    return t.raw_clients()


@query
def csv_quarantine(t):
    """The lines as CSV files with broken rows: what is read and what not.

    By the hash of number and position a row gets a field too many, or a
    quantity or a line number that is none.
    """
    lines = t.raw_source_lines()
    draw = sampling.hash_number(F.coalesce("Document No_", F.lit("")),
                                F.coalesce("Line No_", F.lit(0)).cast(
                                    "string")) % 100
    cells = {c: F.col(f"`{c}`").cast("string") for c in lines.columns}
    cells["Quantity"] = F.when(draw.between(3, 5), "n/a").otherwise(
        cells["Quantity"])
    cells["Line No_"] = F.when(draw.between(6, 7), "x1").otherwise(
        cells["Line No_"])
    text = F.to_csv(F.struct(*[v.alias(c) for c, v in cells.items()]))
    path = session.scratch_path(t.spark, "csv-lines")
    lines.select(F.when(draw < 3, F.concat(text, F.lit(",more"))).otherwise(
        text).alias("value")).write.text(path)
    good, broken = quarantine.read_csv(t.spark, path, schemas.RAW_LINES,
                                       session.write_and_read)
    kept = good.agg(F.lit("read").alias("reason"), F.count("*").alias("n"),
                    F.sum("Quantity").alias("total_qty"))
    return kept.unionByName(broken.groupBy("reason").agg(
        F.count("*").alias("n"), F.lit(None).cast("double")
        .alias("total_qty")))


@query
def load_profile(t):
    return profiling.load_profile(t.raw_invoices(), t.raw_lines(),
                                  t.raw_clients())


@query
def dataset_overview(t):
    return profiling.overview(cleaning.clean_all(
        t.raw_invoices(), t.raw_lines(), t.raw_clients()))


@query
def write_roundtrip(t):
    """Write the clean lines partitioned by company, read them back."""
    path = session.scratch_path(t.spark, "lignes_clean")
    sinks.write_table(t.lines(), path, partition_by=["societe_ligne"])
    back = t.spark.read.schema(schemas.LINES).parquet(path)
    return back.groupBy("societe_ligne").agg(
        F.count("*").alias("n_rows"), F.sum("quantite").alias("total_qty"),
        F.countDistinct("code_article").alias("n_products"))


@query
def sample_preview(t):
    return sampling.preview(
        t.main(), ["code_facture", "societe", "code_article"], 50).select(
        "code_facture", "societe", "code_article", "code_client",
        "date_commande", "quantite")


@query
def clean_invoices(t):
    return t.invoices()


@query
def clean_lines(t):
    return t.lines()


@query
def clean_all(t):
    """Rows and totals of the three cleaned tables."""
    tables = cleaning.clean_all(t.raw_invoices(), t.raw_lines(),
                                t.raw_clients(), session.write_and_read)
    def measure(name, amount, keys):
        return tables[name].agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n_rows"),
            F.countDistinct(*keys).alias("n_keys"),
            F.round(F.sum(amount), 2).alias("amount"))
    return (measure("commandes_clean", F.col("mois").cast("double"),
                    ["code_facture", "societe"])
            .unionByName(measure("lignes_clean", "quantite",
                                 ["code_facture", "code_article"]))
            .unionByName(measure("gps_clean", "latitude", ["code_client"])))


@query
def calendar_parts(t):
    return t.invoices().groupBy(
        "annee", "mois", "annee_mois", "jour_semaine", "trimestre").agg(
        F.count("*").alias("n_invoices"))


@query
def dedup_lines(t):
    return cleaning.dedup_lines(cleaning.keyed_lines(t.raw_lines()))


@query
def impute_category(t):
    filled = cleaning.impute_category(
        cleaning.dedup_lines(cleaning.keyed_lines(t.raw_lines())),
        session.write_and_read)
    return (filled.withColumn("categorie",
                              F.coalesce("categorie", F.lit("UNKNOWN")))
            .groupBy("code_article", "categorie")
            .agg(F.count("*").alias("n_lines")))


@query
def bulk_flag(t):
    raw = t.raw_lines().withColumn("is_bulk_order", cleaning.bulk_flag())
    return raw.groupBy("code_article", "is_bulk_order").agg(
        F.count("*").alias("n_lines"), F.max("quantite").alias("max_qty"))


@query
def clean_audit(t):
    return cleaning.audit(t.raw_invoices(), t.raw_lines(), t.raw_clients(),
                          session.write_and_read)


@query
def uncategorised_by_invoice(t):
    return cleaning.uncategorised_by_invoice(t.raw_lines(),
                                             session.write_and_read)


@query
def main_table(t):
    return t.main().select(
        "code_facture", "societe", "code_article", "code_client",
        "date_commande", "ref_commercial", "designation", "categorie",
        "quantite", "is_bulk_order", "latitude", "longitude", "mois", "annee",
        "annee_mois", "jour_semaine", "trimestre")


@query
def join_coverage(t):
    return joining.coverage(t.lines(), t.invoices(), t.clients())


@query
def fanout_check(t):
    return joining.fanout(t.lines(), t.invoices())
