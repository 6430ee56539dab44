"""Features of a client or a product."""

from pyspark.sql import DataFrame, functions as F

from cadenza import constants as C
from cadenza.operators.cleaning import most_frequent


def client_geo(main: DataFrame) -> DataFrame:
    """First known coordinates of a client, by company name, and has_gps."""
    located = F.when(F.col("latitude").isNotNull(), F.struct(
        "societe", "latitude", "longitude"))
    return (main.groupBy("code_client").agg(F.min(located).alias("_at"))
            .select("code_client", F.col("_at.latitude").alias("latitude"),
                    F.col("_at.longitude").alias("longitude"),
                    F.col("_at.latitude").isNotNull().alias("has_gps")))


def client_profile(main: DataFrame) -> DataFrame:
    """Distinct products and invoices, mean distinct products per invoice.

    Two rounds of distinct rows: (client, invoice, product), whose counts
    give the basket, and (client, product).  A client holding a large part of
    all lines is reduced on the map side in both.
    """
    items = main.select("code_client", "code_facture", "societe",
                        "code_article").distinct()
    baskets = items.groupBy("code_client", "code_facture", "societe").agg(
        F.count("*").alias("_items"))
    orders = baskets.groupBy("code_client").agg(
        F.count("*").alias("client_total_invoices"),
        F.avg("_items").alias("client_avg_basket_size"))
    products = (main.select("code_client", "code_article").distinct()
                .groupBy("code_client")
                .agg(F.count("*").alias("client_total_products")))
    return products.join(orders, "code_client")


def product_profile(main: DataFrame, reference_date: str) -> DataFrame:
    """Designation, category, bulk flag, reach and age of every product.

    Lines are reduced per (product, client, designation) and per (product,
    category) before any product-level step, so a product sold on a third of
    all lines costs a few rows per client.
    """
    per_client = main.groupBy("code_article", "code_client").agg(
        F.min(F.struct("date_commande", "designation")).alias("_first"),
        F.max(F.col("is_bulk_order").cast("int")).alias("_bulk"))
    products = per_client.groupBy("code_article").agg(
        F.min("_first").alias("_first"),
        (F.max("_bulk") == 1).alias("is_bulk_product"),
        F.count("*").alias("nb_clients"))
    category = most_frequent(main, "code_article", "categorie")
    age = F.datediff(F.lit(reference_date).cast("date"),
                     F.col("_first.date_commande"))
    return (products.join(category, "code_article", "left")
            .select(
                "code_article",
                F.coalesce("categorie_mode", F.lit(C.UNKNOWN_CATEGORY))
                .alias("categorie"),
                F.col("_first.designation").alias("designation"),
                "is_bulk_product", "nb_clients",
                age.alias("days_since_first_order"),
                (age <= C.NEW_PRODUCT_DAYS).alias("is_new_product")))
