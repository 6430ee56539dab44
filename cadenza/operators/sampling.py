"""Deterministic samples and never-bought pairs."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza import constants as C
from cadenza.functions import calendar as cal
from cadenza.operators.ordered import ranked


def hash_number(*columns) -> Column:
    """48-bit number from md5, equal in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 12),
                  16, 10).cast("long")


def preview(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """``rows`` rows drawn by the hash of their key; a top-k, not a sort."""
    return (df.withColumn("_draw", hash_number(*key))
            .orderBy("_draw", *key).limit(rows).drop("_draw"))


def negative_pairs(matrix: DataFrame,
                   per_positive: int = C.NEGATIVES_PER_POSITIVE) -> DataFrame:
    """Per client ``per_positive`` never-bought products per bought product.

    Products get a position by hash.  A client with n products walks
    (per_positive + 1) * n consecutive positions from its own hashed start,
    wrapping around: at most n of them are bought, so enough remain without
    pairing every client with every product.
    """
    known = matrix.select("code_client", "code_article")
    products = ranked(
        known.select("code_article").distinct()
        .withColumn("_draw", hash_number("code_article")),
        "_draw", "code_article", "_rank")
    products = products.select("code_article",
                               (F.col("_rank") - 1).alias("_position"))
    size = products.agg(F.count("*").alias("_size"))
    clients = known.groupBy("code_client").agg(F.count("*").alias("_n"))
    walk = (clients.withColumn("_size", size.scalar())
            .withColumn("_start", F.pmod(hash_number("code_client"),
                                         F.col("_size")))
            .withColumn("_steps", F.least(
                F.col("_n") * (per_positive + 1), F.col("_size")))
            .select("code_client", "_n", "_start", "_size",
                    F.explode(F.sequence(F.lit(0).cast("long"),
                                         F.col("_steps") - 1)).alias("_step"))
            .withColumn("_position", F.pmod(
                F.col("_start") + F.col("_step"), F.col("_size"))))
    fresh = (walk.join(products, "_position")
             .join(known, ["code_client", "code_article"], "left_anti"))
    order = Window.partitionBy("code_client").orderBy("_step")
    return (fresh.withColumn("_pick", F.row_number().over(order))
            .filter(F.col("_pick") <= F.col("_n") * per_positive)
            .select("code_client", "code_article"))


def negative_features(pairs: DataFrame, matrix: DataFrame,
                      reference_date: str) -> DataFrame:
    """Client and product attributes plus the defaults of a missing history."""
    client_columns = [
        "has_gps", "latitude", "longitude", "client_total_products",
        "client_total_invoices", "client_avg_basket_size"]
    product_columns = [
        "categorie", "designation", "is_bulk_product", "nb_clients",
        "days_since_first_order", "is_new_product"]
    clients = matrix.groupBy("code_client").agg(
        F.min_by("company_encoded", "code_article").alias("company_encoded"),
        *[F.max(c).alias(c) for c in client_columns])
    products = matrix.groupBy("code_article").agg(
        *[F.max(c).alias(c) for c in product_columns])
    zeros = ["avg_qty", "median_qty", "std_qty", "min_qty", "max_qty",
             "total_qty", "last_qty", "trend"]
    month = F.month(F.lit(reference_date).cast("date"))
    defaults = {c: F.lit(0.0) for c in zeros} | {
        "frequency": F.lit(0).cast("long"),
        "recency_days": F.lit(C.NEGATIVE_RECENCY_DAYS),
        "avg_delay_days": F.lit(C.NEGATIVE_GAP_DAYS),
        "recency_relative": F.lit(C.NEGATIVE_RECENCY_DAYS
                                  / C.NEGATIVE_GAP_DAYS),
        "current_month_coef": cal.season_coefficient(month),
        "avg_seasonal_coef": F.lit(1.0),
        "best_month": F.lit(-1),
    }
    return (pairs.join(clients, "code_client", "left")
            .join(products, "code_article", "left")
            .withColumns(defaults).select(*matrix.columns))


def client_bucket(client: Column, seed: int, buckets: int = 1000) -> Column:
    """Stable bucket of a client; all its rows share it."""
    return F.pmod(hash_number(client, F.lit(str(seed))), F.lit(buckets))
