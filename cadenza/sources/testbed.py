"""Express the shared test tables as the raw extracts.

The test tables are clean; the adapter derives the faults the jobs must handle
(missing keys, padded text, missing categories, returns, bulk lines, one
invoice number used by three companies, products launched near the end) from
key arithmetic, so any engine can rebuild the same rows.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

COMPANIES = ["CO1", "CO2", "CO3"]
REFERENCE_DATE = "2001-08-02"
TRAIN_CUTOFF = "2000-06-30"
VALIDATION_CUTOFF = "2000-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _company(key):
    return F.element_at(F.array(*[F.lit(c) for c in COMPANIES]),
                        (F.pmod(key, F.lit(3)) + 1).cast("int"))


def _number(key):
    return F.concat(F.lit("F"), F.floor(key / 3).cast("string"))


def _null_when(condition, value):
    return F.when(~condition, value)


def _launch_order(key):
    return key % 50 == 7


def raw_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    client = F.concat(
        F.lit("C"), F.col("o_custkey").cast("string"),
        F.when(key % 7 == 0, F.lit(" ")).otherwise(F.lit("")))
    return table(spark, sf_dir, "orders").select(
        _number(key).alias("No_"),
        _null_when(key % 101 == 0, client).alias("client_code"),
        F.when(_launch_order(key),
               F.date_add(F.lit("2001-06-01").cast("date"),
                          (key % 60).cast("int")).cast("timestamp_ntz"))
        .otherwise(F.col("o_orderdate")).alias("Posting Date"),
        F.concat("o_orderpriority", F.lit(" ")).alias("Salesperson Code"),
        _company(key).alias("company"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    quantity = (F.when(part % 97 == 0, F.lit(0.0))
                .when(part % 89 == 0, -F.col("l_quantity"))
                .when(part % 83 == 0, F.col("l_quantity") * 50)
                .otherwise(F.col("l_quantity")))
    category = (F.when(part % 5 == 0,
                       F.concat(F.lower("p_type"), F.lit(" ")))
                .otherwise(F.col("p_type")))
    product = (F.when(_launch_order(order) & (part % 4 == 1),
                      F.concat(F.lit("New#"), (part % 3).cast("string")))
               .otherwise(F.col("p_brand")))
    no_category = (part % 37 == 0) | (F.col("p_brand") == "Brand#25")
    return lines.join(parts, part == F.col("p_partkey")).select(
        _null_when(part % 499 == 0, _number(order)).alias("Document No_"),
        quantity.alias("Quantity"),
        _null_when(part % 211 == 5, product).alias("code_article"),
        _null_when(part % 41 == 0, F.col("p_name"))
        .alias("designation_article"),
        _null_when(no_category, category).alias("Item Category Code"),
        _null_when(part % 307 == 0, _company(order)).alias("company"),
        F.col("l_linenumber").cast("long").alias("Line No_"),
    )


def raw_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    known = F.col("c_acctbal") >= 0
    return table(spark, sf_dir, "customer").select(
        _null_when(key % 500 == 499,
                   F.concat(F.lit("C"), key.cast("string")))
        .alias("clientCode"),
        _company(key).alias("company"),
        F.when(known, 30 + (key * 37 % 1000) / 100).alias("lat"),
        F.when(known, 8 + (key * 91 % 700) / 100).alias("lng"),
    )


def raw_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_requests(table(spark, sf_dir, "events"))


def feedback_requests(events: DataFrame) -> DataFrame:
    """One request per event, with one or two items; batch or stream."""
    event, value = F.col("event_id"), F.col("value")
    first = F.struct(
        F.col("event_type").alias("code_article"),
        (F.col("event_type") == "purchase").alias("accepte"),
        F.ceil(value).cast("int").alias("quantite_finale"),
        (event % 4 == 0).alias("modifie"))
    second = F.struct(
        F.concat(F.lit("Brand#"), (event % 25 + 1).cast("string"))
        .alias("code_article"),
        (value > 20).alias("accepte"),
        F.floor(value).cast("int").alias("quantite_finale"),
        (event % 5 == 0).alias("modifie"))
    return events.select(
        F.concat(F.lit("C"), F.col("user_id").cast("string"))
        .alias("client_id"),
        F.concat(F.lit("R"), (event % 9).cast("string"))
        .alias("commercial_id"),
        F.when(event % 2 == 0, F.concat(F.lit("F"), event.cast("string")))
        .alias("code_facture"),
        F.when(event % 6 != 0, F.col("ts")).alias("submitted_at"),
        F.col("ts").alias("received_at"),
        F.when(event % 3 == 0, F.array(first, second))
        .otherwise(F.array(first)).alias("items"),
    )
