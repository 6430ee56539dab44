"""Load the three raw extracts and give them canonical column names.

The names on the left are fixed by the delivered files.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cadenza import schemas

INVOICE_NAMES = {
    "No_": "code_facture",
    "client_code": "code_client",
    "Posting Date": "date_commande",
    "Salesperson Code": "ref_commercial",
    "company": "societe",
}
LINE_NAMES = {
    "Document No_": "code_facture",
    "Quantity": "quantite",
    "designation_article": "designation",
    "Item Category Code": "categorie",
    "company": "societe_ligne",
    "Line No_": "numero_ligne",
}
CLIENT_NAMES = {
    "clientCode": "code_client",
    "company": "societe",
    "lat": "latitude",
    "lng": "longitude",
}


class MissingInput(FileNotFoundError):
    """An input table or one of its required columns is absent."""


def read_table(spark: SparkSession, path: str, schema: StructType,
               fmt: str = "parquet", **options: str) -> DataFrame:
    """Read with an explicit schema; a missing path is a clear error."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        options = {"header": "true", **options}
    try:
        return reader.options(**options).format(fmt).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise MissingInput(f"input table not found: {path}") from error
        raise


def require_columns(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingInput(f"{table} lacks columns {missing}")
    return df


def optional_column(df: DataFrame, name: str, default) -> DataFrame:
    """Keep ``name`` if present, else add it with a constant."""
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def name_invoices(raw: DataFrame) -> DataFrame:
    return (raw.withColumnsRenamed(INVOICE_NAMES)
            .withColumn("date_commande", F.col("date_commande").cast("date")))


def name_lines(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(LINE_NAMES)


def name_clients(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(CLIENT_NAMES)


def load_invoices(spark, path, fmt="parquet", **options) -> DataFrame:
    return name_invoices(
        read_table(spark, path, schemas.RAW_INVOICES, fmt, **options))


def load_lines(spark, path, fmt="parquet", **options) -> DataFrame:
    return name_lines(
        read_table(spark, path, schemas.RAW_LINES, fmt, **options))


def load_clients(spark, path, fmt="parquet", **options) -> DataFrame:
    return name_clients(
        read_table(spark, path, schemas.RAW_CLIENTS, fmt, **options))
