"""CSV extracts with broken rows: good rows on, broken ones aside.

A row is read permissively; what does not fit the schema is kept as it was
delivered, with its file and a reason, instead of becoming nulls in silence
or ending the job.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

RAW = "_raw_row"
FIELDS = "number of fields"


def reason(raw: Column, schema: StructType) -> Column:
    """The number of fields, or the first column whose text does not fit."""
    as_text = ", ".join(f"`{n}` string" for n in [*schema.names, RAW])
    text = F.from_csv(raw, as_text, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW})
    found = F.when(text[RAW].isNotNull(), F.lit(FIELDS))
    for f in schema.fields:
        value = text[f.name]
        if not isinstance(f.dataType, StringType):
            found = found.when(
                value.isNotNull() & value.try_cast(f.dataType).isNull(),
                F.lit(f"{f.name} is no {f.dataType.simpleString()}"))
    return found.otherwise(F.lit("unreadable"))


def read_csv(spark: SparkSession, path: str, schema: StructType,
             stage, **options: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine) of the CSV files at ``path``.

    The quarantine has file, reason and raw_row.  ``stage`` writes the rows
    once, as both tables need them; the files are parsed in one pass.
    """
    full = StructType([*schema.fields, StructField(RAW, StringType())])
    rows = (spark.read.schema(full).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", RAW).options(**options)
            .csv(path).select("*", F.col("_metadata.file_name")
                              .alias("_file")))
    rows = stage(rows, "csv-rows")
    good = rows.filter(F.col(RAW).isNull()).drop(RAW, "_file")
    broken = rows.filter(F.col(RAW).isNotNull()).select(
        F.col("_file").alias("file"), reason(F.col(RAW), schema)
        .alias("reason"), F.col(RAW).alias("raw_row"))
    return good, broken
