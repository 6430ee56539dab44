"""Read the month-partitioned feedback table."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.schemas import FEEDBACK


def load_feedback(spark: SparkSession, path: str,
                  min_date: str | None = None) -> DataFrame:
    """All months, or those from ``min_date`` on; empty if nothing is stored.

    The folders are months of receipt, and ``submitted_at`` may lie before or
    (a client's clock ahead) after its folder's month.  So no folder is
    skipped; the filter on ``submitted_at`` reaches the files' statistics.
    """
    try:
        stored = spark.read.schema(FEEDBACK).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], FEEDBACK)
    if min_date is not None:
        stored = stored.filter(
            F.col("submitted_at") >= F.lit(min_date).cast("timestamp_ntz"))
    return stored


def union_months(*months: DataFrame) -> DataFrame:
    """Concatenate monthly tables whose columns may differ."""
    first, *rest = months
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
