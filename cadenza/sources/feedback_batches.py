"""A feedback store that takes batches again and reads only what it must.

A batch lies below its number in each month's folder, and writing it again
replaces it.  Beside the store a small table of ranges says for every month
and batch which times of submission it holds; a batch counts from the moment
its ranges are written.  A load from a date on reads the folders whose range
reaches that date.  Compaction writes a month's batches as one, whose ranges
name the batches it stands for.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.schemas import FEEDBACK

MONTH = "date_visite_mois"
RANGE = ("date_visite_mois string, batch string, low timestamp_ntz, "
         "high timestamp_ntz, replaces array<string>")


def _ranges_path(path: str) -> str:
    return f"{path}-ranges"


def _write(rows: DataFrame, path: str, batch: str,
           replaces: list[str]) -> None:
    (rows.withColumn("batch", F.lit(batch)).hint("rebalance", MONTH)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(MONTH, "batch").parquet(path))
    (rows.groupBy(MONTH).agg(
        F.min("submitted_at").alias("low"),
        F.max("submitted_at").alias("high"))
     .withColumn("replaces", F.array(*[F.lit(b) for b in replaces]).cast(
         "array<string>")).withColumn("batch", F.lit(batch)).coalesce(1)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").parquet(_ranges_path(path)))


def put(rows: DataFrame, path: str, batch: int) -> None:
    """Store a batch; the same number replaces what it held before."""
    _write(rows, path, f"b{batch}", [])


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """Months and batches that count; empty if nothing is stored."""
    try:
        found = spark.read.schema(RANGE).parquet(_ranges_path(path))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], RANGE)
    gone = found.select(MONTH, F.explode("replaces").alias("batch"))
    return found.join(gone, [MONTH, "batch"], "left_anti")


def load(spark: SparkSession, path: str,
         min_date: str | None = None) -> DataFrame:
    """Rows submitted from ``min_date`` on, from the folders that have any.

    Folders are collected, not rows: months times batches, which compaction
    keeps few.
    """
    wanted = ranges(spark, path)
    if min_date is not None:
        limit = F.lit(min_date).cast("timestamp_ntz")
        wanted = wanted.filter(F.col("high") >= limit)
    folders = [f"{path}/{MONTH}={r[MONTH]}/batch={r['batch']}"
               for r in wanted.select(MONTH, "batch").collect()]
    if not folders:
        return spark.createDataFrame([], FEEDBACK)
    rows = spark.read.schema(FEEDBACK).option("basePath", path).parquet(
        *folders).select(*FEEDBACK.fieldNames())
    return rows if min_date is None else rows.filter(
        F.col("submitted_at") >= limit)


def compact(spark: SparkSession, path: str, month: str) -> None:
    """Write the batches of a month as one; the old files stay unread."""
    parts = ranges(spark, path).filter(F.col(MONTH) == month).select(
        "batch").orderBy("batch").collect()
    names = [r["batch"] for r in parts]
    if len(names) < 2:
        return
    rows = spark.read.schema(FEEDBACK).option("basePath", path).parquet(
        *[f"{path}/{MONTH}={month}/batch={b}" for b in names]).select(
        *FEEDBACK.fieldNames())
    _write(rows, path, f"c{month}-{len(names)}-{names[-1]}", names)
