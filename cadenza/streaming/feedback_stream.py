"""Feedback as a stream: ingest, rates per window, sessions, pair state.

State is kept by Spark's own streaming aggregations, which combine on the map
side, so one client or product sending most of the feed adds rows to a partial
sum and not to one task's input.  Late data is bounded by a watermark and every
job restarts from its checkpoint.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cadenza.operators import feedback
from cadenza.session import scratch_path

WATERMARK = "2 days"


def read_feed(spark: SparkSession, folder: str, schema: StructType,
              pattern: str = "*.parquet", files_per_batch: int = 1000,
              ) -> DataFrame:
    """Parquet files of a folder as a stream; new files become new batches."""
    return (spark.readStream.schema(schema)
            .option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def run_to_files(stream: DataFrame, path: str, name: str,
                 partition_by: list[str] | None = None) -> None:
    """Process what has arrived, append to files, and stop."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", f"{path}-checkpoint")
              .trigger(availableNow=True).queryName(name))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(path).awaitTermination()


def run_updates(stream: DataFrame, path: str, name: str) -> None:
    """Write the changed rows of every batch below its batch number.

    Rewriting a batch replaces its folder, so a restart does not double it.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    (stream.writeStream.outputMode("update").foreachBatch(write)
     .option("checkpointLocation", f"{path}-checkpoint")
     .trigger(availableNow=True).queryName(name).start().awaitTermination())


def ingest(requests: DataFrame, path: str) -> None:
    """Flatten requests into the month-partitioned feedback table."""
    run_to_files(feedback.flatten(requests), path, "feedback_ingest",
                 ["date_visite_mois"])


def _watermarked(rows: DataFrame, watermark: str) -> DataFrame:
    """Event time as the zoned type watermarks require.

    Days are cut in UTC, so run with a UTC session as ``build_session`` does.
    """
    return rows.withColumn(
        "submitted_at", F.col("submitted_at").cast("timestamp")).withWatermark(
        "submitted_at", watermark)


def _local(column: str, name: str):
    return F.col(column).cast("timestamp_ntz").alias(name)


def window_rates(rows: DataFrame, width: str, slide: str | None = None,
                 watermark: str | None = WATERMARK) -> DataFrame:
    """Acceptance per tumbling or sliding window, batch or stream."""
    if watermark:
        rows = _watermarked(rows, watermark)
    span = F.window("submitted_at", width, slide or width)
    return feedback.acceptance(rows, span.alias("w")).select(
        _local("w.start", "window_start"), _local("w.end", "window_end"),
        "n_items", "n_accepted",
        "n_modified", "acceptance_rate")


def sessions(rows: DataFrame, gap: str = "6 hours",
             watermark: str = WATERMARK) -> DataFrame:
    """Visit sessions on the stream; see ``feedback.sessions`` for batch."""
    rows = _watermarked(rows, watermark)
    span = F.session_window("submitted_at", gap)
    return rows.groupBy("client_id", span.alias("w")).agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("accepte")).alias("n_accepted")).select(
        "client_id", _local("w.start", "session_start"),
        _local("w.end", "session_end"), "n_items", "n_accepted")


def drop_resubmissions(rows: DataFrame,
                       watermark: str = WATERMARK) -> DataFrame:
    return _watermarked(rows, watermark).dropDuplicatesWithinWatermark(
        ["client_id", "code_facture", "code_article", "submitted_at"])


def pair_state(rows: DataFrame) -> DataFrame:
    """Running count, quantity, last day and mean gap per pair.

    Gaps between consecutive orders add up to last minus first day, so three
    running aggregates replace a hand-written state machine.
    """
    day = F.to_date("submitted_at")
    state = rows.groupBy("client_id", "code_article").agg(
        F.count("*").alias("n_orders"),
        F.sum("quantite_finale").alias("total_qty"),
        F.min(day).alias("first_date"), F.max(day).alias("last_date"))
    return state.withColumn("avg_gap_days", F.when(
        F.col("n_orders") > 1, F.datediff("last_date", "first_date")
        / (F.col("n_orders") - 1)))


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """Newest written state of every pair."""
    updates = spark.read.parquet(path)
    columns = [c for c in updates.columns
               if c not in ("client_id", "code_article", "batch")]
    return updates.groupBy("client_id", "code_article").agg(
        F.max_by(F.struct(*columns), "batch").alias("_s")).select(
        "client_id", "code_article", "_s.*")


def new_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream-{name}")
