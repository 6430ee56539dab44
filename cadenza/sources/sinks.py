"""Table writers."""

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Replace a stage table; partition columns become folders.

    Rows are rebalanced on the partition columns first: adaptive execution
    merges small folders' rows into few files and splits a large folder over
    as many writers as its size needs.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_by_month(df: DataFrame, path: str,
                    month_column: str = "date_visite_mois") -> None:
    """Append rows below one folder per month, rebalanced as above."""
    (df.hint("rebalance", month_column)
     .write.mode("append").partitionBy(month_column).parquet(path))
