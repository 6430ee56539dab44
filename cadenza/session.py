"""Session settings and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the jobs are designed for.  Broadcasts are left to the
# optimizer's size check and to adaptive execution, which also splits skewed
# join partitions; no job carries a broadcast hint on data that grows.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # merge a client's items into sessions before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition":
        "true",
}


def build_session(app: str = "cadenza", master: str | None = None,
                  **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(
            "set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="cadenza-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def write_by_key(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Write a table laid out by ``keys`` and read it back.

    The files are buckets, as many as a shuffle has partitions, and each is
    sorted.  Windows, groups and joins by the keys read them as they lie,
    without an exchange.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = os.path.basename(path).replace("-", "_")
    (df.repartition(buckets, *keys).write.option("path", path)
     .option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    return spark.table(table)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this job through Spark's own file system layer."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_files(table: DataFrame) -> None:
    """Delete the folders that a table of ``write_and_read`` was read from."""
    for folder in {os.path.dirname(f) for f in table.inputFiles()}:
        remove_folder(table.sparkSession, folder)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it.

    The files survive the loss of an executor, so a long consumer (iterative
    training, several reports on one table) never recomputes the producer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
