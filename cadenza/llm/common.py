"""Staged tables, global numbering and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from cadenza.session import scratch_path

#: Bytes of text handled at once in a Python task.
BATCH_BYTES = 4 << 20
#: Rows of a few numbers that may be broadcast, about 50 MB.
BROADCAST_ROWS = 1_000_000


class Scratch:
    """Tables in the shared folder that end with the job that wrote them.

    ``with Scratch(spark) as scratch`` removes on exit every table written by
    ``stage`` that was not marked by ``keep``.  Kept tables back a returned
    lazy result; they stay until the user removes them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for path in self._paths:
            remove(self.spark, path)
        self._paths = []

    def path(self, name: str) -> str:
        path = scratch_path(self.spark, name)
        self._paths.append(path)
        return path

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` to the shared folder and read it back."""
        return written(df, self.path(name))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        if Kept.open:
            Kept.open[-1].paths.append(path)
        return written(df, path)


class Kept:
    """``with Kept(spark):`` removes on exit what ``keep`` wrote inside.

    For a caller that writes the lazy result before the end.
    """
    open: list[Kept] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Kept:
        Kept.open.append(self)
        return self

    def __exit__(self, *error) -> None:
        Kept.open.remove(self)
        for path in self.paths:
            remove(self.spark, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as read back from Parquet files at ``path``."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this job through Spark's own file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(
        spark._jsc.hadoopConfiguration()).delete(target, True)


def map_arrow(df: DataFrame, schema: StructType | str,
              rows: Callable[[pa.RecordBatch], dict[str, list]],
              setup: Callable[[], Callable] | None = None) -> DataFrame:
    """``mapInArrow`` that gives ``rows`` pieces of about BATCH_BYTES.

    ``setup`` runs once per task and returns the function for the pieces.
    """
    names = ([f.name for f in schema.fields] if isinstance(schema, StructType)
             else [part.split()[0] for part in schema.split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup() if setup else rows
        for batch in batches:
            for piece in pieces(batch):
                made = work(piece)
                if isinstance(made, dict):
                    made = pa.RecordBatch.from_arrays(
                        [made[n] if isinstance(made[n], pa.Array)
                         else pa.array(made[n]) for n in names], names)
                if made.num_rows:
                    yield made
    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds about BATCH_BYTES, or one row."""
    rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table, to be broadcast if it has few rows.

    Beyond ``most`` rows the join shuffles both sides.
    """
    return F.broadcast(df) if df.count() <= most else df


def unused(taken: list[str], *names: str) -> list[str]:
    """``names`` with underscores before them until none is in ``taken``."""
    taken, found = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def number_rows(scratch: Scratch, df: DataFrame, order: list[Column],
                name: str, groups: list[str] | None = None) -> DataFrame:
    """Add the long column ``name``: 0, 1, .. in ``order``, per group.

    The rows are range-partitioned and written; the counts of each partition
    and group give offsets by a prefix sum over those counts, and a row's
    number is its offset plus its place in its partition.  A group of any
    size is spread over as many partitions as its rows need.
    """
    groups = groups or []
    keys = [F.col(g) for g in groups]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (df.repartitionByRange(parts, *keys, *order)
              .sortWithinPartitions(*keys, *order)
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = scratch.stage(placed, name).withColumns({
        "_part": F.shiftright("_at", 33),
        "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = scratch.stage(
        placed.groupBy("_part", *groups).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first")),
        name + "-counts")
    earlier = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    if groups:
        earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)
    # one row per task and group in it
    offsets = counts.select(
        "_part", *groups, (F.coalesce(F.sum("_n").over(earlier), F.lit(0))
                           - F.col("_first")).alias("_offset"))
    on = F.col("l._part") == F.col("r._part")
    for g in groups:
        on = on & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    return (placed.alias("l").join(F.broadcast(offsets).alias("r"), on)
            .select(*[F.col(f"l.`{c}`") for c in df.columns],
                    (F.col("l._place") + F.col("r._offset")).alias(name)))


def connected_components(scratch: Scratch, links: DataFrame,
                         a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): for every end of a link the smallest id it reaches.

    Alternating large-star and small-star steps: each replaces the links of
    a node by links to its smallest neighbour.  A step is a grouped minimum
    (combined before the shuffle) and a join, so that a node with very many
    links is split by the skew join; nothing is gathered per component.
    """
    edges = scratch.stage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v").distinct(), "links")
    while not edges.isEmpty():
        before = _checksum(edges)
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("w"))
        low = low.select("u", F.least("u", "w").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = scratch.stage(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", "m")).where("u <> v").distinct())
        edges = scratch.stage(small, "small-star")
        if _checksum(edges) == before:
            break
    return (edges.groupBy("u").agg(F.min("v").alias("comp"))
            .select(F.col("u").alias("id"), "comp")
            .union(edges.select(F.col("v").alias("id"),
                                F.col("v").alias("comp")).distinct()))


def _checksum(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(h),
                    F.sum(F.shiftright(h, 24))).first()
    return tuple(row)
