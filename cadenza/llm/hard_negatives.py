"""Hard negatives by the summaries of vector segments.

A block of rows stores, for coarse and finer cuts of its vectors, the mean
and the deviation of every segment.  Within a segment of two vectors the
inner product is the product of the means plus or minus at most the product
of the deviations, so that summaries bound a score from both sides.  What
the bounds of whole vectors cannot decide is bounded by finer segments, and
only what is left is scored exactly.  Bounds never drop a row of the result.

Anchors, the stated query set, are dealt into blocks as well; each block of
anchors meets each block of rows in one row of a join, and a meeting gives
at most a few rows for each of its anchors, which are ranked over all
meetings by a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cadenza.llm.common import Scratch
from cadenza.llm.vectors import common_length

#: Stands for a null id: it comes last.
LAST = 2 ** 63 - 1


@dataclass(frozen=True)
class Settings:
    """``low`` and ``high`` are percents of the positive's score between
    which a negative's must lie; ``segments`` the cuts of a vector, coarse
    first; ``block`` and ``anchors`` the rows and anchors of a block."""
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    segments: tuple[int, ...] = (1, 4, 16)
    block: int = 2048
    anchors: int = 512
    #: Anchors that are compared with a block at once.
    tile: int = 64


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) of the segments of each row, both times the root
    of the segment's length, so that products add up to inner products."""
    width = x.shape[1]
    count = max(1, min(segments, width))
    starts = np.arange(count) * width // count
    sizes = np.diff([*starts, width])
    means = np.add.reduceat(x, starts, axis=1) / np.sqrt(sizes)
    squares = np.add.reduceat(x * x, starts, axis=1)
    return means, np.sqrt(np.maximum(squares - means * means, 0))


@dataclass
class Block:
    """Rows side by side; ``summary`` has (means, deviations) per cut."""
    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    summary: list[tuple[np.ndarray, np.ndarray]]
    extra: np.ndarray

    FIELDS = ("row bigint, n int, ids binary, row_ids binary, labels binary, "
              "x binary, summary binary, extra binary")

    @staticmethod
    def write(row, ids, label, x, cuts, extra) -> list:
        floats = x.astype(float)
        made = [part for c in cuts for part in summaries(floats, c)]
        return [int(row[0]), len(row), ids.tobytes(), row.tobytes(),
                label.tobytes(), x.tobytes(),
                b"".join(m.tobytes() for m in made), extra.tobytes()]

    @staticmethod
    def read(values: list, cuts, width: int) -> Block:
        _, n, ids, row, label, x, summary, extra = values
        at, made = 0, []
        flat = np.frombuffer(summary, float)
        for c in cuts:
            size = n * max(1, min(c, width))
            made.append(tuple(flat[at + i * size:at + (i + 1) * size]
                              .reshape(n, -1) for i in (0, 1)))
            at += 2 * size
        longs = [np.frombuffer(b, np.int64) for b in (row, ids, label, x)]
        return Block(*longs[:3], longs[3].reshape(n, width), made,
                     np.frombuffer(extra, np.int64).reshape(n, -1))


def in_blocks(points: DataFrame, settings: Settings, size: int,
              extra: str | None = None) -> DataFrame:
    """``points`` (row, id, label, x), ``size`` rows of a partition in one.

    ``extra`` names a column of lists of longs, all of one length.
    """
    cuts = settings.segments
    columns = ["row", "id", "label", "x", *([extra] if extra else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def made():
            table = pa.Table.from_batches(held).combine_chunks()
            for start in range(0, table.num_rows, size):
                piece = table.slice(start, size)
                longs = [piece.column(i).to_numpy() for i in range(3)]
                wide = [np.array(piece.column(i).combine_chunks().flatten(),
                                 np.int64).reshape(piece.num_rows, -1)
                        for i in range(3, len(columns))]
                other = wide[1] if extra else np.empty((0, 0), np.int64)
                yield piece.num_rows, Block.write(*longs, wide[0], cuts,
                                                  other)

        def batch_of(row):
            return pa.RecordBatch.from_pylist([dict(zip(
                [f.split()[0] for f in Block.FIELDS.split(", ")], row))],
                schema=schema)
        schema = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(),
                                 "binary": pa.binary()}[t]) for n, t in (
            f.split() for f in Block.FIELDS.split(", "))])
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= size:
                for _, row in made():
                    yield batch_of(row)
                held, count = [], 0
        if count:
            for _, row in made():
                yield batch_of(row)
    return points.select(*columns).mapInArrow(run, Block.FIELDS)


def bounds(a: Block, b: Block, cut: int, some: slice,
           columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of the anchors ``some`` with rows ``columns``."""
    (am, ad), (bm, bd) = a.summary[cut], b.summary[cut]
    middle = am[some] @ bm[columns].T
    reach = ad[some] @ bd[columns].T
    # rounding of the sums never makes a bound wrong
    reach += 1e-9 * (np.abs(middle) + reach) + 1e-6
    return middle - reach, middle + reach


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond the range of longs the nearest."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(
        np.abs(b.astype(float)).max()) * a.shape[1]
    if most < 2 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -LAST - 1,
                   LAST).astype(np.int64)


def kth_largest(values: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row's marked values, else minus infinity."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    held = np.where(where, values, -np.inf)
    return np.partition(held, -k, axis=1)[:, -k]


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray,
         k: int) -> np.ndarray:
    """Places of the k highest scores; ties go to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((rows[near], ids[near], -scores[near]))[:k]]


def positives_of(a: Block, b: Block, settings: Settings) -> list[tuple]:
    """(anchor row, other row, other id, score): the best of the anchor's
    label in one block."""
    out, k = [], settings.positives
    for start in range(0, len(a.row), settings.tile):
        some = slice(start, start + settings.tile)
        alive = ((a.label[some, None] == b.label)
                 & (a.row[some, None] != b.row))
        columns = np.flatnonzero(alive.any(axis=0))
        alive = alive[:, columns]
        for cut in range(len(settings.segments)):
            least, most = bounds(a, b, cut, some, columns)
            alive &= most >= kth_largest(least, alive, k)[:, None]
            kept = alive.any(axis=0)
            columns, alive = columns[kept], alive[:, kept]
        scores = exact(a.x[some], b.x[columns])
        for i, marked in enumerate(alive):
            at = columns[marked]
            own = scores[i, marked]
            for j in best(own, b.id[at], b.row[at], k):
                out.append((a.row[start + i], b.row[at[j]], b.id[at[j]],
                            own[j]))
    return out


def negatives_of(a: Block, b: Block, settings: Settings) -> list[tuple]:
    """(anchor row, positive row, other row, other id, score): the best of
    other labels within the bounds of each of the anchor's positives.

    An anchor's extra numbers are its positives' rows, then their scores;
    a row of -1 stands for none.
    """
    out, k, p = [], settings.negatives, settings.positives
    low, high = settings.low, settings.high
    for start in range(0, len(a.row), settings.tile):
        some = slice(start, start + settings.tile)
        other = a.label[some, None] != b.label
        columns = np.flatnonzero(other.any(axis=0))
        other = other[:, columns]
        rows, scores = a.extra[some, :p], a.extra[some, p:]
        # floats as bounds: a percent more or less is far above rounding
        alive = np.repeat(other[None], p, axis=0)
        alive &= (rows >= 0).T[:, :, None]
        floors = low * scores.astype(float).T[:, :, None]
        tops = high * scores.astype(float).T[:, :, None]
        slack = 1e-9 * (np.abs(floors) + np.abs(tops)) + 1e-3
        for cut in range(len(settings.segments)):
            least, most = (100 * v for v in bounds(a, b, cut, some, columns))
            for j in range(p):
                alive[j] &= ((most >= floors[j] - slack[j])
                             & (least <= tops[j] + slack[j]))
                sure = (alive[j] & (least >= floors[j] + slack[j])
                        & (most <= tops[j] - slack[j]))
                alive[j] &= most >= kth_largest(least, sure, k)[:, None]
            kept = alive.any(axis=(0, 1))
            columns, alive = columns[kept], alive[:, :, kept]
        found = exact(a.x[some], b.x[columns])
        for i in range(found.shape[0]):
            for j in np.flatnonzero(rows[i] >= 0):
                score = int(scores[i, j])
                # floor and ceiling of whole numbers, without overflow
                at = np.flatnonzero(alive[j, i])
                own = found[i, at]
                fits = ((own >= -(-low * score // 100))
                        & (own <= high * score // 100))
                at, own = columns[at[fits]], own[fits]
                for m in best(own, b.id[at], b.row[at], k):
                    out.append((a.row[start + i], rows[i, j], b.row[at[m]],
                                b.id[at[m]], own[m]))
    return out


def meet(anchors: DataFrame, blocks: DataFrame, settings: Settings,
         width: int, work, names: list[str]) -> DataFrame:
    """Rows of longs that ``work`` gives for each pair of blocks.

    Blocks of rows are dealt to lanes, and blocks of anchors go to each.  The
    join shuffles both: the optimizer takes the copies of the anchors for no
    larger than the anchors, and would send all of them through the driver.
    """
    lanes = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = anchors.select(F.struct(*anchors.columns).alias("a"), F.explode(
        F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    right = blocks.select(F.struct(*blocks.columns).alias("b"), F.pmod(
        F.xxhash64("row"), F.lit(lanes)).cast("int").alias("lane"))
    pairs = right.join(left.hint("merge"), "lane").select("a.*", *[
        F.col(f"b.{c}").alias(f"b_{c}") for c in blocks.columns])
    cuts, half = settings.segments, len(blocks.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = [c[i].as_py() for c in batch.columns]
                made = work(Block.read(values[:half], cuts, width),
                            Block.read(values[half:], cuts, width), settings)
                if made:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(column, np.int64))
                         for column in zip(*made)], names)
    return pairs.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def mine(scratch: Scratch, points: DataFrame, settings: Settings = Settings(),
         vec_id: str = "vec_id", label: str = "label", x: str = "x",
         anchor: str = "anchor") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for the rows marked by the boolean column ``anchor``.

    ``x`` is an array of longs; a score is the inner product of two, higher
    ones come first and ties go by the smaller id, a null id last.  An
    anchor's positives are its first other rows of the same label, its
    negatives the first rows of other labels whose score lies within the
    bounds of a positive; fewer are returned where there are fewer.  Rows of
    a null label or of a null or empty vector, or one that is not of the
    most frequent length, take no part.  Rows that repeat an id are rows of their own.
    Labels and ids are whole numbers; other columns are not looked at.  An
    empty table, or one without anchors or positives, gives no row.
    """
    points = points.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(vec_id).cast("long"), F.lit(LAST)).alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(x).cast("array<bigint>").alias("x"),
        F.coalesce(F.col(anchor), F.lit(False)).alias("anchor")).where(
        "label IS NOT NULL AND size(x) > 0")
    points = scratch.stage(points, "points")
    width = common_length(points, "x")
    points = points.where(F.size("x") == width)
    blocks = scratch.stage(in_blocks(points, settings, settings.block),
                           "blocks")

    def packed(rows: DataFrame, name: str, extra=None) -> DataFrame:
        rows = scratch.stage(rows, name)
        parts = max(1, -(-rows.count() // settings.anchors))
        return scratch.stage(in_blocks(
            rows.coalesce(parts), settings, settings.anchors, extra),
            name + "-blocks")

    anchors = points.where("anchor").drop("anchor")
    near = meet(packed(anchors, "anchors"), blocks, settings, width,
                positives_of, ["anchor_row", "row", "id", "score"])
    order = [F.desc("score"), "id", "row"]
    near = scratch.stage(near.withColumn("n", F.row_number().over(
        Window.partitionBy("anchor_row").orderBy(*order))).where(
        F.col("n") <= settings.positives), "positives")
    # at most a few numbers for each anchor
    chosen = near.groupBy("anchor_row").agg(F.sort_array(F.collect_list(
        F.struct("n", "row", "score"))).alias("p"))

    def padded(field: str, none: int):
        return F.transform(
            F.sequence(F.lit(0), F.lit(settings.positives - 1)),
            lambda i: F.coalesce(F.get(F.col("p")[field], i),
                                 F.lit(none).cast("long")))
    asked = anchors.join(chosen, anchors["row"] == chosen["anchor_row"]
                         ).select("row", "id", "label", "x", F.concat(
                             padded("row", -1), padded("score", 0))
                             .alias("extra"))
    far = meet(packed(asked, "asked", "extra"), blocks, settings, width,
               negatives_of, ["anchor_row", "positive_row", "row", "id",
                              "score"])
    ranked = far.withColumn("rank", F.row_number().over(
        Window.partitionBy("anchor_row", "positive_row").orderBy(*order))
    ).where(F.col("rank") <= settings.negatives)
    known = near.select("anchor_row", F.col("row").alias("positive_row"),
                        F.col("id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    named = ranked.join(known, ["anchor_row", "positive_row"]).join(
        anchors.select(F.col("row").alias("anchor_row"),
                       F.col("id").alias("anchor_id")), "anchor_row")

    def shown(name: str):
        return F.nullif(F.col(name), F.lit(LAST)).alias(name)
    return scratch.keep(named.select(
        shown("anchor_id"), shown("positive_id"), "rank",
        F.nullif(F.col("id"), F.lit(LAST)).alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score")),
        "hard-negatives")
