"""Global order statistics without a global sort in one task.

A rank or running total over a whole table needs every earlier row.  Here the
table is first reduced to one row per distinct value, values are cut into
ranges at approximate quantiles, range totals (a handful of rows) give each
range its offset, and the running total is finished inside each range.  The
cut points only balance the work; the result is exact whatever they are.

The reduced table is written to the shared folder first: cut points, offsets
and totals each read it, and none of them recomputes what produced it.
"""

import math

from pyspark.sql import DataFrame, Window, functions as F

from cadenza.session import write_and_read

#: Distinct values of one range, and the most ranges that are cut.
RANGE_ROWS = 50_000
MOST_RANGES = 4096


def _ranges(df: DataFrame) -> int:
    """Enough ranges for a written table of distinct values."""
    return max(8, min(MOST_RANGES, -(-df.count() // RANGE_ROWS)))


def _cut(df: DataFrame, value: str, ranges: int) -> DataFrame:
    """Add ``_range``: how many of the cut points lie below ``value``.

    The points are searched in two steps of about the square root of their
    number.
    """
    shares = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(value, shares, 10000).alias("_cuts"))
    step = math.isqrt(ranges - 1) + 1

    def below(points):
        return F.size(F.filter(points, lambda c: c < F.col(value)))

    coarse = F.filter("_cuts", lambda _, i: (i + 1) % step == 0)
    return (df.withColumn("_cuts", cuts.scalar())
            .withColumn("_block", below(coarse))
            .withColumn("_range", F.col("_block") * step + below(F.slice(
                F.col("_cuts"), F.col("_block") * step + 1, F.lit(step))))
            .drop("_cuts", "_block"))


def _offsets(cut: DataFrame, measures: list[str]) -> DataFrame:
    """Totals of all lower ranges: at most ``ranges`` rows."""
    earlier = Window.orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    return cut.groupBy("_range").agg(
        *[F.sum(m).alias(m) for m in measures]).select(
        "_range", *[F.coalesce(F.sum(m).over(earlier), F.lit(0))
                    .alias(f"_{m}_offset") for m in measures])


def running_totals(df: DataFrame, value: str, measures: list[str],
                   ranges: int | None = None) -> DataFrame:
    """Add ``<measure>_before``: the measure's sum over smaller values.

    ``df`` holds one row per distinct ``value``.
    """
    df = write_and_read(df, "distinct-values")
    return _running(df, value, measures, ranges or _ranges(df))


def _running(df: DataFrame, value: str, measures: list[str], ranges: int,
             ) -> DataFrame:
    cut = _cut(df, value, ranges)
    within = Window.partitionBy("_range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    # the offsets have at most MOST_RANGES rows
    joined = cut.join(F.broadcast(_offsets(cut, measures)), "_range")
    return joined.withColumns({
        f"{m}_before": F.col(f"_{m}_offset") + F.coalesce(
            F.sum(m).over(within), F.lit(0)) for m in measures
    }).drop("_range", *[f"_{m}_offset" for m in measures])


def ranked(df: DataFrame, value: str, tie: str, name: str,
           ranges: int | None = None) -> DataFrame:
    """1-based rank of every row by a numeric ``value``, then ``tie``."""
    df = write_and_read(df, "ranked-values")
    cut = _cut(df, value, ranges or _ranges(df)).withColumn(
        "_one", F.lit(1).cast("long"))
    within = Window.partitionBy("_range").orderBy(value, tie)
    joined = cut.join(F.broadcast(_offsets(cut, ["_one"])), "_range")
    return joined.withColumn(
        name, F.col("__one_offset") + F.row_number().over(within)).drop(
        "_range", "_one", "__one_offset")


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return (df.filter(F.col(value).isNotNull())
            .groupBy(value).agg(F.count("*").alias("_n")))


def quantiles(df: DataFrame, value: str, shares: dict[str, float],
              ) -> DataFrame:
    """Exact interpolated quantiles of one column, as one row.

    Unlike a single ``percentile`` aggregate, no task holds all distinct
    values.
    """
    counts = write_and_read(value_counts(df, value), "value-counts")
    placed = _running(counts, value, ["_n"], _ranges(counts)).withColumn(
        "_total", counts.agg(F.sum("_n")).scalar())
    first, last = F.col("_n_before"), F.col("_n_before") + F.col("_n") - 1
    picks, results = [], []
    for name, share in shares.items():
        position = (F.col("_total") - 1) * F.lit(float(share))
        for side, rank in (("low", F.floor(position)),
                           ("high", F.ceil(position))):
            picks.append(F.max(F.when(
                (first <= rank) & (rank <= last), F.col(value)))
                .alias(f"_{name}_{side}"))
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        results.append((low + (high - low) * (position - F.floor(position)))
                       .alias(name))
    return placed.agg(F.max("_total").alias("_total"), *picks).select(*results)


def as_struct_scalar(row: DataFrame, *columns: str):
    """A one-row table as a struct-valued scalar subquery."""
    return row.select(F.struct(*columns).alias("_row")).scalar()
