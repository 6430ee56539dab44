"""Named queries over one folder of test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]):
    """Register ``build`` under its own name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))
    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    QUERIES[build.__name__] = run
    return build


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Round computed doubles so that two engines print the same value.

    The nudge moves values off exact decimal halves, where engines differ.
    """
    return df.withColumns({
        c: F.round(F.col(c) + F.lit(1e-9), digits) for c in columns})


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})
