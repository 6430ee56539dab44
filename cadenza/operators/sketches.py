"""Daily sketches that any period merges.

A day keeps its number of lines, its quantity, a HyperLogLog sketch of each
key and a KLL sketch of the quantities.  A week, a month or any span of days
merges those, so that its distinct counts and quantiles cost the days in it
and never read a line again.  Sketches of parts merge before the shuffle.
"""

from pyspark.sql import DataFrame, functions as F

#: Keys counted per day, log2 of the HyperLogLog buckets (relative standard
#: error 1.04 / sqrt(2^12) = 1.6 %) and the KLL size (rank error 1.3 %).
KEYS = ["code_client", "code_article", "code_facture"]
LOG_BUCKETS, KLL_SIZE = 12, 200
SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def daily(main: DataFrame) -> DataFrame:
    """One row per day."""
    return main.groupBy("date_commande").agg(
        F.count("*").alias("n_lines"), F.sum("quantite").alias("total_qty"),
        *[F.hll_sketch_agg(key, LOG_BUCKETS).alias(f"hll_{key}")
          for key in KEYS],
        F.kll_sketch_agg_double("quantite", KLL_SIZE).alias("kll"))


def merged(days: DataFrame, *period) -> DataFrame:
    """Sketches of each period, an expression over ``date_commande``."""
    return days.groupBy(*period).agg(
        F.sum("n_lines").alias("n_lines"),
        F.sum("total_qty").alias("total_qty"),
        *[F.hll_union_agg(f"hll_{key}").alias(f"hll_{key}") for key in KEYS],
        F.kll_merge_agg_double("kll", KLL_SIZE).alias("kll"))


def estimates(sketches: DataFrame) -> DataFrame:
    """Distinct keys and quantiles instead of sketches."""
    others = [c for c in sketches.columns
              if c != "kll" and not c.startswith("hll_")]
    return sketches.select(
        *others, *[F.hll_sketch_estimate(f"hll_{key}").alias(f"n_{key}")
                   for key in KEYS],
        *[F.kll_sketch_get_quantile_double("kll", F.lit(share)).alias(name)
          for name, share in SHARES.items()])


def errors(estimated: DataFrame, main: DataFrame, period) -> DataFrame:
    """Relative error of distinct counts and rank error of quantiles, from
    the exact rows of ``main``.

    A quantile's rank is a range where values repeat; its error is the
    distance of the wanted share from that range.
    """
    name = "period"
    rows = main.withColumn(name, period)
    exact = rows.groupBy(name).agg(*[
        F.count_distinct(key).alias(f"exact_{key}") for key in KEYS])
    own = estimated.withColumnRenamed("period", "_period")
    ranks = rows.join(own.select("_period", *SHARES), F.col(name)
                      == F.col("_period")).groupBy(name).agg(*[
                          f(F.col("quantite"), F.col(p)).alias(f"{p}_{side}")
                          for p in SHARES for side, f in (
                              ("below", lambda q, v: F.avg((q < v).cast("int"))),
                              ("upto", lambda q, v: F.avg((q <= v).cast("int"))))])
    joined = estimated.join(exact, name).join(ranks, name)
    return joined.select(
        *estimated.columns, *[f"exact_{key}" for key in KEYS],
        *[(F.abs(F.col(f"n_{key}") - F.col(f"exact_{key}"))
           / F.col(f"exact_{key}")).alias(f"error_{key}") for key in KEYS],
        *[F.greatest(F.col(f"{p}_below") - share, share - F.col(f"{p}_upto"),
                     F.lit(0.0)).alias(f"error_{p}")
          for p, share in SHARES.items()])
