"""Outlier capping and drift between two periods."""

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.operators.ordered import quantiles


def winsorise(df: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """Cap a column at its exact quantile."""
    cap = quantiles(df, column, {"cap": share})
    return df.withColumn(f"{column}_cap", cap.scalar()).withColumn(
        f"{column}_capped", F.least(column, f"{column}_cap")).drop(
        f"{column}_cap")


def stability_index(df: DataFrame, is_new: Column, bins: dict[str, Column],
                    floor: float = 1e-4) -> DataFrame:
    """Population stability index of several binned variables.

    Shares of a bin in the old and new period are floored, then compared by
    (new - old) * ln(new / old).  Lines are counted per bin first.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("variable"),
                               b.cast("string").alias("bin"))
                      for n, b in bins.items()])
    counts = (df.select(is_new.alias("_new"), F.explode(cells).alias("c"))
              .groupBy("c.variable", "c.bin")
              .agg(F.count_if(F.col("_new")).alias("n_new"),
                   F.count_if(~F.col("_new")).alias("n_old")))
    totals = counts.groupBy("variable").agg(
        F.sum("n_new").alias("_all_new"), F.sum("n_old").alias("_all_old"))
    shares = counts.join(totals, "variable").withColumns({
        "share_new": F.greatest(F.col("n_new") / F.col("_all_new"),
                                F.lit(floor)),
        "share_old": F.greatest(F.col("n_old") / F.col("_all_old"),
                                F.lit(floor))})
    return shares.groupBy("variable").agg(
        F.sum((F.col("share_new") - F.col("share_old"))
              * F.log(F.col("share_new") / F.col("share_old"))).alias("psi"),
        F.count("*").alias("n_bins"))
