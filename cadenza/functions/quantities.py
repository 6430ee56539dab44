"""Order-quantity expressions: variation, sizing, clamping."""

from fractions import Fraction

from pyspark.sql import Column, functions as F

from cadenza import constants as C


def _int(column: Column) -> Column:
    """Truncate toward zero."""
    return column.cast("long")


def variation(std: Column, avg: Column,
              undefined: float = C.CV_UNDEFINED) -> Column:
    return F.when(avg > 0, std / avg).otherwise(F.lit(undefined))


def varies_more(dispersion: Column, total: Column,
                threshold: float) -> Column:
    """The variation exceeds ``threshold``, decided without a division.

    With n quantities of sum S and squares Q the population variation is
    sqrt(n Q - S^2) / S.  ``dispersion`` is n Q - S^2; a variation that is
    the threshold to the last digit does not exceed it.  Where the sum is
    not positive the variation counts as very large.
    """
    share = Fraction(str(threshold))
    exact = total.cast("decimal(18,4)")
    return F.when(total > 0, dispersion.cast("decimal(30,4)")
                  * F.lit(share.denominator ** 2)
                  > exact * exact * F.lit(share.numerator ** 2)
                  ).otherwise(True)


def relative_recency(recency: Column, gap: Column) -> Column:
    """Recency over mean gap; a zero gap counts as the default gap."""
    return recency / F.when(gap == 0, F.lit(C.DEFAULT_GAP_DAYS)).otherwise(gap)


def trend(old_sum: Column, old_n: Column, total: Column, n: Column) -> Column:
    """Relative change of the later half's mean against the earlier half's."""
    old = old_sum / old_n
    new = (total - old_sum) / (n - old_n)
    return F.when(n < 2, F.lit(0.0)).otherwise(
        (new - old) / (old + F.lit(C.TREND_EPSILON)))


def served_quantity(prediction: Column, floor: int = 1) -> Column:
    """Round half to even, never below ``floor``."""
    return F.greatest(F.rint(prediction), F.lit(float(floor)))


def quantity_source(cv: Column, predicted: Column,
                    threshold: float = C.CV_THRESHOLD) -> Column:
    return (F.when(cv > threshold, F.lit(C.SOURCE_VARIANCE))
            .when(predicted.isNotNull(), F.lit(C.SOURCE_MODEL))
            .otherwise(F.lit(C.SOURCE_HISTORY)))


def raw_quantity(cv: Column, predicted: Column, avg: Column,
                 threshold: float = C.CV_THRESHOLD) -> Column:
    history = F.ceil(avg).cast("double")
    return (F.when(cv > threshold, history)
            .when(predicted.isNotNull(), predicted.cast("double"))
            .otherwise(history))


def history_bounds(hist_min: Column, hist_max: Column) -> tuple[Column, Column]:
    """Half the smallest order (at least 1) and twice the largest."""
    lower = F.greatest(F.lit(1).cast("long"), _int(hist_min * 0.5))
    return lower, F.greatest(lower + 1, _int(hist_max * 2.0))


def clamp(prediction: Column, hist_min: Column, hist_max: Column,
          hist_avg: Column) -> Column:
    """struct(quantite_suggeree, quantite_min, quantite_max).

    The interval is +-25 % around the prediction cut to the bounds.  When the
    cut leaves it empty its upper end is rebuilt from the mean quantity, which
    may lie beyond the upper bound; the suggestion itself never leaves the
    bounds.
    """
    lower, upper = history_bounds(hist_min, hist_max)
    low = F.greatest(lower, _int(prediction * 0.75))
    high = F.least(upper, _int(prediction * 1.25))
    widened = low + F.greatest(F.lit(1).cast("long"), _int(hist_avg * 0.25))
    high = F.when(low >= high, widened).otherwise(high)
    suggestion = F.greatest(lower, F.least(_int(F.rint(prediction)), upper))
    return F.struct(
        suggestion.cast("int").alias("quantite_suggeree"),
        low.cast("int").alias("quantite_min"),
        high.cast("int").alias("quantite_max"),
    )


def naive_bounds(suggestion: Column) -> tuple[Column, Column]:
    """The older bounds kept for comparison: 1 and max(3 q, 5)."""
    return F.lit(1), F.greatest(suggestion * 3, F.lit(5))


def unusual(suggestion: Column, hist_max: Column, factor: float = 1.5) -> Column:
    return F.coalesce(suggestion > hist_max * factor, F.lit(False))


def clip(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(float(low))), F.lit(float(high)))
