"""The whole threshold curve against one threshold at a time."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cadenza.functions import quantities as qty
from cadenza.operators import evaluation as ev


def rows_of(spark):
    return spark.range(400).selectExpr(
        "double(2 + id % 5) AS total_qty", "double(id % 9) AS qty_dispersion",
        "double(1 + id % 7) AS avg_qty", "1D AS std_qty",
        "double(abs(hash(id)) % 20) AS target_qty",
        "double(abs(hash(id, 1)) % 20) AS prediction")


def test_every_point_is_the_error_at_that_threshold(spark):
    rows = rows_of(spark)
    curve = ev.threshold_curve(rows).collect()
    data = [(r.qty_dispersion ** 0.5 / r.total_qty, abs(
        r.target_qty - r.prediction), abs(r.target_qty - r.avg_qty))
        for r in rows.collect()]
    assert {r.threshold for r in curve} == {cv for cv, *_ in data} | {-1.0}
    for r in curve:
        errors = [h if cv > r.threshold else m for cv, m, h in data]
        assert r.mae == pytest.approx(sum(errors) / len(data))
        assert r.rmse == pytest.approx(
            (sum(e * e for e in errors) / len(data)) ** 0.5)
        assert r.n_history == sum(cv > r.threshold for cv, *_ in data)
    least = min(r.mae for r in curve)
    assert [r.threshold for r in curve if r.is_best] == [
        min(r.threshold for r in curve if r.mae == least)]


def test_published_thresholds_are_points_of_the_curve(spark):
    rows = rows_of(spark)
    curve = sorted(ev.threshold_curve(rows).collect(),
                   key=lambda r: r.threshold)
    report = {r.approach: r for r in ev.threshold_report(rows).collect()}
    for threshold in (1.0, 0.8):
        point = [r for r in curve if r.threshold <= threshold][-1]
        assert point.mae == pytest.approx(
            report[f"hybrid_cv_{threshold}"].mae)
        assert point.rmse == pytest.approx(
            report[f"hybrid_cv_{threshold}"].rmse)


def test_a_variation_that_is_the_threshold_does_not_exceed_it(spark):
    for threshold in (0.5, 0.7, 0.8, 1.0, 0.3):
        share = Fraction(str(threshold))
        exact = [(n * share.denominator, n * share.numerator)
                 for n in (1, 3, 7, 1001)]
        rows = spark.createDataFrame(
            [(float(total), float(root * root) + above) for total, root
             in exact for above in (-1.0, 0.0, 1.0)], "s double, d double")
        got = [r[0] for r in rows.select(qty.varies_more(
            F.col("d"), F.col("s"), threshold)).collect()]
        assert got == [False, False, True] * len(exact)
    odd = spark.createDataFrame([(0.0, 0.0), (-2.0, 1.0)],
                                "s double, d double")
    assert [r[0] for r in odd.select(qty.varies_more(
        F.col("d"), F.col("s"), 1.0)).collect()] == [True, True]
