"""Worked cases with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.functions import quantities as qty, scoring, wording
from cadenza.operators import visits

DAY = dt.date


def main_rows(spark, orders, visit_day):
    """One client and product; a later line of another product is the visit."""
    rows = [("C1", "P1", f"F{i}", "CO1", d, float(q), d.month, "CAT", "p")
            for i, (d, q) in enumerate(orders)]
    rows.append(("C1", "P2", "FV", "CO1", visit_day, 1.0, visit_day.month,
                 "CAT", "p"))
    return spark.createDataFrame(
        rows, "code_client string, code_article string, code_facture string, "
        "societe string, date_commande date, quantite double, mois int, "
        "categorie string, designation string")


def before_visit(spark, orders, visit_day):
    table = visits.visit_dataset(main_rows(spark, orders, visit_day),
                                 min_history=1)
    return table.filter((F.col("code_facture") == "FV")
                        & (F.col("code_article") == "P1")).collect()[0]


def test_irregular_history(spark):
    row = before_visit(spark, [
        (DAY(2026, 4, 10), 1), (DAY(2026, 5, 12), 1), (DAY(2026, 5, 12), 30),
        (DAY(2026, 5, 15), 1)], DAY(2026, 6, 19))
    assert row.avg_qty == 8.25
    assert row.std_qty == pytest.approx(12.56, abs=.005)
    assert row.trend == pytest.approx(14.5, abs=.001)
    assert row.avg_delay_days == pytest.approx(11.67, abs=.005)
    assert row.recency_relative == pytest.approx(3.0, abs=.001)
    assert row.median_qty == 1.0 and row.last_qty == 1.0


def test_two_orders(spark):
    row = before_visit(spark, [(DAY(2026, 3, 12), 40), (DAY(2026, 4, 20), 60)],
                       DAY(2026, 6, 19))
    assert (row.std_qty, row.avg_delay_days) == (10, 39)
    assert row.trend == pytest.approx(.5, abs=.001)
    assert row.recency_relative == pytest.approx(1.54, abs=.005)


def test_same_day_orders_floor_the_gap(spark):
    row = before_visit(spark, [(DAY(2026, 5, 12), 30), (DAY(2026, 5, 12), 107)],
                       DAY(2026, 6, 19))
    assert row.avg_delay_days == 1 and row.recency_relative == 38
    assert row.trend == pytest.approx(2.57, abs=.005)


@pytest.mark.parametrize("pred,low,high,avg,expected", [
    (192.25, 9, 500, 145.9, (192, 144, 240)),
    (500, 100, 800, 300, (500, 375, 625)),
    (3, 1, 5, 2, (3, 2, 3)),
    (20, 2, 10, 6, (20, 15, 20)),
    (76, 5, 50, 20, (76, 57, 95)),
    (76, 5, 114, 76, (76, 57, 95)),
])
def test_clamp(spark, pred, low, high, avg, expected):
    clamped = qty.clamp(*[F.lit(float(v)) for v in (pred, low, high, avg)])
    row = spark.range(1).select(clamped.alias("c")).collect()[0].c
    assert tuple(row) == expected


def test_history_bounds(spark):
    low, high = qty.history_bounds(F.lit(9.0), F.lit(500.0))
    assert tuple(spark.range(1).select(low, high).collect()[0]) == (4, 1000)


def test_final_score(spark):
    value = scoring.final_score(F.lit(.71), F.lit(1.37), F.lit(.15))
    assert spark.range(1).select(value).collect()[0][0] == pytest.approx(1.704)


def test_high_variance_uses_history(spark):
    rows = spark.createDataFrame([(float(q),) for q in (
        9, 10, 14, 22, 45, 50, 100, 255, 300, 300, 500)], "q double")
    row = rows.agg(F.avg("q").alias("avg"), F.median("q").alias("med"),
                   F.stddev_pop("q").alias("std"))
    cv = qty.variation(F.col("std"), F.col("avg"))
    got = row.select(
        "med", cv.alias("cv"), qty.quantity_source(cv, F.lit(192.0)).alias("s"),
        qty.raw_quantity(cv, F.lit(192.0), F.col("avg")).alias("raw"),
    ).collect()[0]
    assert got.med == 50 and got.cv > 1
    assert got.s == C.SOURCE_VARIANCE and got.raw == 146


def test_explanation_order(spark):
    def text(freq=1, days=99, trend=0.0, new=False, source=C.SOURCE_MODEL):
        c = wording.explanation(F.lit(7), F.lit(days), F.lit(freq),
                                F.lit(trend), F.lit(new), F.lit(.997),
                                F.lit(source))
        return spark.range(1).select(c).collect()[0][0]

    assert "irréguliers" in text(new=True, source=C.SOURCE_VARIANCE)
    assert text(new=True, freq=9, days=1).startswith("Nouveau produit")
    assert "acheté 5 fois" in text(freq=5, days=30, trend=.9)
    assert "hausse" in text(freq=5, days=31, trend=.21)
    assert "Baisse" in text(trend=-.21)
    assert text(trend=-.2).startswith("Réassort classique de 7")
    assert "99%" in text()


def test_rounding_is_half_even(spark):
    got = spark.range(1).select(*[
        qty.served_quantity(F.lit(v)) for v in (2.5, 3.5, .2)]).collect()[0]
    assert tuple(got) == (2, 4, 1)
