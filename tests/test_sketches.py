"""Daily sketches against exact rows."""

from pyspark.sql import functions as F

from cadenza.operators import sketches
from cadenza.session import write_and_read


def lines(spark):
    return spark.range(60000).selectExpr(
        "date_add(date'2024-01-01', cast(id % 90 AS int)) AS date_commande",
        "concat('C', hash(id) % 3000) AS code_client",
        "concat('P', hash(id, 1) % 40) AS code_article",
        "concat('F', id % 20000) AS code_facture",
        "double(abs(hash(id, 2)) % 997) AS quantite")


def test_periods_from_days_are_within_their_errors(spark):
    main = lines(spark)
    days = write_and_read(sketches.daily(main), "days")
    assert days.count() == 90
    for period in (F.date_format("date_commande", "yyyy-MM"),
                   F.weekofyear("date_commande"), F.lit("all")):
        found = sketches.estimates(sketches.merged(
            days, period.alias("period")))
        rows = sketches.errors(found, main, period).collect()
        assert rows
        for r in rows:
            for key in sketches.KEYS:
                assert r[f"error_{key}"] <= 0.05
            for share in sketches.SHARES:
                assert r[f"error_{share}"] <= 0.02


def test_sums_are_exact_and_lines_are_not_read(spark):
    main = write_and_read(lines(spark), "sketch-lines")
    days = write_and_read(sketches.daily(main), "days")
    whole = sketches.merged(days, F.lit(1).alias("period"))
    row = whole.first()
    assert row.n_lines == 60000
    assert row.total_qty == main.agg(F.sum("quantite")).first()[0]
    assert not set(whole.inputFiles()) & set(main.inputFiles())
    assert sketches.merged(days.limit(0), F.lit(1).alias("p")).count() == 0
