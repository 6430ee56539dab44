"""Data that the test tables do not hold: returns beside sales, fractions,
many companies, late months, long codes, other years."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cadenza.operators import (cleaning, ordered, pair_features, profiling,
                               ranking, visits)
from cadenza.sources import feedback_store, sinks

LINE = ("code_facture string, societe_ligne string, code_article string, "
        "quantite double, designation string, categorie string")


def test_the_first_line_by_number_stays(spark):
    rows = [("F1", "CO1", "P", -4.0, "a", None, 2),
            ("F1", "CO1", "P", 9.0, "b", None, 1),
            ("F1", "CO1", "P", 3.0, "c", None, 3)]
    numbered = spark.createDataFrame(rows, LINE + ", numero_ligne bigint")
    assert cleaning.dedup_lines(numbered).first()["quantite"] == 9.0
    assert "numero_ligne" not in cleaning.clean_lines(numbered).columns


def test_a_return_never_stands_for_a_sale(spark):
    rows = [("F1", "CO1", "P", q, "d", None) for q in (0.0, -2.0, 5.0, 7.0)]
    lines = spark.createDataFrame(rows, LINE)
    assert [r["quantite"] for r in
            cleaning.clean_lines(lines).collect()] == [5.0]


QUANTITIES = {"A": [0.7] * 5, "B": [0.1, 0.7, 2.7], "C": [1e9 + 1, 1e9 + 2],
              "D": [0.1] * 3 + [1e6], "E": [3.3]}


def orders(spark):
    rows = [("C1", p, f"2024-0{i + 1}-1{i}", q, "CO1", "K", "D")
            for p, values in QUANTITIES.items()
            for i, q in enumerate(values)]
    return spark.createDataFrame(
        rows, "code_client string, code_article string, day string, "
        "quantite double, societe string, categorie string, "
        "designation string").withColumn(
        "date_commande", F.to_date("day")).withColumn(
        "mois", F.month("date_commande"))


def test_sample_deviation_of_fractions_and_large_numbers(spark):
    rows = pair_features.pair_matrix(orders(spark), "2024-12-31").collect()
    for r in rows:
        values = QUANTITIES[r["code_article"]]
        want = statistics.stdev(values) if len(values) > 1 else 0.0
        assert r["std_qty"] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_population_deviation_before_each_visit(spark):
    for r in visits.pair_states(orders(spark)).collect():
        values = QUANTITIES[r["code_article"]][:r["frequency"]]
        assert r["std_qty"] == pytest.approx(
            statistics.pstdev(values), rel=1e-9, abs=1e-12)


def test_company_codes_above_six_are_kept(spark):
    codes = {f"CO{i}": i for i in range(10)}
    rows = spark.range(10).select(
        F.concat(F.lit("C"), "id").alias("code_client"),
        F.lit("P").alias("code_article"),
        F.lit("2024-01-01").cast("date").alias("date_commande"),
        F.lit(1.0).alias("quantite"),
        F.concat(F.lit("CO"), "id").alias("societe"))
    got = {r["code_client"]: r["company_encoded"] for r in
           pair_features.pair_matrix(rows, "2024-12-31", codes).collect()}
    assert got == {f"C{i}": i for i in range(10)}


def test_feedback_submitted_after_its_receipt_is_found(spark, tmp_path):
    rows = spark.sql(
        "SELECT timestamp_ntz'2024-02-01 00:10:00' AS submitted_at, "
        "'C' AS client_id, 'R' AS commercial_id, '' AS code_facture, "
        "'P' AS code_article, true AS accepte, 1 AS quantite_finale, "
        "false AS modifie, '2024-01' AS date_visite_mois")
    path = str(tmp_path / "feedback")
    sinks.append_by_month(rows, path)
    assert feedback_store.load_feedback(spark, path, "2024-02-01").count() == 1


def test_long_codes_stay_apart(spark):
    rows = spark.createDataFrame(
        [("C", "ABCDEFGHIJKLMNO-1", "x", 0.9),
         ("C", "ABCDEFGHIJKLMNO-2", "y", 0.9)],
        "code_client string, code_article string, designation string, "
        "probabilite_achat double")
    got = ranking.order_proposal(rows).collect()
    assert len({r["code_article"] for r in got}) == 2
    assert {r["article_court"] for r in got} == {"ABCDEFGHIJKLMNO"}


def test_directory_is_sorted_with_a_profile(spark):
    rows = spark.createDataFrame(
        [("A", "p", 0), ("B", "p", 1), ("B", "q", 1), ("C", "p", 1)],
        "code_client string, code_article string, target_bought int")
    profile = spark.createDataFrame(
        [("B", 2.5, True)], "code_client string, "
        "client_avg_basket_size double, has_gps boolean")
    got = [(r["code_client"], r["avg_basket"], r["has_gps"]) for r in
           ranking.clients_directory(rows, profile=profile).collect()]
    assert got == [("B", 2.5, True), ("C", 1.0, False), ("A", 1.0, False)]


def test_pivot_takes_its_years_from_the_orders(spark):
    main = spark.createDataFrame(
        [("F1", "CO1", "2003-05-01", 2.0), ("F2", "CO1", "2031-05-02", 3.0)],
        "code_facture string, societe string, day string, quantite double"
    ).withColumn("date_commande", F.to_date("day")).withColumns({
        "annee": F.year("date_commande"), "mois": F.month("date_commande"),
        "code_client": F.lit("C"), "code_article": F.lit("P")})
    row = profiling.month_year_pivot(main).first()
    assert (row["2003_qte"], row["2031_qte"]) == (2.0, 3.0)


@pytest.mark.parametrize("ranges", [1, 2, 9, 60, 700])
def test_ranks_with_any_number_of_ranges(spark, ranges):
    df = spark.range(3000).select((F.hash("id") % 900).alias("v"), "id")
    got = ordered.ranked(df, "v", "id", "r", ranges).collect()
    rows = sorted((r["v"], r["id"]) for r in got)
    assert sorted((r["r"], r["v"], r["id"]) for r in got) == [
        (i, v, k) for i, (v, k) in enumerate(rows, 1)]


def test_middle_and_last_quantity_of_any_history(spark):
    """Equal lines, one line, null days and null quantities among them."""
    rng = random.Random(4)
    rows = [("C1", f"P{p}", None if rng.random() < 0.1 else
             dt.date(2024, 1, 1 + rng.randrange(30)), None if p == 7 and rng.random() < 0.5 else float(
        rng.randrange(1, 6)), rng.choice(("CO1", "CO2")))
        for p in range(30) for _ in range(rng.randrange(1, 9))]
    main = spark.createDataFrame(
        rows, "code_client string, code_article string, date_commande date, "
        "quantite double, societe string")
    lines = {}
    for _, product, date, q, company in rows:
        lines.setdefault(product, []).append((
            (date is not None, date or 0), (q is not None, q or 0), company))
    codes = {"CO1": 1, "CO2": 2}
    for r in pair_features.pair_matrix(main, "2024-12-31", codes).collect():
        own = lines[r["code_article"]]
        known = [q for _, (there, q), _ in own if there]
        assert r["median_qty"] == (statistics.median(known) if known else None)
        there, last = max(line[:2] for line in own)[1]
        assert r["last_qty"] == (last if there else None)
        first = min((date, company) for date, _, company in own)[1]
        assert r["company_encoded"] == codes[first]
