import datetime as dt

from pyspark.sql import functions as F

from cadenza.operators import cleaning, joining, profiling
from cadenza.session import write_and_read

DAY = dt.date


def tables(spark):
    invoices = spark.createDataFrame([
        ("F1", "C1 ", DAY(2024, 1, 1), "R", "CO1"),
        ("F1", "C2", DAY(2024, 1, 1), "R", "CO2"),
        ("F2", "C1", DAY(2024, 2, 5), "R", "CO1"),
        ("F3", "C1", DAY(2024, 2, 5), "R", "CO1"),
        ("F4", "C1", DAY(2024, 3, 1), "R", "CO1"),
        ("F5", None, DAY(2024, 3, 2), "R", "CO1"),
    ], "code_facture string, code_client string, date_commande date, "
       "ref_commercial string, societe string")
    lines = spark.createDataFrame([
        ("F1", "CO1", "P1", "cat a ", "Prod 1", 4.0),
        ("F1", "CO2", "P1", None, None, 5.0),
        ("F1", "CO1", "P1", "cat a ", "Prod 1", 4.0),
        ("F2", "CO1", "P1", "CAT A", "Prod 1", 6.0),
        ("F3", "CO1", "P2", None, "Prod 2", 1200.0),
        ("F4", "CO1", "P1", "CAT A", "Prod 1", 0.0),
        ("F4", "CO1", "P2", None, "Prod 2", 10.0),
        ("F4", "CO1", None, "CAT B", "x", 3.0),
    ], "code_facture string, societe_ligne string, code_article string, "
       "categorie string, designation string, quantite double")
    clients = spark.createDataFrame([
        ("C1", "CO1", 36.8, 10.1), (None, "CO1", 1.0, 2.0)],
        "code_client string, societe string, latitude double, "
        "longitude double")
    return invoices, lines, clients


def test_clean_tables(spark):
    invoices, lines, clients = tables(spark)
    assert cleaning.clean_invoices(invoices).count() == 5
    for stage in (cleaning._lazy, write_and_read):
        got = {(r.code_facture, r.societe_ligne, r.code_article): r
               for r in cleaning.clean_lines(lines, stage=stage).collect()}
        assert len(got) == 5
        other = got["F1", "CO2", "P1"]
        assert (other.categorie, other.designation) == ("CAT A", "P1")
        bulk = got["F3", "CO1", "P2"]
        assert bulk.is_bulk_order and bulk.categorie == "UNKNOWN"
    first = cleaning.clean_invoices(invoices).filter(
        "code_facture = 'F1' and societe = 'CO1'").collect()[0]
    assert first.code_client == "C1"
    assert (first.jour_semaine, first.trimestre, first.annee_mois) == (
        0, 1, "2024-01")


def test_missing_text_stays_null(spark):
    df = spark.createDataFrame([(None,), (" a ",)], "t string")
    assert {r.t for r in cleaning.trim_text(df, ["t"]).collect()} == {
        None, "a"}


def test_copies_without_company_key(spark):
    _, lines, _ = tables(spark)
    merged = cleaning.dedup_lines(cleaning.keyed_lines(lines),
                                  ["code_facture", "code_article"])
    assert merged.count() == 5


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("p", "b"), ("p", "a"), ("q", None)],
                               "k string, v string")
    assert [tuple(r) for r in cleaning.most_frequent(
        df, "k", "v").collect()] == [("p", "a")]


def test_join_needs_company(spark):
    invoices, lines, clients = tables(spark)
    inv, lin = cleaning.clean_invoices(invoices), cleaning.clean_lines(lines)
    gps = cleaning.clean_clients(clients)
    main = joining.main_table(lin, inv, gps)
    assert main.count() == 5
    assert main.filter(F.col("latitude").isNotNull()).count() == 4
    fan = joining.fanout(lin, inv).collect()[0]
    assert (fan.rows_on_number, fan.rows_across_companies) == (7, 2)


def test_reports(spark):
    _, lines, _ = tables(spark)
    dup = profiling.duplicate_report(
        lines, ["code_facture", "societe_ligne", "code_article"]).collect()[0]
    assert (dup.n_rows, dup.n_duplicates) == (8, 1)
    nulls = {r.column_name: r.n_null
             for r in profiling.null_report(lines).collect()}
    assert nulls == {"categorie": 3, "designation": 1, "code_article": 1}
