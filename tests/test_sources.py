from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.session import scratch_path, write_and_read
from cadenza.sources import (extracts, feedback_batches as batches,
                             feedback_store, quarantine, sinks)


def test_missing_input_is_a_clear_error(spark):
    with pytest.raises(extracts.MissingInput):
        extracts.load_lines(spark, "/nowhere/lines")
    with pytest.raises(extracts.MissingInput):
        extracts.require_columns(spark.range(1), ["visit_date"], "dataset")


def test_csv_extract(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame(
        [("F1", "C1", "2024-02-05 00:00:00", "R1", "CO1")],
        "`No_` string, client_code string, `Posting Date` string, "
        "`Salesperson Code` string, company string").write.option(
        "header", "true").csv(path)
    row = extracts.load_invoices(
        spark, path, "csv",
        timestampNTZFormat="yyyy-MM-dd HH:mm:ss").collect()[0]
    assert str(row.date_commande) == "2024-02-05"
    assert (row.code_facture, row.societe) == ("F1", "CO1")


def test_optional_column(spark):
    df = extracts.optional_column(spark.range(1), "basket", 1.0)
    assert df.collect()[0].basket == 1.0
    assert extracts.optional_column(df, "basket", 2.0) is df


def test_no_feedback_yet_is_an_empty_table(spark):
    empty = feedback_store.load_feedback(spark, "/nowhere/feedback")
    assert empty.schema == schemas.FEEDBACK and empty.count() == 0


def test_monthly_store(spark):
    path = scratch_path(spark, "store")
    rows = spark.range(100).select(
        F.expr("timestampadd(DAY, cast(id as int), timestamp_ntz'2024-01-01')")
        .alias("submitted_at"), F.lit("C").alias("client_id"),
        F.lit("R").alias("commercial_id"), F.lit("").alias("code_facture"),
        F.lit("P").alias("code_article"), F.lit(True).alias("accepte"),
        F.col("id").cast("int").alias("quantite_finale"),
        F.lit(False).alias("modifie")).withColumn(
        "date_visite_mois", F.date_format("submitted_at", "yyyy-MM"))
    sinks.append_by_month(rows, path)
    sinks.append_by_month(rows, path)
    assert feedback_store.load_feedback(spark, path).count() == 200
    late = feedback_store.load_feedback(spark, path, "2024-03-15")
    assert late.count() == 2 * (100 - 74)
    plan = late._jdf.queryExecution().executedPlan().toString()
    # folders are months of receipt and prove nothing about submission; the
    # filter is left to the files' statistics
    assert "PushedFilters: [IsNotNull(submitted_at)" in plan
    assert "PartitionFilters: []" in plan


def test_union_of_different_months(spark):
    a = spark.createDataFrame([(1, "x")], "n int, old string")
    b = spark.createDataFrame([(2, True)], "n int, added boolean")
    got = feedback_store.union_months(a, b)
    assert got.columns == ["n", "old", "added"] and got.count() == 2


LINE_SCHEMA = "name string, qty double, day date, n int"


def test_broken_rows_are_set_aside_with_a_reason(spark, tmp_path):
    rows = ['a,1.5,2024-01-02,3', '"b,c",2,2024-01-03,4', 'd,,,',
            'e,many,2024-01-04,5', 'f,3,2024-02-31,6', 'g,4,2024-01-05,7,8',
            'h,5', 'i,6,2024-01-06,1.5', '']
    (tmp_path / "one.csv").write_text("\n".join(rows[:5]) + "\n")
    (tmp_path / "two.csv").write_text("\n".join(rows[5:]) + "\n")
    schema = spark.createDataFrame([], LINE_SCHEMA).schema
    good, broken = quarantine.read_csv(spark, str(tmp_path), schema,
                                       write_and_read)
    assert {(r.name, r.qty) for r in good.collect()} == {
        ("a", 1.5), ("b,c", 2.0), ("d", None)}
    assert {(r.file, r.reason, r.raw_row) for r in broken.collect()} == {
        ("one.csv", "qty is no double", rows[3]),
        ("one.csv", "day is no date", rows[4]),
        ("two.csv", "number of fields", rows[5]),
        ("two.csv", "number of fields", rows[6]),
        ("two.csv", "n is no int", rows[7])}


def answers(spark, *days):
    return spark.createDataFrame(
        [(datetime(2024, m, d, 9), "C", "R", "F", f"P{m}-{d}", True, 1, False,
          f"2024-{m:02d}") for m, d in days], schemas.FEEDBACK)


def test_a_batch_sent_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert batches.load(spark, path).count() == 0
    batches.put(answers(spark, (1, 5), (2, 6)), path, 1)
    batches.put(answers(spark, (2, 7), (3, 1)), path, 2)
    before = sorted(map(str, batches.load(spark, path).collect()))
    assert len(before) == 4
    batches.put(answers(spark, (1, 5), (2, 6)), path, 1)
    assert sorted(map(str, batches.load(spark, path).collect())) == before
    # a batch that is sent again with other rows replaces the first
    batches.put(answers(spark, (1, 9), (2, 6)), path, 1)
    assert {r.code_article for r in batches.load(spark, path).collect()} == {
        "P1-9", "P2-6", "P2-7", "P3-1"}


def test_a_date_skips_folders_and_compaction_joins_them(spark, tmp_path):
    path = str(tmp_path / "store")
    for number, day in enumerate(((1, 5), (2, 3), (2, 20), (3, 2))):
        batches.put(answers(spark, day), path, number)
    late = batches.load(spark, path, "2024-02-10")
    assert {f.split("date_visite_mois=")[1].rsplit("/", 1)[0]
            for f in late.inputFiles()} == {
        "2024-02/batch=b2", "2024-03/batch=b3"}
    assert {r.code_article for r in late.collect()} == {"P2-20", "P3-2"}
    before = sorted(map(str, batches.load(spark, path).collect()))
    batches.compact(spark, path, "2024-02")
    whole = batches.load(spark, path)
    assert sorted(map(str, whole.collect())) == before
    assert len({f.rsplit("/", 1)[0] for f in whole.inputFiles()}) == 3
    # a batch that was joined may come again, and so may the joining
    batches.put(answers(spark, (2, 3)), path, 1)
    batches.compact(spark, path, "2024-02")
    assert sorted(map(str, batches.load(spark, path).collect())) == before
