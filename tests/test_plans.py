"""Physical plans the jobs rely on at scale."""

import os
import re

from pyspark.sql import functions as F

from cadenza.operators import (cleaning, evaluation, pair_features,
                               ranking as rk, visits)
from cadenza.plans import tables as tables_module
from cadenza.plans.catalog import QUERIES
from cadenza.plans.tables import Tables
from cadenza.session import write_and_read

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_are_cut_before_the_shuffle(spark):
    lines = Tables(spark, FOLDER).raw_lines()
    text = plan(cleaning.dedup_lines(lines))
    shuffle = text.index("Exchange hashpartitioning(code_facture")
    assert text.index("row_number(), 1, Partial") > shuffle


def test_selection_is_cut_before_the_shuffle(spark):
    rows = write_and_read(spark.range(10).select(
        F.col("id").cast("string").alias("code_client"),
        F.col("id").cast("string").alias("code_article"),
        F.rand().alias("final_score"), F.rand().alias("recency_relative")),
        "scores")
    assert "row_number(), 12, Partial" in plan(rk.select_groups(rows))


def test_counts_combine_before_the_shuffle(spark):
    main = Tables(spark, FOLDER).main_stage()
    text = plan(pair_features.order_counts(main))
    assert "partial_count" in text
    read = text[text.index("ReadSchema: struct<"):].split(">")[0]
    assert {c.split(":")[0] for c in read.split("<")[1].split(",")} == {
        "quantite", "code_article", "code_client", "date_commande"}


def test_pair_matrix_shuffles_twice(spark):
    main = Tables(spark, FOLDER).main_stage()
    text = plan(pair_features.pair_matrix(main, "2001-08-02"))
    assert text.count("Exchange hashpartitioning") == 2


def test_no_nested_loops(spark):
    for name in ("visit_targets", "proposals", "negative_pairs",
                 "cold_start_clients", "visit_history", "auc_from_scores"):
        text = plan(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_filter_reaches_the_scan(spark):
    lines = Tables(spark, FOLDER).main_stage().filter(
        F.col("quantite") > 1000).select("code_client")
    text = plan(lines)
    assert "GreaterThan(quantite,1000.0)" in text
    assert "ReadSchema: struct<quantite:double,code_client:string>" in text


def test_visit_features_read_pairs_as_they_lie(spark):
    """One exchange of counted lines by pair, when they are laid out; later
    only rows that change their key move."""
    main = Tables(spark, FOLDER).main_stage()
    dataset = visits.visit_dataset(main)
    text = plan(dataset)
    assert "Bucketed: true" in text
    assert text.count("Exchange hashpartitioning") <= 5
    assert text.count("Exchange hashpartitioning(code_client") <= 4
    assert "collect_list" in text and dataset.count() > 0


def test_pair_matrix_is_compiled(spark):
    """Methods over 8,000 bytes of byte code are interpreted by the JVM, and
    an aggregate of a map per pair leaves generated code altogether."""
    df = pair_features.pair_matrix(
        Tables(spark, FOLDER).main_stage(), "2001-08-02")
    # an adaptive plan generates its code only when it runs
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(
            df.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000, sizes
    assert "ObjectHashAggregate" not in plan(df)


def test_leak_check_reduces_rows_to_clients(spark):
    rows = spark.createDataFrame([
        ("A", "2024-01-01", "train"), ("A", "2024-03-01", "test"),
        ("B", "2024-01-02", "train"), ("C", "2024-02-01", "validation"),
        (None, "2024-01-01", "train"), (None, "2024-03-02", "test")],
        "code_client string, visit_date string, part string")
    found = evaluation.leak_check(rows)
    assert tuple(found.first()) == (
        "2024-01-02", "2024-02-01", "2024-03-01", 2)
    assert "Join" not in plan(found)


def test_regressor_rows_need_no_training_set(spark):
    tables = Tables(spark, FOLDER)
    columns = ["code_facture", "societe", "code_client", "code_article",
               "target_qty", "avg_qty", "median_qty"]
    rows = sorted(tables.bought_rows().select(columns).collect())
    assert rows and "training-set" not in tables._stages
    assert rows == sorted(visits.positives(
        tables.dataset_stage()).select(columns).collect())
    assert rows == sorted(tables.bought_rows().select(columns).collect())


def test_lines_go_when_the_main_table_is_written(spark, monkeypatch):
    written = []

    def keep(df, name):
        written.append(write_and_read(df, name))
        return written[-1]
    monkeypatch.setattr(tables_module, "write_and_read", keep)
    main = Tables(spark, FOLDER).main_stage()
    assert len(written) == 3 and main.count() > 0
    left = [f for t in written[:2] for f in t.inputFiles()
            if os.path.exists(f.removeprefix("file:"))]
    assert left == []
