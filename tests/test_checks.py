"""Registered queries against DuckDB on the smallest test tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import check  # noqa: E402
import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SMALL = [
    "clean_lines", "clean_audit", "main_table", "feature_matrix",
    "visit_features", "visit_summary", "order_gaps", "negative_pairs",
    "proposals", "proposals_for_requests", "order_proposal", "weekly_rolling",
    "seasonal_decompose", "kruskal_h", "acf", "winsorise", "cv_switches",
    "classification_report", "acceptance_windows", "visit_sessions",
    "feedback_stream", "acceptance_stream", "acceptance_week_stream",
    "session_stream", "category_season_all",
    "feedback_dedup", "pair_state_stream", "cold_start_clients",
]


@pytest.fixture(scope="module")
def db():
    return check.connect(FOLDER)


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SMALL)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    problem, _ = check.compare(df, db, entry.oracle_sql()[name])
    assert problem is None


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
