import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import evaluation as ev, ordered


def test_quantiles_with_one_dominant_value(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(3000, 7.0), rng.normal(0, 50, 2000)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    shares = {"a": .01, "b": .25, "c": .5, "d": .9, "e": 1.0}
    row = ordered.quantiles(df, "x", shares).collect()[0]
    for name, share in shares.items():
        assert row[name] == pytest.approx(np.quantile(values, share))


def test_rank_breaks_ties(spark):
    rows = [(i % 5, f"t{i:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "v long, t string")
    got = {(r.v, r.t): r["rank"]
           for r in ordered.ranked(df, "v", "t", "rank").collect()}
    want = {k: i + 1 for i, k in enumerate(sorted(rows))}
    assert got == want


def test_auc_and_average_precision(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 2, 500)
    score = np.round(rng.random(500) * .7 + label * .2, 2)
    df = spark.createDataFrame(
        [(float(s), int(y)) for s, y in zip(score, label)],
        "score double, label int")
    row = ev.ranking_quality(df).collect()[0]
    pos, neg = score[label == 1], score[label == 0]
    auc = np.mean((pos[:, None] > neg) + .5 * (pos[:, None] == neg))
    ap, recall = 0.0, 0.0
    for cut in sorted(set(score), reverse=True):
        hit = label[score >= cut]
        ap += (hit.sum() / label.sum() - recall) * hit.mean()
        recall = hit.sum() / label.sum()
    assert row.roc_auc == pytest.approx(auc)
    assert row.pr_auc == pytest.approx(ap)


def test_clients_stay_in_one_part(spark):
    df = spark.range(3000).select(
        F.concat(F.lit("C"), F.col("id") % 300).alias("code_client"),
        F.current_date().alias("visit_date"))
    split = ev.group_split(df)
    parts = split.select("code_client", "part").distinct()
    assert parts.count() == 300
    assert {r.part for r in parts.collect()} == {"train", "validation", "test"}


def test_empty_part_is_an_error(spark):
    df = spark.createDataFrame([("C1", "2020-01-01")],
                               "code_client string, d string").select(
        "code_client", F.col("d").cast("date").alias("visit_date"))
    with pytest.raises(ev.EmptySplit):
        ev.require_parts(ev.temporal_split(df, "2021-01-01", "2022-01-01"))
