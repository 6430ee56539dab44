"""Scores and proposals of trained models against plain Python.

The saved trees are walked row by row, and every client's proposal is chosen
again from the scores.
"""

import math

import pytest
from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.operators import models, proposals, ranking
from cadenza.plans.tables import Tables
from cadenza.sources import testbed
from cadenza.sources.testbed import TRAIN_CUTOFF, VALIDATION_CUTOFF

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="module")
def fitted(tables):
    rows = tables.dataset_stage()
    return (models.train_classifier(rows, TRAIN_CUTOFF, VALIDATION_CUTOFF,
                                    trees=6, depth=4)[0],
            models.train_regressor(rows, trees=6, depth=4)[0])


def saved_trees(spark, model, path):
    """[(weight, {id: node}, root)] of a saved ensemble."""
    model.write().save(path)
    weights = model.treeWeights
    trees = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    return [(weights[t], trees[t]) for t in sorted(trees)]


def walk(trees, row):
    total = 0.0
    for weight, nodes in trees:
        at = nodes[0]
        while at["leftChild"] >= 0:
            split = at["split"]
            value = row[split["featureIndex"]]
            left = value <= split["leftCategoriesOrThreshold"][0]
            at = nodes[at["leftChild"] if left else at["rightChild"]]
        total += weight * at["prediction"]
    return total


def test_every_score_is_that_of_the_walked_trees(spark, tables, fitted,
                                                 tmp_path):
    snapshots = ranking.latest_snapshot(tables.dataset_stage())
    rows = models.score(snapshots, *fitted).collect()
    assert len(rows) >= 300
    buys = saved_trees(spark, fitted[0].stages[1], str(tmp_path / "buys"))
    sizes = saved_trees(spark, fitted[1].stages[1], str(tmp_path / "sizes"))
    for r in rows:
        margin = walk(buys, [float(r[f]) for f in C.CLASSIFIER_FEATURES])
        assert r.probabilite_achat == pytest.approx(
            1 / (1 + math.exp(-2 * margin)))
        share = walk(sizes, [float(r[f]) for f in C.REGRESSOR_FEATURES])
        quantity = share * r.avg_qty
        assert abs(quantity - round(quantity)) == pytest.approx(
            0.5, abs=1e-9) or r.regressor_qty == max(1, round(quantity))


def test_proposals_are_chosen_from_the_scores(spark, tables, fitted):
    scored = proposals.score_latest(
        tables.main_stage(), tables.dataset_stage(), *fitted,
        testbed.REFERENCE_DATE)
    # scores around the thresholds, whatever the small models learned
    scored = scored.withColumn("probabilite_achat", F.pmod(F.xxhash64(
        "code_client", "code_article"), F.lit(1000)) / 1000)
    clients = {}
    for r in ranking.add_scores(scored).collect():
        clients.setdefault(r.code_client, []).append(r)
    want = {}
    for client, rows in clients.items():
        rows.sort(key=lambda r: (-r.final_score, r.code_article))
        urgent = [r for r in rows if r.recency_relative >= 1
                  and r.final_score > 0.8][:7]
        rest = [r for r in rows if r not in urgent]
        good = [r for r in rest if r.final_score > 0.65][:5]
        if not urgent and not good:
            good = rest[:5]
        for n, r in enumerate(urgent + good, 1):
            want[(client, r.code_article)] = (
                n, "urgent" if r in urgent else C.GROUP_RECOMMENDED)
    got = {(r.code_client, r.code_article): (r.rang, r.urgency_group)
           for r in proposals.suggestions(scored).collect()}
    assert got == want and len(want) > 50
