"""Best products without an order, against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import new_products as P


def small(spark, clients, products, orders, seed=3):
    rng = random.Random(seed)
    rows = {(rng.randrange(clients), rng.randrange(products))
            for _ in range(orders)}
    return spark.createDataFrame(
        [(f"C{u}", f"P{i}", float(rng.randrange(1, 50)), 0.5)
         for u, i in sorted(rows)], "code_client string, code_article "
        "string, total_qty double, probabilite_achat double")


def brute(users, items, rows, k):
    known = {}
    for r in rows:
        known.setdefault(r["_u"], set()).add(r["_i"])
    out = set()
    for u in users:
        scores = sorted((-float(np.dot(np.array(u["features"], float),
                                       np.array(i["features"], float))),
                         i["id"]) for i in items
                        if i["id"] not in known[u["id"]])[:k]
        out |= {(u["id"], i, n + 1) for n, (_, i) in enumerate(scores)}
    return out


def test_equals_all_pairs_in_small_blocks(spark):
    rows = P.numbered(small(spark, 60, 90, 700))
    users, items = (x.cache() for x in P.factors(rows, rank=4, iterations=3))
    # lengths that differ, so that the floor has something to cut
    items = items.withColumn("features", F.transform(
        "features", lambda x: x * (1 + F.col("id") % 7).cast("float")))
    for k, block, clients in ((5, 8, 16), (3, 200, 1000), (200, 16, 7)):
        found = P.never_ordered(users, items, rows, k, block, clients)
        assert {(r["_u"], r["_i"], r["rank"]) for r in found.collect()
                } == brute(users.collect(), items.collect(), rows.collect(), k)


def test_no_cross_join_and_few_pairs(spark):
    rows = P.numbered(small(spark, 40, 60, 400))
    users, items = P.factors(rows, rank=4, iterations=2)
    found = P.never_ordered(users, items, rows, 2, 8, 16)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_suggestions_are_new_and_blended(spark):
    pairs = small(spark, 20, 12, 120)
    ordered = {(r.code_client, r.code_article) for r in pairs.collect()}
    found = P.suggest(pairs, k=3).collect()
    assert found
    for r in found:
        assert (r.code_client, r.code_article) not in ordered
        assert 0 <= r.cf_score <= 1
        assert abs(r.hybrid_score - 0.4 * r.cf_score) < 1e-12
