"""Products a client has never ordered, by collaborative factors.

Not every pair is scored.  Products are cut into blocks of falling length of
their factors.  All clients meet the first block; the k-th best score there
is a floor, and a client goes on only to blocks whose longest product could
beat it, for a score is at most the product of both lengths.
"""

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window, functions as F

from cadenza.operators.ordered import ranked
from cadenza.operators.pair_features import PAIR
from cadenza.operators.sampling import hash_number
from cadenza.session import write_and_read

#: Products of a block, and about the clients that meet one at once.
BLOCK, CLIENTS = 4096, 4096


def _length(features):
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda acc, x:
                              acc + x.cast("double") * x.cast("double")))


def numbered(pairs: DataFrame) -> DataFrame:
    """Integer ids from distributed ranks, as factorisation wants them."""
    rows = write_and_read(pairs.select(*PAIR, "total_qty"), "als-pairs")

    def ids(key, name):
        keys = rows.select(key).distinct().withColumn(
            "_draw", hash_number(key))
        return ranked(keys, "_draw", key, name).select(
            key, F.col(name).cast("int").alias(name))
    return write_and_read(
        rows.join(ids("code_client", "_u"), "code_client")
        .join(ids("code_article", "_i"), "code_article"), "als-numbered")


def factors(rows: DataFrame, rank: int = 8, iterations: int = 5,
            seed: int = 42):
    """(client factors, product factors), columns id and features."""
    model = ALS(rank=rank, maxIter=iterations, implicitPrefs=True, seed=seed,
                userCol="_u", itemCol="_i", ratingCol="total_qty").fit(rows)
    return model.userFactors, model.itemFactors


def _best(k: int):
    """Of one group: the k best products of each client not in ``known``."""
    def score(users: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        out = {"_u": [], "_i": [], "cf_raw": []}
        if len(users) and len(items):
            ids = items["id"].to_numpy()
            scores = np.stack(users["features"]).astype(float) @ np.stack(
                items["features"]).astype(float).T
            for own, user, known in zip(scores, users["id"], users["known"]):
                free = np.flatnonzero(~np.isin(ids, known))
                order = free[np.lexsort((ids[free], -own[free]))[:k]]
                out["_u"] += [user] * len(order)
                out["_i"] += ids[order].tolist()
                out["cf_raw"] += own[order].tolist()
        return pd.DataFrame(out)
    return score


def never_ordered(users: DataFrame, items: DataFrame, rows: DataFrame, k: int,
                  block: int = BLOCK, clients: int = CLIENTS) -> DataFrame:
    """(_u, _i, cf_raw, rank): each client's k best products without an
    order in ``rows``; ties go to the smaller product."""
    known = rows.groupBy("_u").agg(F.collect_set("_i").alias("known"))
    placed = ranked(items.withColumn("_short", -_length("features")),
                    "_short", "id", "_n")
    placed = write_and_read(placed.select(
        "id", "features", F.floor((F.col("_n") - 1) / block).cast("int")
        .alias("block"), (-F.col("_short")).alias("length")), "products")
    # one row per block: the products over the size of a block
    spans = placed.groupBy("block").agg(F.max("length").alias("longest"))
    parts = max(1, -(-users.count() // clients))
    people = write_and_read(users.join(
        known, users["id"] == known["_u"]).select(
        "id", "features", "known", _length("features").alias("length"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")),
        "clients")

    def met(chosen: DataFrame, blocks: DataFrame) -> DataFrame:
        spread = blocks.withColumn("part", F.explode(F.sequence(
            F.lit(0), F.lit(parts - 1))))
        return chosen.groupBy("block", "part").cogroup(
            spread.groupBy("block", "part")).applyInPandas(
            lambda left, right: _best(k)(left, right),
            "_u int, _i int, cf_raw double")
    order = Window.partitionBy("_u").orderBy(F.desc("cf_raw"), "_i")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(
            F.col("rank") <= k)
    first = write_and_read(top(met(
        people.withColumn("block", F.lit(0)), placed.filter("block = 0"))),
        "first-block")
    floor = first.groupBy("_u").agg(
        F.min("cf_raw").alias("least"), F.count("*").alias("n"))
    reach = F.array_sort(F.collect_list(F.struct("block", "longest")))
    others = spans.filter("block > 0").agg(reach.alias("blocks")).scalar()
    beat = (F.col("least").isNull() | (F.col("n") < k)
            | (F.col("least") <= 0))
    onward = people.join(floor, people["id"] == floor["_u"], "left").withColumn(
        "_blocks", others).withColumn(
        "block", F.explode(F.transform(F.filter(
            "_blocks", lambda b: beat | (b["longest"] * F.col("length") * (
                1 + 1e-9) >= F.col("least"))), lambda b: b["block"]))).select(
        "id", "features", "known", "block", "part")
    rest = met(onward, placed.filter("block > 0"))
    return top(first.drop("rank").unionByName(rest))


def suggest(pairs: DataFrame, k: int = 5, model_share: float = 0.6,
            **limits) -> DataFrame:
    """Each client's k best products that it has never ordered.

    The purchase model scores ordered pairs only, so the blended score of a
    new product is its share of the factor score, clipped to 0 .. 1.
    """
    rows = numbered(pairs)
    users, items = factors(rows)
    best = never_ordered(users, items, rows, k, **limits)
    cf = F.least(F.greatest("cf_raw", F.lit(0.0)), F.lit(1.0))
    return (best.join(rows.select("_u", "code_client").distinct(), "_u")
            .join(rows.select("_i", "code_article").distinct(), "_i")
            .select(*PAIR, "rank", cf.alias("cf_score"),
                    (cf * (1 - model_share)).alias("hybrid_score")))
