import random

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import hard_negatives as H, vectors


def brute(points, settings):
    """Every anchor against every row; points are (id, label, x, anchor)."""
    def order(found):
        return sorted(found, key=lambda f: (
            -f[0], f[1] is None, f[1] or 0))
    out = []
    for n, (anchor, label, x, asked) in enumerate(points):
        if not asked:
            continue
        scores = [(sum(a * b for a, b in zip(x, y)), other, own == label)
                  for m, (other, own, y, _) in enumerate(points) if m != n]
        near = order([s for s in scores if s[2]])[:settings.positives]
        for score, positive, _ in near:
            far = order([s for s in scores if not s[2] and settings.low
                         * score <= 100 * s[0] <= settings.high * score])
            out += [(anchor, positive, rank, negative, score, low)
                    for rank, (low, negative, _) in enumerate(
                        far[:settings.negatives], 1)]
    return out


def table(spark, points):
    return spark.createDataFrame(points, "vec_id bigint, label int, "
                                 "x array<bigint>, anchor boolean")


def mined(scratch, df, settings=H.Settings()):
    return [tuple(r) for r in H.mine(scratch, df, settings).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        "negative_score").collect()]


def some_points(rng, count, width, labels, spread):
    centres = [[rng.gauss(0, 40) for _ in range(width)]
               for _ in range(labels)]
    out = []
    for i in range(count):
        label = rng.randrange(labels)
        out.append((i, label, [int(c + rng.gauss(0, spread))
                               for c in centres[label]], i % 9 == 0))
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def test_equals_brute_force_in_small_blocks(spark, scratch):
    rng = random.Random(11)
    for width, spread in ((64, 60), (5, 20), (1, 3)):
        points = some_points(rng, 240, width, 4, spread)
        settings = H.Settings(block=32, anchors=7, tile=3)
        want = brute(points, settings)
        assert len(want) > 200
        got = mined(scratch, table(spark, points).repartition(3), settings)
        assert sorted(got) == sorted(want)


def test_ties_repeated_ids_and_rows_that_take_no_part(spark, scratch):
    rng = random.Random(4)
    points = [(i // 2, i % 3, [rng.randrange(3) for _ in range(8)],
               i % 10 == 0) for i in range(80)]
    points += [(None, 0, [1] * 8, False), (None, 1, [1] * 8, True)]
    want = brute(points, H.Settings())
    broken = [(90, None, [1] * 8, True), (91, 1, None, True),
              (92, 1, [1] * 7, True), (93, 1, [], True), (94, 1, [1], None)]
    df = table(spark, points + broken).withColumn("row", F.lit("clash"))
    got = mined(scratch, df.withColumn("score", F.lit(None)))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert mined(scratch, df.limit(0)) == []
    assert mined(scratch, table(spark, points).withColumn(
        "anchor", F.lit(False))) == []


def test_summaries_bound_every_score():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (50, 13))
    y = rng.integers(-3, 300, (60, 13)) * (rng.random((60, 1)) < 0.9)
    cuts = (1, 4, 16)

    def block(m):
        n = np.arange(len(m))
        return H.Block.read(H.Block.write(n, n, n, m, cuts, np.empty(
            (len(m), 0), np.int64)), cuts, 13)
    a, b = block(x), block(y)
    wide = []
    for cut in range(3):
        least, most = H.bounds(a, b, cut, slice(0, 50), np.arange(60))
        assert ((least <= x @ y.T) & (x @ y.T <= most)).all()
        wide.append((most - least).sum())
    assert wide[0] > wide[1] > wide[2]
    assert (H.exact(x, y) == x @ y.T).all()
    huge = np.array([[2 ** 62, 1], [3, 2 ** 40]])
    assert H.exact(huge, huge)[0, 0] == 2 ** 63 - 1
    assert H.exact(huge, huge)[1, 0] == 3 * 2 ** 62 + 2 ** 40 \
        or H.exact(huge, huge)[1, 0] == 2 ** 63 - 1


def test_only_finite_vectors_become_integers(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]),
            (5, [inf, 1.0]), (6, [-inf, 1.0]), (7, []), (8, [-0.0, 3e38])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    got = {r["i"]: r["x"] for r in vectors.integer_vectors(
        df, "v", "x", 256, {"i": F.col("i")}).collect()}
    assert got == {1: [128, -1], 7: [], 8: [0, 2 ** 63 - 1]}


def test_copies_of_anchors_are_not_broadcast(spark):
    """Each lane gets all blocks of anchors, which the optimizer takes for no
    more than one copy of them."""
    row = spark.range(2).selectExpr("id AS row", "1 AS n", *[
        f"X'00' AS {c}" for c in ("ids", "row_ids", "labels", "x", "summary",
                                  "extra")])
    met = H.meet(row, row, H.Settings(), 1,
                 lambda a, b, s: [], ["a"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
