import random

from pyspark.sql import functions as F

from cadenza.operators import proposals as pr, ranking as rk


def scored(spark):
    rng = random.Random(11)
    rows = []
    for client in range(40):
        n = 1 if client == 0 else rng.randrange(1, 60)
        top = .2 if client % 4 == 0 else 1.5
        for p in range(n):
            rows.append((f"C{client}", f"P{p:02d}",
                         round(rng.random() * top, 2),
                         rng.choice([.5, 1.0, 2.0])))
    return rows, spark.createDataFrame(
        rows, "code_client string, code_article string, final_score double, "
        "recency_relative double")


def test_groups_equal_brute_force(spark):
    rows, df = scored(spark)
    got = {}
    for r in rk.select_groups(df).collect():
        got.setdefault(r.code_client, []).append(
            (r.rang, r.code_article, r.urgency_group))
    for client in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == client),
                     key=lambda r: (-r[2], r[1]))
        urgent = [r for r in own if r[3] >= 1 and r[2] > .8][:7]
        rest = [r for r in own if r not in urgent]
        good = [r for r in rest if r[2] > .65][:5]
        if not urgent and not good:
            good = own[:5]
        want = [(i + 1, r[1], "urgent" if i < len(urgent) else "recommande")
                for i, r in enumerate(urgent + good)]
        assert sorted(got[client]) == want


def requests_and_scores(spark):
    table = spark.createDataFrame(
        [("C1", f"P{i}", 0.9, 1.2, 0.0, 10.0, 2.0, 5.0, 20.0, 3.0, 40.0,
          "A" if i % 2 else "B") for i in range(9)],
        "code_client string, code_article string, probabilite_achat double, "
        "recency_relative double, trend double, avg_qty double, "
        "std_qty double, min_qty double, max_qty double, frequency double, "
        "recency_days double, categorie string").withColumns({
            "designation": F.col("code_article"),
            "is_new_product": F.lit(False),
            "regressor_qty": F.lit(12.0)})
    asked = spark.createDataFrame(
        [("C1", "R1", ["A"]), ("NEW", "R2", [])],
        "client_id string, commercial_id string, "
        "filter_categories array<string>")
    return asked, table


def test_unknown_client_gets_an_empty_list(spark):
    asked, table = requests_and_scores(spark)
    got = {r.client_id: r for r in pr.answer_requests(
        asked, table, "2024-01-01 00:00:00").collect()}
    assert got["NEW"].nb_suggestions == 0 and got["NEW"].suggestions == []
    assert got["C1"].nb_suggestions == 4
    assert {s.categorie for s in got["C1"].suggestions} == {"A"}
    assert list(got["C1"].suggestions[0].asDict()) == pr.SUGGESTION


def test_suggestion_stays_in_bounds(spark):
    rows = spark.range(2000).select(
        (F.rand(1) * 200).alias("raw_pred"), (F.rand(2) * 20).alias("min_qty"),
        (20 + F.rand(3) * 100).alias("max_qty"),
        (F.rand(4) * 60).alias("avg_qty"))
    from cadenza.functions import quantities as qty
    low, high = qty.history_bounds(F.col("min_qty"), F.col("max_qty"))
    bad = rows.withColumn("c", qty.clamp(
        F.col("raw_pred"), F.col("min_qty"), F.col("max_qty"),
        F.col("avg_qty"))).filter(
        (F.col("c.quantite_suggeree") < low)
        | (F.col("c.quantite_suggeree") > high)
        | (F.col("c.quantite_min") >= F.col("c.quantite_max")))
    assert bad.count() == 0


def test_directory_defaults(spark):
    df = spark.createDataFrame([("C1", "P1", 1), ("C1", "P2", 0),
                                ("C2", "P1", 1)],
                               "code_client string, code_article string, "
                               "target_bought int")
    rows = rk.clients_directory(df, limit=1).collect()
    assert [tuple(r) for r in rows] == [("C1", 2, 1, 1.0, False)]
