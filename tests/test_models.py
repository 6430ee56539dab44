import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor

from cadenza import constants as C
from cadenza.operators import boosting, evaluation, feedback, models
from cadenza.plans.tables import Tables
from cadenza.sources.testbed import TRAIN_CUTOFF, VALIDATION_CUTOFF

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dataset(spark):
    return Tables(spark, FOLDER).dataset_stage()


def test_classifier_and_scores(spark, dataset):
    model, metrics = models.train_classifier(
        dataset, TRAIN_CUTOFF, VALIDATION_CUTOFF, trees=3, depth=3)
    row = metrics.collect()[0]
    assert 0 <= row.roc_auc <= 1 and row.n_features == 10
    assert row.rounds_fitted == 3 and row.train_rows > row.test_rows > 0
    assert 1 <= row.best_iteration == len(model.stages[-1].trees) <= 3
    table = models.importances(model, C.CLASSIFIER_FEATURES, spark, {
        "history": ["frequency", "total_qty"]})
    assert table.count() == 11
    scored = models.score(dataset.limit(50), model, None)
    assert scored.filter("probabilite_achat between 0 and 1").count() == 50


def test_best_round_waits_for_patience():
    assert models.best_round([3, 2, 1, 1, 1]) == 3
    assert models.best_round([3, 2, 2.5, 2.5, 1], patience=2) == 2
    assert models.best_round([3, 2, 2.5, 2.5, 1], patience=3) == 5


def test_regressor_learns_and_beats_its_baseline(spark):
    """Most buyers take half of their mean and a few six times as much, so
    the first tree, which fits means, is far from the least absolute error."""
    rows = spark.range(1500).selectExpr(
        "concat('C', id % 150) AS code_client", "'P' AS code_article",
        "double(4 + id % 40) AS avg_qty", "double(id % 7) AS std_qty",
        "double(4 + id % 40) AS median_qty", "1D AS min_qty",
        "90D AS max_qty", "double(id % 11) AS last_qty",
        "id % 13 AS frequency", "3D AS recency_days",
        "5D AS avg_delay_days", "1D AS current_month_coef",
        "1D AS avg_seasonal_coef",
        "(4 + id % 40) * if(hash(id) % 5 = 0, 6D, 0.5D) AS target_qty")
    model, metrics = models.train_regressor(rows, trees=40, depth=3)
    row = metrics.first()
    assert row.best_iteration > 5 and row.mae < 0.9 * row.mae_baseline
    assert (row.train_clients, row.test_clients) != (0, 0)
    assert len(model.stages[1].trees) == row.best_iteration


def test_regressor_on_log_target(dataset, tmp_path, spark):
    model, metrics = models.train_regressor(
        dataset, scale="log", trees=2, depth=3)
    row = metrics.collect()[0]
    assert row.mae > 0 and row.n_training_positives >= 100
    swept = models.sweep(dataset.limit(4), model, "last_qty", [1, 50])
    assert swept.count() == 8
    encoder = models.category_encoder(dataset)
    models.save(model, metrics, C.REGRESSOR_FEATURES, str(tmp_path),
                encoder=encoder)
    again, _, codes = models.load(spark, str(tmp_path), metrics.schema)
    assert codes.labels == encoder.labels and len(again.stages) == 3


def test_feedback_trains_on_the_state_before_its_day(spark):
    states = spark.sql(
        "SELECT 'C' AS code_client, 'P' AS code_article, "
        "date'2024-01-01' AS _day, 1L AS frequency, 4D AS avg_delay_days "
        "UNION ALL SELECT 'C', 'P', date'2024-01-10', 2L, 9D")
    rows = spark.sql(
        "SELECT cast(d AS timestamp_ntz) AS submitted_at, 'C' AS client_id, "
        "p AS code_article, a AS accepte, 7 AS quantite_finale FROM VALUES "
        "('2024-01-01 08:00', 'P', true), ('2024-01-10 09:00', 'P', true), "
        "('2024-01-11 09:00', 'P', false), ('2024-01-11 10:00', 'P', false),"
        "('2024-01-11 10:00', 'Q', true) AS t(d, p, a)")
    got = sorted((str(r.visit_date), r.frequency, r.recency_days, r.weight,
                  r.target_bought, r.target_qty)
                 for r in feedback.training_rows(rows, states).collect())
    assert got == [("2024-01-10", 1, 9.0, 1, 1, 7.0),
                   ("2024-01-11", 2, 1.0, 2, 0, 0.0)]


def test_too_few_positives(dataset):
    with pytest.raises(ValueError):
        models.train_regressor(dataset.limit(50), trees=1)


def test_unseen_category_becomes_unknown(spark):
    known = spark.createDataFrame([("B",), ("A",), (None,)],
                                  "categorie string")
    encoder = models.category_encoder(known)
    new = spark.createDataFrame([("A",), ("Z",)], "categorie string")
    got = {r.categorie: r.categorie_encoded
           for r in models.encode_categories(new, encoder).collect()}
    assert got == {"A": 0.0, "UNKNOWN": 2.0}


def average_precision(labels, bins):
    """By hand: precision at each range of scores times its recall."""
    hits = seen = total = 0.0
    for b in sorted(set(bins), reverse=True):
        own = [y for y, x in zip(labels, bins) if x == b]
        hits, seen = hits + sum(own), seen + len(own)
        total += sum(own) * hits / seen
    return total / sum(labels)


def test_staged_curve_equals_a_loop_over_cut_models(spark):
    rows = spark.range(900).selectExpr(
        "double(id % 17) AS a", "double(hash(id) % 50) AS b",
        "double(if(id % 17 > 9, hash(id, 1) % 4 <> 0, hash(id, 2) % 5 = 0)) "
        "AS label")
    data = VectorAssembler(inputCols=["a", "b"],
                           outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3,
                          subsamplingRate=0.7, seed=1).fit(data)
    got = [r["pr_auc"] for r in boosting.staged_pr_auc(
        model, data, bins=512).orderBy("round").collect()]
    want = []
    for rounds in range(1, 13):
        short = boosting.cut(model, rounds)
        assert short.getNumTrees == rounds
        assert short.treeWeights == model.treeWeights[:rounds]
        scored = short.transform(data).select(
            "label", vector_to_array("probability")[1].alias("p")).collect()
        want.append(average_precision(
            [r["label"] for r in scored],
            [min(int(512 * r["p"]), 511) for r in scored]))
    assert got == pytest.approx(want)
    assert models.best_round([-x for x in got]) == models.best_round(
        [-x for x in want])
    # ranges of scores are fine enough
    exact = evaluation.ranking_quality(model.transform(data).select(
        "label", vector_to_array("probability")[1].alias("score"))).first()
    fine = boosting.staged_pr_auc(model, data).filter("round = 12").first()
    assert fine["pr_auc"] == pytest.approx(exact["pr_auc"], abs=2e-3)


def test_cut_model_equals_the_one_fitted_so_far(spark, tmp_path):
    rows = spark.range(400).selectExpr(
        "double(id % 13) AS a", "double(hash(id) % 29) AS b",
        "double(id % 13 * 2 + hash(id, 3) % 7) AS label")
    data = VectorAssembler(inputCols=["a", "b"],
                           outputCol="features").transform(rows)
    booster = GBTRegressor(maxIter=9, maxDepth=3, seed=5, lossType="absolute",
                           featureSubsetStrategy="onethird")
    whole = booster.fit(data)
    short = boosting.cut(whole, 4)
    again = booster.copy({booster.maxIter: 4}).fit(data)

    def guesses(model):
        return [r["prediction"] for r in model.transform(data).collect()]
    assert guesses(short) == guesses(again) != guesses(whole)
    short.write().save(str(tmp_path / "short"))
    assert guesses(type(short).load(str(tmp_path / "short"))) == guesses(
        short)


def test_staged_counts_equal_sums_of_leaves_row_by_row(spark):
    """Many rounds over many rows: lists of margins, grown row by row, took
    work in the square of the rounds."""
    rows = spark.range(30000, numPartitions=2).selectExpr(
        "double(id % 17) AS a", "double(hash(id) % 50) AS b",
        "double(if(id % 17 > 9, hash(id, 1) % 4 <> 0, hash(id, 2) % 5 = 0)) "
        "AS label")
    data = VectorAssembler(inputCols=["a", "b"],
                           outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=7, maxDepth=3, stepSize=0.3, seed=1).fit(
        data)
    got = {(r["round"], r["bin"]): (r["pos"], r["n"]) for r in
           boosting.staged_counts(model, data, bins=64).collect()}
    want = {}
    for rounds in range(1, 8):
        for r in boosting.cut(model, rounds).transform(data).select(
                "label", vector_to_array("probability")[1].alias("p")
                ).collect():
            at = rounds, min(int(64 * r["p"]), 63)
            pos, n = want.get(at, (0, 0))
            want[at] = pos + r["label"], n + 1
    assert got == want
    plan = boosting.staged_counts(
        model, data)._jdf.queryExecution().toString()
    assert "array_append" not in plan and "posexplode" not in plan
