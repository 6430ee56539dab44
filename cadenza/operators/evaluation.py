"""Splits, weights and quality reports on score tables."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza import constants as C
from cadenza.functions import quantities as qty
from cadenza.operators.ordered import (as_struct_scalar, quantiles,
                                       running_totals)
from cadenza.operators.sampling import client_bucket
from cadenza.session import write_and_read


class EmptySplit(ValueError):
    """Validation or test part has no rows for the given dates."""


# -- splits ------------------------------------------------------------------

def temporal_part(train_cutoff: str, validation_cutoff: str) -> Column:
    day = F.col("visit_date")
    return (F.when(day <= F.lit(train_cutoff).cast("date"), "train")
            .when(day <= F.lit(validation_cutoff).cast("date"), "validation")
            .otherwise("test"))


def temporal_split(df: DataFrame, train_cutoff: str = C.TRAIN_CUTOFF,
                   validation_cutoff: str = C.VALIDATION_CUTOFF) -> DataFrame:
    """Add ``part``: train, validation or test by visit date."""
    return df.withColumn("part", temporal_part(train_cutoff,
                                               validation_cutoff))


def require_parts(split: DataFrame) -> DataFrame:
    """Fail when validation or test is empty; reads one row per part."""
    seen = {r["part"] for r in split.select("part").distinct().collect()}
    missing = {"validation", "test"} - seen
    if missing:
        raise EmptySplit(f"no rows in {sorted(missing)}")
    return split


def group_split(df: DataFrame, test_share: float = 0.2,
                validation_share: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``part`` so that all rows of a client share one part."""
    client = F.col("code_client")
    inner = validation_share / (1 - test_share)
    return df.withColumn("part", F.when(
        client_bucket(client, seed) < int(round(test_share * 1000)), "test")
        .when(client_bucket(client, seed + 1) < int(round(inner * 1000)),
              "validation")
        .otherwise("train"))


def split_sizes(split: DataFrame) -> DataFrame:
    per_client = split.groupBy("part", "code_client").agg(
        F.count("*").alias("_n"), F.min("visit_date").alias("_a"),
        F.max("visit_date").alias("_b"))
    return per_client.groupBy("part").agg(
        F.sum("_n").alias("n_rows"), F.count("*").alias("n_clients"),
        F.min("_a").alias("date_min"), F.max("_b").alias("date_max"))


def leak_check(split: DataFrame) -> DataFrame:
    """Clients shared by train and test and the parts' date borders.

    Rows are reduced to one per client before the shuffle.
    """
    def border(part, pick):
        return pick(F.when(F.col("part") == part, F.col("visit_date")))

    def seen(part):
        return F.count_if(F.col("part") == part) > 0

    clients = split.groupBy("code_client").agg(
        border("train", F.max).alias("train_max"),
        border("validation", F.min).alias("validation_min"),
        border("test", F.min).alias("test_min"),
        (seen("train") & seen("test")).alias("_shared"))
    return clients.agg(
        F.max("train_max").alias("train_max"),
        F.min("validation_min").alias("validation_min"),
        F.min("test_min").alias("test_min"),
        F.count_if("_shared").alias("shared_clients"))


def class_weight(train: DataFrame) -> DataFrame:
    row = train.agg(
        F.count_if(F.col("target_bought") == 0).alias("n_negative"),
        F.count_if(F.col("target_bought") == 1).alias("n_positive"))
    return row.withColumn(
        "scale_pos_weight", F.col("n_negative") / F.greatest(
            F.col("n_positive"), F.lit(1)))


# -- classification ----------------------------------------------------------

def ranking_quality(scores: DataFrame, score: str = "score",
                    label: str = "label") -> DataFrame:
    """ROC-AUC and average precision, exact under ties.

    Rows are first counted per distinct score, then running totals are taken
    in score ranges, so no task sorts the whole table.
    """
    counts = write_and_read(scores.groupBy(score).agg(
        F.sum(label).cast("long").alias("pos"),
        (F.count("*") - F.sum(label)).cast("long").alias("neg")),
        "score-counts")
    totals = counts.agg(F.sum("pos").cast("double").alias("p"),
                        F.sum("neg").cast("double").alias("n"))
    placed = running_totals(counts, score, ["pos", "neg"]).withColumn(
        "_t", as_struct_scalar(totals, "p", "n"))
    p, n = F.col("_t.p"), F.col("_t.n")
    above_pos = p - F.col("pos_before")
    above = above_pos + n - F.col("neg_before")
    return placed.agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
              / (p * n)).alias("roc_auc"),
        F.sum(F.col("pos") / p * above_pos / above).alias("pr_auc"),
        F.max(p).cast("long").alias("n_positive"),
        F.max(n).cast("long").alias("n_negative"))


def confusion(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    predicted = (F.col("score") >= threshold).cast("int")
    return scores.groupBy(F.col("label").cast("int").alias("label"),
                          predicted.alias("predicted")).agg(
        F.count("*").alias("n"))


def classification_report(scores: DataFrame,
                          threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted."""
    table = confusion(scores, threshold)
    def cell(y, z):
        return F.coalesce(F.sum(F.when(
            (F.col("label") == y) & (F.col("predicted") == z),
            F.col("n"))), F.lit(0)).cast("double")

    row = table.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                    cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    row = row.withColumns({
        "p0": ratio(tn, tn + fn), "r0": ratio(tn, tn + fp),
        "p1": ratio(tp, tp + fp), "r1": ratio(tp, tp + fn),
        "s0": tn + fp, "s1": fn + tp})
    row = row.withColumns({
        "f0": ratio(2 * F.col("p0") * F.col("r0"),
                    F.col("p0") + F.col("r0")),
        "f1": ratio(2 * F.col("p1") * F.col("r1"),
                    F.col("p1") + F.col("r1"))})
    whole = F.col("s0") + F.col("s1")
    def line(name, p, r, f, s):
        return F.struct(F.lit(name).alias("label"), p.alias("precision"),
                        r.alias("recall"), f.alias("f1"),
                        s.cast("long").alias("support"))

    def mean(a, b):
        return (F.col(a) + F.col(b)) / 2

    def weighted(a, b):
        return (F.col(a) * F.col("s0") + F.col(b) * F.col("s1")) / whole

    accuracy = (tn + tp) / whole
    return row.select(F.inline(F.array(
        line("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        line("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        line("accuracy", accuracy, accuracy, accuracy, whole),
        line("macro avg", mean("p0", "p1"), mean("r0", "r1"),
             mean("f0", "f1"), whole),
        line("weighted avg", weighted("p0", "p1"), weighted("r0", "r1"),
             weighted("f0", "f1"), whole))))


# -- regression --------------------------------------------------------------

def _mae(truth: Column, guess: Column) -> Column:
    return F.avg(F.abs(truth - guess))


def _rmse(truth: Column, guess: Column) -> Column:
    return F.sqrt(F.avg((truth - guess) * (truth - guess)))


def regression_report(rows: DataFrame, truth: str = "target_qty",
                      guess: str = "prediction",
                      baseline: str = "avg_qty") -> DataFrame:
    """MAE and RMSE of a prediction and a baseline, and the gain in percent."""
    y, p, b = F.col(truth), F.col(guess), F.col(baseline)
    return rows.agg(
        F.count("*").alias("n_rows"),
        _mae(y, p).alias("mae"), _rmse(y, p).alias("rmse"),
        _mae(y, b).alias("mae_baseline"), _rmse(y, b).alias("rmse_baseline"),
    ).withColumns({
        "improvement_mae_pct": (F.col("mae_baseline") - F.col("mae"))
        / F.col("mae_baseline") * 100,
        "improvement_rmse_pct": (F.col("rmse_baseline") - F.col("rmse"))
        / F.col("rmse_baseline") * 100})


def error_quantiles(rows: DataFrame, truth: str = "target_qty",
                    guess: str = "prediction") -> DataFrame:
    errors = rows.select(F.abs(F.col(truth) - F.col(guess)).alias("error"))
    return quantiles(errors, "error", {"p50": .5, "p90": .9, "p99": .99})


def with_variation(rows: DataFrame) -> DataFrame:
    """Add ``cv`` and the historical quantity ceil(avg)."""
    return rows.withColumns({
        "cv": qty.variation(F.col("std_qty"), F.col("avg_qty")),
        "historic_qty": F.ceil("avg_qty").cast("double")})


def _above(threshold: float) -> Column:
    return qty.varies_more(F.col("qty_dispersion"), F.col("total_qty"),
                           threshold)


def threshold_report(rows: DataFrame,
                     thresholds: tuple[float, ...] = (1.0, 0.8)) -> DataFrame:
    """Error of the baseline, the model and the hybrid per CV threshold."""
    df = with_variation(rows)
    y, model, hist = F.col("target_qty"), F.col("prediction"), F.col(
        "historic_qty")
    guesses = {"baseline": hist, "model": model} | {
        f"hybrid_cv_{t}": F.when(_above(t), hist).otherwise(model)
        for t in thresholds}
    row = df.agg(*[
        measure(y, guess).alias(f"{name}|{kind}")
        for name, guess in guesses.items()
        for kind, measure in (("mae", _mae), ("rmse", _rmse))])
    base = F.col("`baseline|mae`")
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(name).alias("approach"), F.col(f"`{name}|mae`").alias("mae"),
        F.col(f"`{name}|rmse`").alias("rmse"),
        ((base - F.col(f"`{name}|mae`")) / base * 100).alias("gain_pct"))
        for name in guesses])))


def threshold_curve(rows: DataFrame) -> DataFrame:
    """Error of the hybrid at every threshold of the variation.

    Only the variations that occur matter: above the threshold the mean
    quantity is taken, up to it the model.  Sums of both errors per distinct
    variation and their running totals give all thresholds in one pass.  The
    threshold -1 stands for the mean quantity everywhere, and of any other
    number the error is that of the largest threshold up to it.
    """
    total, spread = F.col("total_qty"), F.col("qty_dispersion")
    cv = F.when(total > 0, F.sqrt(spread) / total).otherwise(
        F.lit(C.CV_UNDEFINED))
    y, sums = F.col("target_qty"), {}
    for name, guess in (("model", F.col("prediction")),
                        ("history", F.ceil("avg_qty").cast("double"))):
        sums[f"{name}_abs"] = F.sum(F.abs(y - guess))
        sums[f"{name}_sq"] = F.sum((y - guess) * (y - guess))
    sums["n"] = F.count(F.lit(1))
    counts = write_and_read(rows.groupBy(cv.alias("threshold")).agg(
        *[c.alias(n) for n, c in sums.items()]), "variation-sums")
    whole = as_struct_scalar(counts.agg(*[F.sum(n).alias(n) for n in sums]),
                             *sums)
    placed = running_totals(counts, "threshold", list(sums)).select(
        "threshold", *[(F.col(f"{n}_before") + F.col(n)).alias(n)
                       for n in sums])
    none = counts.limit(1).select(
        F.lit(-1.0).alias("threshold"),
        *[F.lit(0).cast(counts.schema[n].dataType).alias(n) for n in sums])
    all_rows = placed.unionByName(none).withColumn("_t", whole)

    def mean(kind: str) -> Column:
        return (F.col(f"model_{kind}") + F.col(f"_t.history_{kind}")
                - F.col(f"history_{kind}")) / F.col("_t.n")
    curve = all_rows.select(
        "threshold", mean("abs").alias("mae"),
        F.sqrt(mean("sq")).alias("rmse"),
        (F.col("_t.n") - F.col("n")).alias("n_history"))
    best = curve.agg(F.min_by("threshold", F.struct("mae", "threshold")))
    return curve.withColumn("is_best", F.col("threshold") == best.scalar())


def frontier_report(rows: DataFrame, low: float = 0.8,
                    high: float = 1.0) -> DataFrame:
    """Rows whose source changes between the two thresholds."""
    df = with_variation(rows)
    edge = _above(low) & ~_above(high)
    y = F.when(edge, F.col("target_qty"))
    model, hist = F.col("prediction"), F.col("historic_qty")
    return df.agg(
        F.count_if(edge).alias("n_frontier"), F.count("*").alias("n_rows"),
        _mae(y, model).alias("mae_model"), _rmse(y, model).alias("rmse_model"),
        _mae(y, hist).alias("mae_history"),
        _rmse(y, hist).alias("rmse_history"),
    ).withColumns({
        "share_pct": F.col("n_frontier") * 100.0 / F.col("n_rows"),
        "winner": F.when(F.col("mae_model") > F.col("mae_history"),
                         "history").otherwise("model")})


def switch_report(rows: DataFrame, low: float = 0.8, high: float = 1.0,
                  shown: int = 5) -> DataFrame:
    """Per client the rows by threshold band and the first switched rows."""
    df = with_variation(rows)
    edge = _above(low) & ~_above(high)
    counts = df.groupBy("code_client").agg(
        F.count("*").alias("n_rows"),
        F.count_if(_above(high)).alias("n_history_both"),
        F.count_if(~_above(low)).alias("n_model_both"),
        F.count_if(edge).alias("n_switched"))
    order = Window.partitionBy("code_client").orderBy(
        "visit_date", "code_facture", "societe", "code_article")
    first = (df.filter(edge).withColumn("position",
                                        F.row_number().over(order))
             .filter(F.col("position") <= shown)
             .select("code_client", "position", "code_article", "cv",
                     "prediction", "historic_qty", "target_qty"))
    return counts.join(first, "code_client", "left")


def case_rows(dataset: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Last bought visit row of the given (or all) pairs."""
    keys = ["code_client", "code_article"]
    rows = dataset if pairs is None else dataset.join(pairs, keys,
                                                      "left_semi")
    latest = Window.partitionBy(*keys).orderBy(
        F.desc("visit_date"), F.desc("code_facture"), F.desc("societe"))
    return (rows.filter(F.col("target_bought") == 1)
            .withColumn("_rank", F.row_number().over(latest))
            .filter(F.col("_rank") == 1).drop("_rank"))
