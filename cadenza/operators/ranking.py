"""Latest snapshots, business re-ranking and selection per client."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza import constants as C
from cadenza.functions import scoring
from cadenza.operators.pair_features import PAIR

SNAPSHOT_ORDER = ["visit_date", "code_facture", "societe"]


def latest_snapshot(dataset: DataFrame) -> DataFrame:
    """Last visit row of every pair; one row per pair leaves each map task."""
    window = Window.partitionBy(*PAIR).orderBy(
        *[F.desc(c) for c in SNAPSHOT_ORDER])
    return (dataset.withColumn("_rank", F.row_number().over(window))
            .filter(F.col("_rank") == 1).drop("_rank"))


def latest_with_rate(dataset: DataFrame) -> DataFrame:
    """Latest snapshot with the pair's smoothed reorder rate.

    (bought + 1) / (visits + 2) stands in for a model's probability wherever
    a deterministic score is wanted.  Of a dataset with one row per pair and
    the counts ``n_bought`` and ``n_visits`` (``visits.latest_dataset``) the
    counts are taken.
    """
    if {"n_bought", "n_visits"} <= set(dataset.columns):
        return dataset.withColumn("probabilite_achat", (
            F.col("n_bought") + 1) / (F.col("n_visits") + 2)).drop(
            "n_bought", "n_visits")
    columns = [c for c in dataset.columns if c not in PAIR]
    grouped = dataset.groupBy(*PAIR).agg(
        F.max_by(F.struct(*columns), F.struct(*SNAPSHOT_ORDER)).alias("_s"),
        F.sum("target_bought").alias("_bought"),
        F.count("*").alias("_visits"))
    return grouped.select(
        *PAIR, "_s.*",
        ((F.col("_bought") + 1) / (F.col("_visits") + 2))
        .alias("probabilite_achat"))


def add_scores(scored: DataFrame) -> DataFrame:
    return scored.withColumns({
        "timing_boost": scoring.timing_boost(F.col("recency_relative")),
        "trend_boost": scoring.trend_boost(F.col("trend")),
        "final_score": scoring.final_score(
            F.col("probabilite_achat"), F.col("recency_relative"),
            F.col("trend")),
    })


def allow_categories(scored: DataFrame,
                     categories: list[str] | None) -> DataFrame:
    if not categories:
        return scored
    return scored.filter(F.col("categorie").isin(*categories))


def allow_requested(scored: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of requesting clients whose category the request allows."""
    wanted = requests.select(F.col("client_id").alias("code_client"),
                             "filter_categories")
    listed = F.coalesce(F.size("filter_categories"), F.lit(0)) > 0
    return (scored.join(wanted, "code_client")
            .filter(~listed | F.array_contains(
                F.col("filter_categories"), F.col("categorie")))
            .drop("filter_categories"))


def select_groups(ranked: DataFrame, urgent_cap: int = C.URGENT_CAP,
                  recommended_cap: int = C.RECOMMENDED_CAP) -> DataFrame:
    """Urgent and recommended products of every client, ranked.

    Urgent: overdue and score > 0.80, best ``urgent_cap``.  Recommended: the
    rest with score > 0.65, best ``recommended_cap``.  A client left with
    neither gets its best ``recommended_cap``.  Whatever is chosen lies among
    the best urgent_cap + recommended_cap rows of the client's overdue or
    other rows, so all further rows are dropped before the shuffle and the
    windows see a fixed number of rows per client.
    """
    keep = urgent_cap + recommended_cap
    best = [F.desc("final_score"), F.asc("code_article")]
    overdue = F.coalesce(
        (F.col("recency_relative") >= C.URGENT_RECENCY)
        & (F.col("final_score") > C.URGENT_SCORE), F.lit(False))
    side = Window.partitionBy("code_client", "_overdue").orderBy(*best)
    short = (ranked.withColumn("_overdue", overdue)
             .withColumn("_side", F.row_number().over(side))
             .filter(F.col("_side") <= keep))
    urgent = F.col("_overdue") & (F.col("_side") <= urgent_cap)
    client = Window.partitionBy("code_client")
    rest = client.orderBy("_urgent", *best)
    picked = short.withColumn("_urgent", urgent).withColumns({
        "_rest": F.row_number().over(rest),
        "_n_urgent": F.count_if("_urgent").over(client),
        "_n_good": F.count_if(
            ~F.col("_urgent")
            & (F.col("final_score") > C.RECOMMENDED_SCORE)).over(client),
    })
    good = F.col("final_score") > C.RECOMMENDED_SCORE
    nothing = (F.col("_n_urgent") == 0) & (F.col("_n_good") == 0)
    recommended = (~F.col("_urgent") & (F.col("_rest") <= recommended_cap)
                   & (good | nothing))
    chosen = picked.filter(F.col("_urgent") | recommended)
    rank = F.when(F.col("_urgent"), F.col("_side")).otherwise(
        F.least(F.col("_n_urgent"), F.lit(urgent_cap)) + F.col("_rest"))
    return (chosen
            .withColumn("urgency_group", F.when(
                F.col("_urgent"), C.GROUP_URGENT).otherwise(C.GROUP_RECOMMENDED))
            .withColumn("rang", rank.cast("int"))
            .drop("_overdue", "_side", "_urgent", "_rest", "_n_urgent",
                  "_n_good"))


def order_proposal(scored: DataFrame, threshold: float = 0.50) -> DataFrame:
    """Rows at or above a probability, with a priority label and counts."""
    probability = F.col("probabilite_achat")
    chosen = probability >= threshold
    counts = scored.groupBy("code_client").agg(
        F.count("*").alias("n_analysed"),
        F.count_if(chosen).alias("n_proposed"))
    return (scored.filter(chosen).join(counts, "code_client").select(
        "code_client", "code_article", "designation",
        # cut for printing only
        F.substring("code_article", 1, 15).alias("article_court"),
        F.substring("designation", 1, 28).alias("designation_courte"),
        F.round(probability * 100, 1).alias("score_pct"),
        F.when(probability >= C.HIGH_PRIORITY_PROBABILITY, C.PRIORITY_HIGH)
        .otherwise(C.PRIORITY_SECONDARY).alias("statut"),
        "n_analysed", "n_proposed"))


def clients_directory(dataset: DataFrame, limit: int | None = None,
                      profile: DataFrame | None = None) -> DataFrame:
    """Candidate rows and purchases per client, most active first.

    ``profile`` has one row per client with ``client_avg_basket_size`` and
    ``has_gps``; without it, or for a client it lacks, the columns of
    ``dataset`` are used if present, else the basket is 1 and the flag false.
    """
    columns = dataset.columns
    basket = (F.max("client_avg_basket_size")
              if "client_avg_basket_size" in columns else F.lit(1.0))
    gps = F.max("has_gps") if "has_gps" in columns else F.lit(False)
    out = dataset.groupBy("code_client").agg(
        F.count("code_article").alias("total_products"),
        F.sum("target_bought").alias("bought_products"),
        basket.alias("avg_basket"), gps.alias("has_gps"))
    if profile is not None:
        known = profile.select(
            "code_client", F.col("client_avg_basket_size").alias("_basket"),
            F.col("has_gps").alias("_gps"))
        out = out.join(known, "code_client", "left").select(
            "code_client", "total_products", "bought_products",
            F.coalesce("_basket", "avg_basket").alias("avg_basket"),
            F.coalesce("_gps", "has_gps").alias("has_gps"))
    out = out.orderBy(F.desc("bought_products"), F.desc("total_products"),
              "code_client")
    return out.limit(limit) if limit else out


def search_clients(clients: DataFrame, text: str) -> DataFrame:
    return clients.filter(
        F.lower("code_client").contains(text.lower())) if text else clients
