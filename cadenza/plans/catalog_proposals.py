"""Queries: scoring, selection, sizing, explanation, proposals."""

from pyspark.sql import functions as F

from cadenza.functions import quantities as qty
from cadenza.operators import (entity_features, proposals as pr,
                               ranking as rk, visits)
from cadenza.plans.registry import as_long, query, rounded
from cadenza.sources.testbed import table


@query
def latest_snapshot(t):
    rows = rk.latest_snapshot(t.latest_dataset())
    return rounded(rows.select(
        "code_client", "code_article", "visit_date", "code_facture",
        "societe", "frequency", "avg_qty", "target_bought"), "avg_qty")


@query
def clients_directory(t):
    main = t.main_stage()
    rows = visits.targets(main)
    profile = entity_features.client_profile(main).join(
        entity_features.client_geo(main), "code_client", "left")
    return rounded(rk.clients_directory(rows, profile=profile), "avg_basket")


@query
def client_search(t):
    return rk.search_clients(t.main().select("code_client").distinct(), "C12")


@query
def rerank(t):
    return rounded(rk.add_scores(t.scored()).select(
        "code_client", "code_article", "probabilite_achat", "timing_boost",
        "trend_boost", "final_score"), "probabilite_achat", "final_score")


@query
def rerank_filtered(t):
    rows = rk.allow_categories(t.scored(), ["PROMO", "SMALL", "UNKNOWN"])
    return rounded(rk.add_scores(rows).select(
        "code_client", "code_article", "categorie", "final_score"),
        "final_score")


@query
def urgency_groups(t):
    rows = rk.select_groups(rk.add_scores(t.scored()))
    return rounded(as_long(rows.select(
        "code_client", "code_article", "urgency_group", "rang",
        "final_score"), "rang"), "final_score")


@query
def qty_source(t):
    return rounded(pr.add_quantities(t.scored()).select(
        "code_client", "code_article", "cv", "source_quantite", "raw_pred"),
        "cv")


@query
def qty_postprocess(t):
    """Model quantity rounded half to even, floors 0 and 1."""
    raw = F.col("median_qty") * 0.5
    return t.scored().select(
        "code_client", "code_article", raw.alias("raw_qty"),
        qty.served_quantity(raw, 0).alias("training_qty"),
        qty.served_quantity(raw, 1).alias("served_qty"))


@query
def clamp_qty(t):
    return as_long(pr.add_quantities(t.scored()).select(
        "code_client", "code_article", "raw_pred", "min_qty", "max_qty",
        "quantite_suggeree", "quantite_min", "quantite_max"),
        "quantite_suggeree", "quantite_min", "quantite_max")


@query
def clamp_compare(t):
    return as_long(pr.compare_bounds(pr.add_quantities(t.scored())).select(
        "code_client", "code_article", "quantite_suggeree", "quantite_min",
        "quantite_max", "avant_min", "avant_max"),
        "quantite_suggeree", "quantite_min", "quantite_max", "avant_min",
        "avant_max")


@query
def unusual_qty(t):
    return as_long(pr.flag_unusual(pr.add_quantities(t.scored())).select(
        "code_client", "code_article", "quantite_suggeree", "max_qty",
        "is_unusual"), "quantite_suggeree")


@query
def explain_rules(t):
    return pr.add_explanations(pr.add_quantities(t.scored())).select(
        "code_client", "code_article", "explication")


@query
def explain_prompts(t):
    return pr.add_prompts(pr.add_quantities(t.scored())).select(
        "code_client", "code_article", "prompt")


@query
def explain_keys(t):
    return pr.explanation_keys(pr.add_quantities(t.scored()), 8)


@query
def proposals(t):
    """Order proposal of every client, one row per suggestion."""
    return as_long(pr.suggestions(t.scored()), "rang", "quantite_suggeree",
                   "quantite_min", "quantite_max")


@query
def proposals_for_requests(t):
    """Requests of all customers, some unknown, some with a category list."""
    key = F.col("c_custkey")
    requests = table(t.spark, t.sf_dir, "customer").select(
        F.concat(F.when(key % 10 == 9, F.lit("X")).otherwise(F.lit("C")),
                 key.cast("string")).alias("client_id"),
        F.concat(F.lit("R"), (key % 9).cast("string"))
        .alias("commercial_id"),
        F.when(key % 4 == 0, F.array(F.lit("PROMO"), F.lit("SMALL")))
        .otherwise(F.array().cast("array<string>"))
        .alias("filter_categories"))
    answers = pr.answer_requests(requests, t.scored(), "2001-08-02 00:00:00")
    return answers.select(
        "client_id", "commercial_id",
        F.col("nb_suggestions").cast("long").alias("nb_suggestions"),
        F.array_join(F.transform("suggestions",
                                 lambda s: s["code_article"]), ",")
        .alias("articles"),
        F.aggregate("suggestions", F.lit(0).cast("long"),
                    lambda a, s: a + s["quantite_suggeree"])
        .alias("total_suggested"))


@query
def order_proposal(t):
    return rk.order_proposal(t.scored(), 0.20)


@query
def proposal_cards(t):
    return pr.cards(pr.suggestions(t.scored()))


@query
def proposal_summary(t):
    return as_long(pr.summary(pr.suggestions(t.scored())), "rang",
                   "quantite_suggeree")
