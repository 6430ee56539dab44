"""Checks for catalog_proposals."""

from oracle.base import define

define("scored", """
SELECT s.*, p.is_new_product,
  CASE WHEN frequency % 5 <> 0 THEN greatest(round_even(
    median_qty * 0.75::DOUBLE + last_qty * 0.25::DOUBLE, 0), 1.0) END
    AS regressor_qty
FROM (
  SELECT * EXCLUDE (snap) FROM (
    SELECT *, row_number() OVER (PARTITION BY code_client, code_article
        ORDER BY visit_date DESC, code_facture DESC, societe DESC) AS snap,
      (sum(target_bought) OVER pair + 1)::DOUBLE
        / (count(*) OVER pair + 2) AS probabilite_achat
    FROM dataset WINDOW pair AS (PARTITION BY code_client, code_article))
  WHERE snap = 1) s
JOIN product_profile_sql p USING (code_article)""")

define("reranked", """
SELECT *, probabilite_achat * timing_boost * trend_boost AS final_score
FROM (SELECT *, CASE WHEN recency_relative >= 1.5 THEN 3.0::DOUBLE
    WHEN recency_relative >= 1.0 THEN 2.0 WHEN recency_relative >= 0.85
    THEN 1.5 ELSE 1.0 END AS timing_boost,
  CASE WHEN trend > 0.1 THEN 1.2::DOUBLE WHEN trend < -0.2 THEN 0.7
    ELSE 1.0 END AS trend_boost FROM scored)""")


def chosen_from(rows: str) -> str:
    return f"""
SELECT * EXCLUDE (u, r), CASE WHEN urgent THEN u ELSE n_urgent + r END
  AS rang, CASE WHEN urgent THEN 'urgent' ELSE 'recommande' END
  AS urgency_group
FROM (
  SELECT *, count(*) FILTER (urgent) OVER c AS n_urgent,
    count(*) FILTER (NOT urgent AND final_score > 0.65) OVER c AS n_good,
    row_number() OVER (PARTITION BY code_client, urgent
      ORDER BY final_score DESC, code_article) AS r
  FROM (SELECT *, u <= 7 AND late AS urgent FROM (
    SELECT *, row_number() OVER (PARTITION BY code_client, late
      ORDER BY final_score DESC, code_article) AS u
    FROM (SELECT *, recency_relative >= 1.0 AND final_score > 0.80 AS late
          FROM {rows})))
  WINDOW c AS (PARTITION BY code_client))
WHERE urgent OR (r <= 5 AND (final_score > 0.65
                 OR (n_urgent = 0 AND n_good = 0)))"""


def sized_from(rows: str) -> str:
    return f"""
SELECT *, greatest(lower, least(round_even(raw_pred, 0)::BIGINT, upper))
  AS quantite_suggeree, low AS quantite_min,
  CASE WHEN low >= high THEN low + greatest(1, trunc(avg_qty * 0.25)::BIGINT)
    ELSE high END AS quantite_max
FROM (
  SELECT *, greatest(lower, trunc(raw_pred * 0.75)::BIGINT) AS low,
    least(upper, trunc(raw_pred * 1.25)::BIGINT) AS high
  FROM (
    SELECT *, greatest(lower, trunc(max_qty * 2)::BIGINT, lower + 1) AS upper
    FROM (
      SELECT *, greatest(1, trunc(min_qty * 0.5)::BIGINT) AS lower,
        CASE WHEN cv > 1 OR regressor_qty IS NULL THEN ceil(avg_qty)
          ELSE regressor_qty END AS raw_pred,
        CASE WHEN cv > 1 THEN 'historique (variance trop élevée)'
          WHEN regressor_qty IS NOT NULL THEN 'IA' ELSE 'historique' END
          AS source_quantite
      FROM (SELECT *, CASE WHEN avg_qty > 0 THEN std_qty / avg_qty
              ELSE 999 END AS cv FROM {rows}))))"""


def explained_from(rows: str) -> str:
    pct = "least(99, round_even(probabilite_achat * 100, 0)::BIGINT)"
    q = "quantite_suggeree::VARCHAR"
    return f"""
SELECT *, CASE
  WHEN contains(source_quantite, 'variance') THEN 'Quantité de ' || {q}
    || ' unités basée sur la moyenne historique du client en raison '
    || 'd''achats très irréguliers. Confiance IA : ' || {pct} || '%.'
  WHEN is_new_product THEN 'Nouveau produit suggéré pour tester la gamme. '
    || 'Confiance IA : ' || {pct} || '%. Quantité recommandée : ' || {q}
    || ' unités.'
  WHEN frequency >= 5 AND recency_days <= 30 THEN
    'Client fidèle sur cet article (acheté ' || frequency
    || ' fois, dernier achat il y a ' || recency_days::BIGINT
    || ' jours). Réapprovisionnement suggéré de ' || {q}
    || ' unités (Confiance ' || {pct} || '%).'
  WHEN trend > 0.2 THEN 'Tendance à la hausse détectée pour cet article. '
    || 'Volume de ' || {q} || ' unités suggéré pour répondre à la demande '
    || '(Confiance ' || {pct} || '%).'
  WHEN trend < -0.2 THEN 'Baisse légère de la demande historique. Quantité '
    || 'prudente recommandée de ' || {q} || ' unités (Confiance ' || {pct}
    || '%).'
  ELSE 'Réassort classique de ' || {q} || ' unités basé sur l''historique '
    || 'et la saisonnalité. Confiance IA : ' || {pct} || '%.' END
  AS explication
FROM ({rows})"""


define("sized", sized_from("scored"))
define("chosen", chosen_from("reranked"))
define("explained", explained_from(sized_from("chosen")))
define("suggested", """
SELECT code_client, rang, code_article, designation, categorie,
  quantite_suggeree, quantite_min, quantite_max, source_quantite,
  round(probabilite_achat, 4) AS score_confiance,
  round(final_score, 4) AS score_final, round(timing_boost, 1)
    AS timing_boost, is_new_product AS is_nouveau_produit, explication,
  urgency_group, round(recency_relative + 1e-9, 2) AS recency_relative
FROM explained""")

SQL = {}
SQL["latest_snapshot"] = """
SELECT code_client, code_article, visit_date, code_facture, societe,
  frequency, round(avg_qty, 4) AS avg_qty, target_bought FROM scored"""
SQL["clients_directory"] = """
SELECT d.*, round(p.client_avg_basket_size, 4) AS avg_basket, g.has_gps
FROM (SELECT code_client, count(*) AS total_products,
        sum(target_bought)::BIGINT AS bought_products
      FROM dataset GROUP BY code_client) d
LEFT JOIN client_profile_sql p USING (code_client)
LEFT JOIN client_geo_sql g USING (code_client)"""
SQL["client_search"] = """
SELECT DISTINCT code_client FROM main
WHERE contains(lower(code_client), 'c12')"""
SQL["rerank"] = """
SELECT code_client, code_article,
  round(probabilite_achat, 4) AS probabilite_achat, timing_boost,
  trend_boost, round(final_score, 4) AS final_score FROM reranked"""
SQL["rerank_filtered"] = """
SELECT code_client, code_article, categorie,
  round(final_score, 4) AS final_score FROM reranked
WHERE categorie IN ('PROMO', 'SMALL', 'UNKNOWN')"""
SQL["urgency_groups"] = """
SELECT code_client, code_article, urgency_group, rang,
  round(final_score, 4) AS final_score FROM chosen"""
SQL["qty_source"] = """
SELECT code_client, code_article, round(cv, 4) AS cv, source_quantite,
  raw_pred FROM sized"""
SQL["qty_postprocess"] = """
SELECT code_client, code_article, median_qty * 0.5::DOUBLE AS raw_qty,
  greatest(round_even(median_qty * 0.5::DOUBLE, 0), 0.0) AS training_qty,
  greatest(round_even(median_qty * 0.5::DOUBLE, 0), 1.0) AS served_qty
FROM scored"""
SQL["clamp_qty"] = """
SELECT code_client, code_article, raw_pred, min_qty, max_qty,
  quantite_suggeree, quantite_min, quantite_max FROM sized"""
SQL["clamp_compare"] = """
SELECT code_client, code_article, quantite_suggeree, quantite_min,
  quantite_max, 1::BIGINT AS avant_min,
  greatest(quantite_suggeree * 3, 5) AS avant_max FROM sized"""
SQL["unusual_qty"] = """
SELECT code_client, code_article, quantite_suggeree, max_qty,
  quantite_suggeree > max_qty * 1.5 AS is_unusual FROM sized"""
SQL["explain_rules"] = "SELECT code_client, code_article, explication FROM (" \
    + explained_from("sized") + ")"
SQL["explain_prompts"] = """
SELECT code_client, code_article,
  'Tu es un assistant IA pour une équipe de vente. Rédige une phrase courte '
  || 'et professionnelle en français (15-25 mots maximum) justifiant au '
  || 'commercial pourquoi il doit recommander ce produit à son client.'
  || chr(10) || 'Client: ' || code_client || chr(10) || 'Produit: '
  || designation || ' (' || categorie || ')' || chr(10)
  || 'Quantité suggérée: ' || quantite_suggeree || ' unités' || chr(10)
  || 'Source de la quantité: ' || source_quantite || chr(10)
  || 'Score de confiance de l''IA: '
  || trunc(probabilite_achat * 100)::BIGINT || '%' || chr(10)
  || 'Historique d''achat du client pour ce produit: ' || frequency
  || ' fois acheté au total, dernier achat il y a ' || recency_days::BIGINT
  || ' jours.' || chr(10) || 'Tendance d''achat récente: '
  || CASE WHEN trend > 0 THEN 'en hausse' WHEN abs(trend) <= 0.1
       THEN 'stable' ELSE 'en baisse' END || '.' || chr(10)
  || 'Nouveau produit dans la gamme: '
  || CASE WHEN is_new_product THEN 'Oui' ELSE 'Non' END || '.' || chr(10)
  || CASE WHEN contains(source_quantite, 'variance') THEN
     'Instruction spéciale: Cette quantité est basée sur la moyenne '
     || 'historique du client car son comportement d''achat est trop '
     || 'irrégulier pour une prédiction précise — formule l''explication '
     || 'en conséquence, sans mentionner de tendance ou de prédiction IA.'
     || chr(10) ELSE '' END
  || 'Règle stricte: Retourne UNIQUEMENT l''explication, sans introduction, '
  || 'sans salutations, ni guillemets.' AS prompt
FROM sized"""
SQL["explain_keys"] = """
SELECT md5(code_client || '_' || code_article || '_8_' || quantite_suggeree
  || '_' || round_even(probabilite_achat, 2)::VARCHAR || '_'
  || source_quantite) AS context_key, count(*) AS n_uses
FROM sized GROUP BY 1"""
SQL["proposals"] = "SELECT * FROM suggested"
SQL["proposals_for_requests"] = f"""
WITH requests AS (
  SELECT CASE WHEN c_custkey % 10 = 9 THEN 'X' ELSE 'C' END || c_custkey
    AS client_id, 'R' || c_custkey % 9 AS commercial_id,
    c_custkey % 4 = 0 AS listed FROM customer),
allowed AS (
  SELECT s.* FROM reranked s JOIN requests ON client_id = code_client
  WHERE NOT listed OR categorie IN ('PROMO', 'SMALL')),
picked AS (SELECT * FROM ({sized_from("(" + chosen_from("allowed") + ")")}))
SELECT client_id, commercial_id, count(code_article) AS nb_suggestions,
  coalesce(string_agg(code_article, ',' ORDER BY rang), '') AS articles,
  coalesce(sum(quantite_suggeree), 0)::BIGINT AS total_suggested
FROM requests LEFT JOIN picked ON code_client = client_id
GROUP BY client_id, commercial_id"""
SQL["order_proposal"] = """
SELECT code_client, code_article, designation,
  substr(code_article, 1, 15) AS article_court,
  substr(designation, 1, 28) AS designation_courte,
  round(probabilite_achat * 100, 1) AS score_pct,
  CASE WHEN probabilite_achat >= 0.80
    THEN 'PRIORITE HAUTE (Achat tres probable)'
    ELSE 'PROPOSITION SECONDAIRE' END AS statut, n_analysed, n_proposed
FROM (SELECT *, count(*) OVER c AS n_analysed,
        count(*) FILTER (probabilite_achat >= 0.20) OVER c AS n_proposed
      FROM scored WINDOW c AS (PARTITION BY code_client))
WHERE probabilite_achat >= 0.20"""
SQL["proposal_cards"] = """
SELECT code_client, code_article, urgency_group,
  round(least(score_final / 3 * 100, 100) + 1e-9, 1) AS bar_width,
  CASE WHEN source_quantite = 'IA' THEN 'card-source-ia'
    ELSE 'card-source-historique' END AS card_class
FROM suggested"""
SQL["proposal_summary"] = """
SELECT s.code_client, s.rang, s.urgency_group, s.code_article,
  s.quantite_suggeree,
  CASE WHEN s.source_quantite = 'IA' THEN 'IA' ELSE 'Historique' END
    AS source_badge, c.n_urgent, c.n_recommended
FROM suggested s JOIN (
  SELECT code_client, count(*) FILTER (urgency_group = 'urgent') AS n_urgent,
    count(*) FILTER (urgency_group = 'recommande') AS n_recommended
  FROM suggested GROUP BY code_client) c USING (code_client)
WHERE s.rang <= 5"""
