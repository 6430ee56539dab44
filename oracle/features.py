"""Checks for catalog_features.

Visit features are recomputed by joining every visit with all earlier lines.
"""

from oracle.base import define

REF = "DATE '2001-08-02'"

# lines of a pair numbered in (date, quantity) order
define("pair_rows", """
SELECT code_client, code_article, date_commande, quantite, mois, societe,
  row_number() OVER pair AS pos, count(*) OVER (
    PARTITION BY code_client, code_article) AS n
FROM main
WINDOW pair AS (PARTITION BY code_client, code_article
                ORDER BY date_commande, quantite)""")

define("pair_month", """
SELECT code_client, code_article, mois, avg(quantite) AS mean_qty,
  count(*) AS n_lines
FROM main GROUP BY ALL""")

define("pair_season_sql", """
SELECT code_client, code_article,
  sum(coef * n_lines) / sum(n_lines) AS avg_seasonal_coef_matrix,
  sum(coef * mean_qty) / greatest(sum(mean_qty), 1)
    AS avg_seasonal_coef_visit,
  arg_min(mois, (-mean_qty, mois)) AS best_month
FROM pair_month JOIN season ON mois = m GROUP BY ALL""")

define("pair_trend_sql", """
SELECT code_client, code_article, CASE WHEN count(*) < 2 THEN 0.0 ELSE
  (avg(quantite) FILTER (pos > n // 2) - avg(quantite) FILTER (pos <= n // 2))
  / (avg(quantite) FILTER (pos <= n // 2) + 1e-6) END AS trend
FROM pair_rows GROUP BY ALL""")

define("pair_gap_sql", f"""
SELECT code_client, code_article, count(*) AS frequency,
  date_diff('day', max(date_commande), {REF}) AS recency_days,
  coalesce(avg(date_diff), 30.0) AS avg_delay_days
FROM (SELECT *, date_diff('day', lag(date_commande) OVER (
        PARTITION BY code_client, code_article
        ORDER BY date_commande, quantite), date_commande) AS date_diff
      FROM main)
GROUP BY ALL""")

define("client_geo_sql", """
SELECT code_client,
  arg_min(latitude, societe) FILTER (latitude IS NOT NULL) AS latitude,
  arg_min(longitude, societe) FILTER (latitude IS NOT NULL) AS longitude,
  count(latitude) > 0 AS has_gps
FROM main GROUP BY code_client""")

define("client_profile_sql", """
SELECT code_client, count(DISTINCT code_article) AS client_total_products,
  count(DISTINCT (code_facture, societe)) AS client_total_invoices,
  count(DISTINCT (code_facture, societe, code_article))::DOUBLE
    / count(DISTINCT (code_facture, societe)) AS client_avg_basket_size
FROM main GROUP BY code_client""")

define("product_mode", """
SELECT code_article, categorie FROM (
  SELECT code_article, categorie, row_number() OVER (
    PARTITION BY code_article ORDER BY count(*) DESC, categorie) AS r
  FROM main GROUP BY code_article, categorie) WHERE r = 1""")

define("product_profile_sql", f"""
SELECT p.*, m.categorie FROM (
  SELECT code_article,
    arg_min(designation, (date_commande, designation)) AS designation,
    bool_or(is_bulk_order) AS is_bulk_product,
    count(DISTINCT code_client) AS nb_clients,
    date_diff('day', min(date_commande), {REF}) AS days_since_first_order,
    date_diff('day', min(date_commande), {REF}) <= 90 AS is_new_product
  FROM main GROUP BY code_article) p
LEFT JOIN product_mode m USING (code_article)""")

define("matrix", """
SELECT code_client, code_article, s.avg_qty, s.median_qty, s.std_qty,
  s.min_qty, s.max_qty, s.total_qty, g.frequency, s.last_qty, g.recency_days,
  g.avg_delay_days, g.recency_days / CASE WHEN g.avg_delay_days = 0 THEN 30
    ELSE g.avg_delay_days END AS recency_relative, t.trend, c.company_encoded,
  1.20::DOUBLE AS current_month_coef,
  z.avg_seasonal_coef_matrix AS avg_seasonal_coef, z.best_month, l.has_gps,
  l.latitude, l.longitude, p.categorie, p.designation, p.is_bulk_product,
  p.nb_clients, p.days_since_first_order, p.is_new_product,
  b.client_total_products, b.client_total_invoices, b.client_avg_basket_size
FROM (
  SELECT code_client, code_article, avg(quantite) AS avg_qty,
    median(quantite) AS median_qty,
    coalesce(stddev_samp(quantite), 0) AS std_qty, min(quantite) AS min_qty,
    max(quantite) AS max_qty, sum(quantite) AS total_qty,
    arg_max(quantite, (date_commande, quantite)) AS last_qty
  FROM main GROUP BY ALL) s
JOIN pair_gap_sql g USING (code_client, code_article)
JOIN pair_trend_sql t USING (code_client, code_article)
JOIN (SELECT code_client, code_article, CASE
        arg_min(societe, (date_commande, societe)) WHEN 'CO1' THEN 0
        WHEN 'CO2' THEN 1 WHEN 'CO3' THEN 2 END AS company_encoded
      FROM main GROUP BY ALL) c USING (code_client, code_article)
JOIN pair_season_sql z USING (code_client, code_article)
JOIN client_geo_sql l USING (code_client)
JOIN client_profile_sql b USING (code_client)
JOIN product_profile_sql p USING (code_article)""")

define("visit_list", """
SELECT code_facture, societe, min(code_client) AS code_client,
  min(date_commande) AS visit_date
FROM main GROUP BY code_facture, societe""")

define("visit_hist", """
SELECT v.code_facture, v.societe, v.code_client, v.visit_date,
  count(h.quantite) AS history_lines,
  coalesce(sum(h.quantite), 0.0) AS history_qty,
  max(h.date_commande) AS history_last_date
FROM visit_list v LEFT JOIN main h ON h.code_client = v.code_client
  AND h.date_commande < v.visit_date
GROUP BY ALL""")

# every earlier line of every (client, visit day)
define("day_hist", """
SELECT d.code_client, d.visit_date, h.code_article, h.date_commande,
  h.quantite, h.mois, h.categorie, h.designation,
  row_number() OVER w AS pos,
  count(*) OVER (PARTITION BY d.code_client, d.visit_date, h.code_article)
    AS n,
  date_diff('day', lag(h.date_commande) OVER w, h.date_commande) AS gap
FROM (SELECT DISTINCT code_client, visit_date FROM visit_list) d
JOIN main h ON h.code_client = d.code_client
  AND h.date_commande < d.visit_date
WINDOW w AS (PARTITION BY d.code_client, d.visit_date, h.code_article
             ORDER BY h.date_commande, h.quantite)""")

define("day_month", """
SELECT code_client, visit_date, code_article,
  sum(coef * mean_qty) / greatest(sum(mean_qty), 1) AS avg_seasonal_coef,
  arg_min(mois, (-mean_qty, mois)) AS best_month
FROM (SELECT code_client, visit_date, code_article, mois,
        avg(quantite) AS mean_qty FROM day_hist GROUP BY ALL)
JOIN season ON mois = m GROUP BY ALL""")

define("day_feat", """
SELECT d.code_client, d.visit_date, d.code_article,
  arg_min(categorie, (date_commande, categorie, designation)) AS categorie,
  arg_min(designation, (date_commande, categorie, designation))
    AS designation,
  avg(quantite) AS avg_qty, median(quantite) AS median_qty,
  stddev_pop(quantite) AS std_qty,
  count(*) * sum(quantite * quantite) - sum(quantite) * sum(quantite)
    AS qty_dispersion, min(quantite) AS min_qty,
  max(quantite) AS max_qty, sum(quantite) AS total_qty,
  count(*) AS frequency,
  arg_max(quantite, pos) AS last_qty,
  date_diff('day', max(date_commande), d.visit_date)::DOUBLE AS recency_days,
  greatest(coalesce(avg(gap), 30.0), 1.0) AS avg_delay_days,
  date_diff('day', max(date_commande), d.visit_date)
    / greatest(coalesce(avg(gap), 30.0), 1.0) AS recency_relative,
  CASE WHEN count(*) < 2 THEN 0.0 ELSE
    (avg(quantite) FILTER (pos > n // 2)
     - avg(quantite) FILTER (pos <= n // 2))
    / (avg(quantite) FILTER (pos <= n // 2) + 1e-6) END AS trend,
  max(z.avg_seasonal_coef) AS avg_seasonal_coef,
  max(z.best_month) AS best_month, max(s.coef) AS current_month_coef
FROM day_hist d
JOIN day_month z USING (code_client, visit_date, code_article)
JOIN season s ON s.m = month(d.visit_date)
GROUP BY d.code_client, d.visit_date, d.code_article""")

define("sold_sql", """
SELECT code_facture, societe, code_article, sum(quantite) AS sold
FROM main GROUP BY ALL""")

define("dataset", """
SELECT v.code_facture, v.societe, f.*,
  (s.sold IS NOT NULL)::INTEGER AS target_bought,
  coalesce(s.sold, 0.0) AS target_qty
FROM visit_hist v
JOIN day_feat f ON f.code_client = v.code_client
  AND f.visit_date = v.visit_date
LEFT JOIN sold_sql s ON s.code_facture = v.code_facture
  AND s.societe = v.societe AND s.code_article = f.code_article
WHERE v.history_lines >= 3""")

SQL = {}

SQL["pair_qty_stats"] = """
SELECT code_client, code_article, round(avg(quantite), 4) AS avg_qty,
  median(quantite) AS median_qty, min(quantite) AS min_qty,
  max(quantite) AS max_qty, sum(quantite) AS total_qty,
  count(quantite) AS frequency
FROM main GROUP BY ALL"""

SQL["pair_std_both"] = """
SELECT code_client, code_article,
  round(coalesce(stddev_samp(quantite), 0), 4) AS std_qty_matrix,
  round(stddev_pop(quantite), 4) AS std_qty_visit
FROM main GROUP BY ALL"""

SQL["pair_last_qty"] = """
SELECT code_client, code_article, quantite AS last_qty FROM pair_rows
WHERE pos = n"""

SQL["pair_recency"] = f"""
SELECT code_client, code_article, max(date_commande) AS last_date,
  date_diff('day', max(date_commande), {REF}) AS recency_days
FROM main GROUP BY ALL"""

SQL["order_gaps"] = """
SELECT code_client, code_article, date_commande, quantite, quantite_lag1,
  date_diff, count(*) AS n_lines
FROM (
  SELECT code_client, code_article, date_commande, quantite,
    lag(quantite) OVER w AS quantite_lag1,
    date_diff('day', lag(date_commande) OVER w, date_commande) AS date_diff
  FROM main
  WINDOW w AS (PARTITION BY code_client, code_article
               ORDER BY date_commande, quantite))
GROUP BY ALL"""

SQL["line_gaps"] = """
SELECT code_client, code_article, code_facture, societe, date_commande,
  quantite, lag(date_commande) OVER w AS previous_date,
  date_diff('day', lag(date_commande) OVER w, date_commande) AS gap_days
FROM main
WINDOW w AS (PARTITION BY code_client, code_article
             ORDER BY date_commande, quantite, code_facture, societe)"""

SQL["pair_cadence"] = """
SELECT code_client, code_article, frequency, recency_days,
  round(avg_delay_days, 4) AS avg_delay_days,
  round(greatest(avg_delay_days, 1), 4) AS avg_delay_days_visit,
  round(recency_days / CASE WHEN avg_delay_days = 0 THEN 30
        ELSE avg_delay_days END, 4) AS recency_relative,
  round(recency_days / greatest(avg_delay_days, 1), 4)
    AS recency_relative_visit,
  recency_days / CASE WHEN avg_delay_days = 0 THEN 30
        ELSE avg_delay_days END >= 1 AS is_overdue
FROM pair_gap_sql"""

SQL["pair_trend"] = """
SELECT code_client, code_article, round(trend, 4) AS trend
FROM pair_trend_sql"""

SQL["pair_company"] = """
SELECT code_client, code_article, societe,
  (substr(societe, 3)::BIGINT - 1) AS company_encoded
FROM (SELECT code_client, code_article,
        arg_min(societe, (date_commande, societe)) AS societe
      FROM main GROUP BY ALL)"""

SQL["pair_season"] = """
SELECT code_client, code_article,
  round(avg_seasonal_coef_matrix, 4) AS avg_seasonal_coef_matrix,
  round(avg_seasonal_coef_visit, 4) AS avg_seasonal_coef_visit,
  1.20::DOUBLE AS current_month_coef
FROM pair_season_sql"""

SQL["pair_best_month"] = """
SELECT code_client, code_article, best_month::BIGINT AS best_month
FROM pair_season_sql"""

SQL["pair_cv"] = """
SELECT code_client, code_article, round(avg(quantite), 4) AS avg_qty,
  round(coalesce(stddev_samp(quantite), 0) / avg(quantite), 4) AS cv_matrix,
  round(stddev_pop(quantite) / avg(quantite), 4) AS cv_visit
FROM main GROUP BY ALL"""

SQL["season_lookup"] = """
SELECT mois::BIGINT AS mois, societe, count(*) AS n_invoices,
  max(s.coef) AS month_coef, max(u.coef) AS unmapped_coef,
  coalesce(max(u.coef), 1.0::DOUBLE) AS unmapped_default,
  substr(societe, 3)::BIGINT - 1 AS company_encoded
FROM inv JOIN season s ON s.m = mois LEFT JOIN season u ON u.m = mois + 6
GROUP BY mois, societe"""

SQL["cyclic_month"] = """
SELECT mois::BIGINT AS mois, count(*) AS n_invoices,
  round(sin(2 * pi() * mois / 12), 4) AS month_sin,
  round(cos(2 * pi() * mois / 12), 4) AS month_cos
FROM inv GROUP BY mois"""

SQL["client_geo"] = "SELECT * FROM client_geo_sql"
SQL["product_profile"] = "SELECT * FROM product_profile_sql"
SQL["client_profile"] = """
SELECT * REPLACE (round(client_avg_basket_size, 4) AS client_avg_basket_size)
FROM client_profile_sql"""

SQL["feature_matrix"] = """
SELECT * REPLACE (round(avg_qty, 4) AS avg_qty, round(std_qty, 4) AS std_qty,
  round(avg_delay_days, 4) AS avg_delay_days,
  round(recency_relative, 4) AS recency_relative, round(trend, 4) AS trend,
  round(avg_seasonal_coef, 4) AS avg_seasonal_coef,
  round(client_avg_basket_size, 4) AS client_avg_basket_size,
  company_encoded::BIGINT AS company_encoded,
  best_month::BIGINT AS best_month)
FROM matrix"""

SQL["negative_pairs"] = """
WITH product_pos AS (
  SELECT code_article, row_number() OVER (ORDER BY
    ('0x' || substr(md5(code_article), 1, 12))::BIGINT, code_article) - 1
    AS position, count(*) OVER () AS n_products
  FROM (SELECT DISTINCT code_article FROM main)),
client_n AS (
  SELECT code_client, count(*) AS n,
    ('0x' || substr(md5(code_client), 1, 12))::BIGINT AS draw,
    arg_min(company_encoded, code_article) AS company_encoded,
    max(has_gps) AS has_gps, max(latitude) AS latitude,
    max(longitude) AS longitude,
    max(client_total_products) AS client_total_products,
    max(client_total_invoices) AS client_total_invoices,
    max(client_avg_basket_size) AS client_avg_basket_size
  FROM matrix GROUP BY code_client),
free AS (
  SELECT c.*, p.code_article, row_number() OVER (PARTITION BY c.code_client
    ORDER BY (p.position - c.draw % p.n_products + p.n_products)
             % p.n_products) AS pick
  FROM client_n c CROSS JOIN product_pos p
  WHERE NOT EXISTS (SELECT 1 FROM matrix k
    WHERE k.code_client = c.code_client AND k.code_article = p.code_article))
SELECT f.code_client, f.code_article, 0.0::DOUBLE AS avg_qty,
  0.0::DOUBLE AS median_qty, 0.0::DOUBLE AS std_qty, 0.0::DOUBLE AS min_qty,
  0.0::DOUBLE AS max_qty, 0.0::DOUBLE AS total_qty, 0::BIGINT AS frequency,
  0.0::DOUBLE AS last_qty, 9999.0::DOUBLE AS recency_days,
  999.0::DOUBLE AS avg_delay_days,
  round(9999.0::DOUBLE / 999.0::DOUBLE, 4) AS recency_relative,
  0.0::DOUBLE AS trend, f.company_encoded::BIGINT AS company_encoded,
  1.20::DOUBLE AS current_month_coef, 1.0::DOUBLE AS avg_seasonal_coef,
  -1::BIGINT AS best_month, f.has_gps, f.latitude, f.longitude,
  p.categorie, p.designation, p.is_bulk_product, p.nb_clients,
  p.days_since_first_order, p.is_new_product, f.client_total_products,
  f.client_total_invoices,
  round(f.client_avg_basket_size, 4) AS client_avg_basket_size
FROM free f JOIN product_profile_sql p USING (code_article)
WHERE pick <= 3 * n"""

SQL["visits"] = "SELECT * FROM visit_list"
SQL["eligible_visits"] = """
SELECT code_facture, societe, code_client, visit_date, history_lines
FROM visit_hist WHERE history_lines >= 3"""
SQL["visit_history"] = "SELECT * FROM visit_hist"
SQL["visit_state_asof"] = """
SELECT code_client, code_article, visit_date, count(*) AS frequency,
  arg_max(quantite, pos) AS last_qty, max(date_commande) AS last_date
FROM day_hist GROUP BY code_client, code_article, visit_date"""
SQL["visit_candidates"] = """
SELECT v.code_facture, v.societe, v.code_client, v.visit_date,
  v.history_lines, d.code_article, count(*) AS appearances
FROM visit_hist v JOIN day_hist d USING (code_client, visit_date)
WHERE v.history_lines >= 3 GROUP BY ALL HAVING count(*) >= 2"""
SQL["visit_features"] = """
SELECT * EXCLUDE (target_bought, target_qty) REPLACE (
  round(avg_qty, 4) AS avg_qty, round(std_qty, 4) AS std_qty,
  round(avg_delay_days, 4) AS avg_delay_days,
  round(recency_relative, 4) AS recency_relative, round(trend, 4) AS trend,
  round(avg_seasonal_coef, 4) AS avg_seasonal_coef,
  best_month::BIGINT AS best_month)
FROM dataset"""
SQL["visit_increments"] = """
SELECT * REPLACE (
  round(avg_qty, 4) AS avg_qty, round(std_qty, 4) AS std_qty,
  round(avg_delay_days, 4) AS avg_delay_days,
  round(recency_relative, 4) AS recency_relative, round(trend, 4) AS trend,
  round(avg_seasonal_coef, 4) AS avg_seasonal_coef,
  best_month::BIGINT AS best_month, target_bought::BIGINT AS target_bought)
FROM dataset"""
SQL["visit_targets"] = """
SELECT code_facture, societe, code_client, code_article, visit_date,
  target_bought::BIGINT AS target_bought, target_qty FROM dataset"""
SQL["visit_summary"] = """
SELECT count(*) AS visits_total,
  count(*) FILTER (history_lines < 3) AS skipped_no_history,
  0::BIGINT AS skipped_no_candidates,
  (SELECT count(*) FROM dataset) AS rows_built,
  (SELECT sum(target_bought)::BIGINT FROM dataset) AS positives,
  (SELECT round(avg(target_bought) * 100, 4) FROM dataset) AS positive_rate
FROM visit_hist"""
SQL["positives"] = """
SELECT count(*) AS n_rows, count(*) FILTER (target_qty > 0) AS n_positives,
  sum(target_qty) AS total_qty,
  count(*) FILTER (target_qty > 0) >= 100 AS enough_to_train,
  round(count(*) FILTER (target_qty > 0) * 100.0::DOUBLE / count(*), 4)
    AS positive_share
FROM dataset"""
