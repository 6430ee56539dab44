"""Checks for catalog_feedback."""

from oracle.base import define

define("fb", """
SELECT ts AS submitted_at, 'C' || user_id AS client_id,
  'R' || event_id % 9 AS commercial_id,
  CASE WHEN event_id % 2 = 0 THEN 'F' || event_id ELSE '' END
    AS code_facture, code_article, accepte, quantite_finale, modifie,
  strftime(ts, '%Y-%m') AS date_visite_mois
FROM (
  SELECT *, event_type AS code_article, event_type = 'purchase' AS accepte,
    ceil(value)::INTEGER AS quantite_finale, event_id % 4 = 0 AS modifie
  FROM events
  UNION ALL
  SELECT *, 'Brand#' || (event_id % 25 + 1), value > 20,
    floor(value)::INTEGER, event_id % 5 = 0
  FROM events WHERE event_id % 3 = 0)""")

define("fb_sessions", """
SELECT client_id, min(submitted_at) AS session_start,
  max(submitted_at) + INTERVAL 6 HOUR AS session_end, count(*) AS n_items,
  count(*) FILTER (accepte) AS n_accepted
FROM (SELECT *, sum(opens) OVER w AS island FROM (
        SELECT *, (submitted_at >= coalesce(lag(submitted_at) OVER w
          + INTERVAL 6 HOUR, TIMESTAMP '1900-01-01'))::INTEGER AS opens
        FROM fb WINDOW w AS (PARTITION BY client_id ORDER BY submitted_at))
      -- default frame: items of one instant are peers of one session
      WINDOW w AS (PARTITION BY client_id ORDER BY submitted_at))
GROUP BY client_id, island""")

define("fb_days", """
SELECT date_trunc('day', submitted_at)::TIMESTAMP AS window_start,
  count(*) AS n_items, count(*) FILTER (accepte) AS n_accepted,
  count(*) FILTER (modifie) AS n_modified,
  round(avg(accepte::INTEGER), 4) AS acceptance_rate
FROM fb GROUP BY 1""")

define("newcomers", """
SELECT g.* FROM gps g WHERE latitude IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM main m WHERE m.code_client = g.code_client
  AND m.societe = g.societe)""")

define("near", """
SELECT * FROM (
  SELECT n.code_client, k.code_client AS neighbour, distance_km,
    row_number() OVER (PARTITION BY n.code_client
      ORDER BY distance_km, k.code_client) AS rang
  FROM newcomers n JOIN client_geo_sql k
    ON k.has_gps AND k.code_client <> n.code_client,
  LATERAL (SELECT 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0,
      pow(sin((radians(k.latitude) - radians(n.latitude)) / 2), 2)
      + cos(radians(n.latitude)) * cos(radians(k.latitude))
      * pow(sin(radians(k.longitude - n.longitude) / 2), 2))))
    AS distance_km) d)
WHERE rang <= 5""")

SQL = {}
SQL["feedback_flatten"] = "SELECT * FROM fb"
SQL["feedback_append"] = """
SELECT date_visite_mois, count(*) AS n_items,
  sum(quantite_finale)::BIGINT AS total_qty,
  count(DISTINCT client_id) AS n_clients
FROM fb GROUP BY date_visite_mois"""
SQL["feedback_load"] = """
SELECT * FROM fb WHERE submitted_at >= TIMESTAMP '2024-01-15'"""
SQL["feedback_batches"] = SQL["feedback_load"]
SQL["feedback_stats"] = " UNION ALL ".join(f"""
SELECT '{key}' AS level, {key} AS value, count(*) AS n_items,
  count(*) FILTER (accepte) AS n_accepted,
  count(*) FILTER (modifie) AS n_modified,
  round(avg(accepte::INTEGER), 4) AS acceptance_rate,
  round(avg(modifie::INTEGER), 4) AS modification_rate
FROM fb GROUP BY {key}""" for key in ("client_id", "code_article",
                                      "date_visite_mois"))
SQL["acceptance_windows"] = """
SELECT 'day' AS kind, window_start,
  window_start + INTERVAL 1 DAY AS window_end, n_items, n_accepted,
  n_modified, acceptance_rate FROM fb_days
UNION ALL
SELECT 'week', s, s + INTERVAL 7 DAY, count(*), count(*) FILTER (accepte),
  count(*) FILTER (modifie), round(avg(accepte::INTEGER), 4)
FROM (SELECT fb.*, (date_trunc('day', submitted_at)
        - to_days(back::INTEGER))::TIMESTAMP AS s
      FROM fb, range(0, 7) AS r(back))
GROUP BY s"""
SQL["visit_sessions"] = "SELECT * FROM fb_sessions"
SQL["feedback_stream"] = """
SELECT date_visite_mois, count(*) AS n_items,
  count(*) FILTER (accepte) AS n_accepted,
  sum(quantite_finale)::BIGINT AS total_qty FROM fb GROUP BY 1"""
SQL["acceptance_stream"] = """
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, n_items,
  n_accepted, n_modified, acceptance_rate FROM fb_days
WHERE window_start + INTERVAL 1 DAY
  <= (SELECT max(submitted_at) - INTERVAL 2 DAY FROM fb)"""
SQL["acceptance_week_stream"] = """
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end,
  count(*) AS n_items, count(*) FILTER (accepte) AS n_accepted,
  count(*) FILTER (modifie) AS n_modified,
  round(avg(accepte::INTEGER), 4) AS acceptance_rate
FROM (SELECT *, (date_trunc('day', submitted_at)
        - to_days(k::INTEGER))::TIMESTAMP AS window_start
      FROM fb, range(7) AS r(k))
GROUP BY window_start HAVING window_start + INTERVAL 7 DAY
  <= (SELECT max(submitted_at) - INTERVAL 2 DAY FROM fb)"""
SQL["session_stream"] = """
SELECT * FROM fb_sessions
WHERE session_end <= (SELECT max(submitted_at) - INTERVAL 2 DAY FROM fb)"""
SQL["feedback_dedup"] = """
SELECT client_id, count(*) AS n_items,
  sum(quantite_finale)::BIGINT AS total_qty
FROM (SELECT DISTINCT client_id, code_facture, code_article, submitted_at,
        quantite_finale FROM fb) GROUP BY client_id"""
SQL["pair_state_stream"] = """
SELECT client_id, code_article, count(*) AS n_orders,
  sum(quantite_finale)::BIGINT AS total_qty,
  min(submitted_at)::DATE AS first_date, max(submitted_at)::DATE AS last_date,
  round(CASE WHEN count(*) > 1 THEN date_diff('day',
    min(submitted_at)::DATE, max(submitted_at)::DATE)::DOUBLE
    / (count(*) - 1) END, 4) AS avg_gap_days
FROM fb GROUP BY client_id, code_article"""
SQL["cold_start_neighbours"] = """
SELECT code_client, neighbour, rang, round(distance_km, 4) AS distance_km
FROM near"""
SQL["cold_start_clients"] = """
SELECT * FROM (
  SELECT n.code_client, m.code_article, sum(q) AS total_qty,
    count(*) AS n_neighbours, row_number() OVER (PARTITION BY n.code_client
      ORDER BY sum(q) DESC, m.code_article) AS rang
  FROM near n JOIN (SELECT code_client, code_article, sum(quantite) AS q
                    FROM main GROUP BY ALL) m ON m.code_client = n.neighbour
  GROUP BY n.code_client, m.code_article)
WHERE rang <= 5"""
SQL["cold_start_product_rows"] = """
SELECT * FROM (SELECT r.code_client, r.categorie, r.n_orders, p.code_article,
    p.days_since_first_order::BIGINT AS days_since_first_order,
    row_number() OVER (PARTITION BY r.code_client
      ORDER BY p.days_since_first_order, r.n_orders DESC, p.code_article)
      AS rang
  FROM (SELECT code_client, categorie,
          count(DISTINCT (code_facture, societe)) AS n_orders
        FROM main GROUP BY ALL
        HAVING count(DISTINCT (code_facture, societe)) >= 3) r
  JOIN product_profile_sql p USING (categorie) WHERE p.is_new_product)
WHERE rang <= 5"""
SQL["cold_start_products"] = """
SELECT r.code_client, r.categorie, r.n_orders, l.new_products,
  l.n_new_products
FROM (SELECT code_client, categorie,
        count(DISTINCT (code_facture, societe)) AS n_orders
      FROM main GROUP BY ALL HAVING count(DISTINCT (code_facture, societe))
        >= 3) r
JOIN (SELECT categorie, string_agg(code_article, ',' ORDER BY code_article)
        AS new_products, count(*) AS n_new_products
      FROM product_profile_sql WHERE is_new_product GROUP BY categorie) l
  USING (categorie)"""
