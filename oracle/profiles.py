"""Checks for catalog_profiles."""

from oracle.base import define

define("wide", """
SELECT l.code_facture, l.quantite, l.code_article, l.designation,
  l.categorie, l.societe_ligne, l.is_bulk_order, i.code_client,
  i.date_commande, i.ref_commercial, i.societe, i.mois, i.annee,
  i.annee_mois, i.jour_semaine, i.trimestre, g.latitude, g.longitude
FROM lin l
LEFT JOIN inv i ON l.code_facture = i.code_facture
  AND l.societe_ligne = i.societe
LEFT JOIN gps g ON i.code_client = g.code_client AND i.societe = g.societe""")

define("months", """
SELECT annee, mois, count(DISTINCT (code_facture, societe)) AS nb_commandes,
  sum(quantite) AS total_qte, count(DISTINCT code_client) AS nb_clients,
  count(*) AS nb_lignes
FROM main GROUP BY annee, mois""")

define("weeks", """
SELECT w.week_end, count(DISTINCT CASE WHEN m.code_facture IS NOT NULL
    THEN (m.code_facture, m.societe) END) AS nb_commandes,
  coalesce(sum(m.quantite), 0.0) AS total_qte,
  count(DISTINCT m.code_client) AS nb_clients,
  count(m.code_facture) AS nb_lignes
FROM (SELECT unnest(generate_series(
        min(date_trunc('week', date_commande)) + INTERVAL 6 DAY,
        max(date_trunc('week', date_commande)) + INTERVAL 6 DAY,
        INTERVAL 7 DAY))::DATE AS week_end FROM main) w
LEFT JOIN main m
  ON (date_trunc('week', m.date_commande) + INTERVAL 6 DAY)::DATE = w.week_end
GROUP BY w.week_end""")

define("month_profile", """
SELECT mois, avg(nb_commandes) AS avg_commandes, avg(total_qte) AS avg_qte,
  stddev_samp(nb_commandes) AS std_commandes,
  avg(nb_commandes) / avg(avg(nb_commandes)) OVER () AS seasonal_index
FROM months GROUP BY mois""")

define("cat_months", """
SELECT categorie, annee, mois, count(*) AS nb_lignes FROM main
WHERE categorie IN (SELECT categorie FROM main GROUP BY categorie
                    ORDER BY count(*) DESC, categorie LIMIT 5)
GROUP BY ALL""")

define("weekdays", """
SELECT d.jour_semaine, d.day_name, w.nb_commandes, w.total_qte
FROM (VALUES (0::BIGINT, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'),
  (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday'))
  AS d(jour_semaine, day_name)
LEFT JOIN (SELECT jour_semaine,
    count(DISTINCT (code_facture, societe)) AS nb_commandes,
    sum(quantite) AS total_qte FROM main GROUP BY jour_semaine) w
  USING (jour_semaine)""")

define("series", """
SELECT annee, mois, nb_commandes::DOUBLE AS observed,
  row_number() OVER (ORDER BY annee, mois) AS i FROM months""")

define("centred", """
SELECT s.*, (SELECT CASE WHEN count(*) = 13 THEN
    sum(CASE WHEN abs(o.i - s.i) = 6 THEN 0.5::DOUBLE ELSE 1.0 END
        * o.observed) / 12 END
  FROM series o WHERE abs(o.i - s.i) <= 6) AS inner_trend
FROM series s""")

define("fitted", """
SELECT c.*, CASE
  WHEN i < (SELECT min(i) FROM centred WHERE inner_trend IS NOT NULL) THEN
    (SELECT regr_slope(inner_trend, i) * c.i + regr_intercept(inner_trend, i)
     FROM (SELECT * FROM centred WHERE inner_trend IS NOT NULL
           ORDER BY i LIMIT 12))
  WHEN i > (SELECT max(i) FROM centred WHERE inner_trend IS NOT NULL) THEN
    (SELECT regr_slope(inner_trend, i) * c.i + regr_intercept(inner_trend, i)
     FROM (SELECT * FROM centred WHERE inner_trend IS NOT NULL
           ORDER BY i DESC LIMIT 12))
  ELSE inner_trend END AS trend
FROM centred c""")

define("parts", """
SELECT f.annee, f.mois, f.observed, f.trend, p.season - z.centre AS seasonal,
  f.observed - f.trend - (p.season - z.centre) AS resid,
  f.inner_trend IS NOT NULL AS is_interior
FROM fitted f
JOIN (SELECT (i - 1) % 12 AS phase, avg(observed - trend) AS season
      FROM fitted GROUP BY 1) p ON p.phase = (f.i - 1) % 12
CROSS JOIN (SELECT avg(season) AS centre FROM (
  SELECT avg(observed - trend) AS season FROM fitted
  GROUP BY (i - 1) % 12)) z""")

SQL = {}

_WIDE = ["code_facture", "quantite", "code_article", "designation",
         "categorie", "societe_ligne", "is_bulk_order", "code_client",
         "date_commande", "ref_commercial", "societe", "mois", "annee",
         "annee_mois", "jour_semaine", "trimestre", "latitude", "longitude"]
SQL["null_report"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, "
    f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS pct "
    f"FROM wide HAVING count(*) > count({c})" for c in _WIDE)

SQL["dup_report"] = """
SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates,
  count(*) FILTER (n > 1) AS n_repeated_keys,
  round(sum(n - 1) * 100.0::DOUBLE / sum(n), 4) AS pct
FROM (SELECT count(*) AS n FROM raw_lin
      GROUP BY code_facture, societe_ligne, code_article)"""

SQL["describe_qty"] = """
SELECT count(quantite) AS n, round(avg(quantite), 4) AS mean,
  round(stddev_samp(quantite), 4) AS std, min(quantite) AS min,
  quantile_cont(quantite, 0.25) AS p25, quantile_cont(quantite, 0.5) AS p50,
  quantile_cont(quantite, 0.75) AS p75, max(quantite) AS max
FROM main"""

SQL["qty_thresholds"] = """
SELECT count(*) AS n_rows, count(*) FILTER (quantite <= 0) AS n_not_positive,
  count(*) FILTER (quantite > 100) AS n_over_100,
  count(*) FILTER (quantite > 500) AS n_over_500,
  count(*) FILTER (quantite > 1000) AS n_over_1000,
  count(*) FILTER (quantite <= 10) AS n_up_to_10,
  count(*) FILTER (quantite <= 50) AS n_up_to_50,
  round(count(*) FILTER (quantite <= 10) * 100.0::DOUBLE / count(*), 4)
    AS pct_up_to_10,
  round(count(*) FILTER (quantite <= 50) * 100.0::DOUBLE / count(*), 4)
    AS pct_up_to_50
FROM raw_lin"""

SQL["qty_quantiles"] = """
SELECT round(quantile_cont(quantite, 0.5), 4) AS p50,
  round(quantile_cont(quantite, 0.9), 4) AS p90,
  round(quantile_cont(quantite, 0.95), 4) AS p95,
  round(quantile_cont(quantite, 0.99), 4) AS p99, max(quantite) AS max
FROM main"""

SQL["sketched_months"] = """
SELECT strftime(date_commande, '%Y-%m') AS period, count(*) AS n_lines,
  sum(quantite) AS total_qty,
  count(DISTINCT code_client) AS exact_code_client,
  count(DISTINCT code_article) AS exact_code_article,
  count(DISTINCT code_facture) AS exact_code_facture,
  true AS code_client_within, true AS code_article_within,
  true AS code_facture_within, true AS p50_within, true AS p90_within,
  true AS p99_within
FROM main GROUP BY 1"""
SQL["key_numbers"] = """
SELECT count(*) AS n_lines, round(avg(quantite), 4) AS avg_qty_line,
  min(date_commande) AS date_min, max(date_commande) AS date_max,
  count(DISTINCT (code_facture, societe)) AS n_invoices,
  count(DISTINCT code_client) AS n_clients,
  count(DISTINCT code_article) AS n_products,
  count(DISTINCT categorie) AS n_categories,
  count(DISTINCT ref_commercial) AS n_salespeople,
  count(DISTINCT code_client) FILTER (latitude IS NOT NULL)
    AS clients_with_gps,
  count(DISTINCT code_client) - count(DISTINCT code_client)
    FILTER (latitude IS NOT NULL) AS clients_without_gps,
  round(count(DISTINCT (code_facture, societe))::DOUBLE
    / count(DISTINCT code_client), 4) AS avg_invoices_client,
  round(count(*)::DOUBLE / count(DISTINCT (code_facture, societe)), 4)
    AS avg_lines_invoice
FROM main"""

SQL["gps_coverage"] = """
SELECT count(*) AS n_clients, count(*) FILTER (located) AS with_any_gps,
  count(*) FILTER (missing) AS with_missing_gps,
  count(*) FILTER (NOT missing) AS fully_located,
  round(count(*) FILTER (NOT missing) * 100.0::DOUBLE / count(*), 4)
    AS pct_fully_located
FROM (SELECT code_client, bool_or(latitude IS NOT NULL) AS located,
        bool_or(latitude IS NULL) AS missing FROM main GROUP BY 1)"""

SQL["value_counts"] = """
(SELECT 'categorie' AS column_name, categorie AS value, count(*) AS n
 FROM raw_lin GROUP BY categorie ORDER BY n DESC, value NULLS LAST LIMIT 15)
UNION ALL
(SELECT 'societe_ligne', societe_ligne, count(*) AS n FROM raw_lin
 GROUP BY societe_ligne ORDER BY n DESC, 2 NULLS LAST LIMIT 15)"""

_CADENCE = """
SELECT code_client, count(*) AS n_days, min(date_commande) AS first_order,
  max(date_commande) AS last_order,
  round(avg(gap), 4) AS avg_days_between_orders
FROM (SELECT code_client, date_commande, date_diff('day',
        lag(date_commande) OVER (PARTITION BY code_client
          ORDER BY date_commande), date_commande) AS gap
      FROM (SELECT DISTINCT code_client, date_commande FROM main))
GROUP BY code_client"""
SQL["client_cadence"] = _CADENCE

SQL["client_behaviour"] = f"""
SELECT a.*, c.first_order, c.last_order, c.avg_days_between_orders
FROM (SELECT code_client,
        count(DISTINCT (code_facture, societe)) AS nb_invoices,
        count(DISTINCT code_article) AS nb_products,
        sum(quantite) AS total_qty FROM main GROUP BY code_client) a
JOIN ({_CADENCE}) c USING (code_client)"""

SQL["monthly_activity"] = """
SELECT * REPLACE (annee::BIGINT AS annee, mois::BIGINT AS mois)
FROM months"""
SQL["weekly_activity"] = "SELECT * FROM weeks"
SQL["weekly_rolling"] = "SELECT *, " + ", ".join(
    f"CASE WHEN count(*) OVER w = 4 THEN round(avg({c}) OVER w, 4) END "
    f"AS {c}_ma" for c in ("nb_commandes", "total_qte", "nb_clients")) + """
FROM weeks WINDOW w AS (ORDER BY week_end
  ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""
SQL["week_outliers"] = """
SELECT week_end, nb_commandes, total_qte, round(z, 4) AS z FROM (
  SELECT *, (nb_commandes - avg(nb_commandes) OVER ())
    / stddev_samp(nb_commandes) OVER () AS z FROM weeks)
WHERE abs(z) > 2"""

SQL["day_coverage"] = """
SELECT count(DISTINCT date_commande) AS active_days,
  min(date_commande) AS date_min, max(date_commande) AS date_max,
  date_diff('day', min(date_commande), max(date_commande)) AS calendar_days,
  round(count(DISTINCT date_commande) * 100.0::DOUBLE
    / date_diff('day', min(date_commande), max(date_commande)), 4)
    AS coverage_pct,
  date_diff('day', min(date_commande), max(date_commande)) + 1
    - count(DISTINCT date_commande) AS days_without_orders,
  (date_diff('day', min(date_commande), max(date_commande)) + 1) // 7 * 2
    AS weekend_days_estimate
FROM main"""

SQL["gap_days"] = """
SELECT day FROM (SELECT unnest(generate_series(min(date_commande),
  max(date_commande), INTERVAL 1 DAY))::DATE AS day FROM main)
WHERE day NOT IN (SELECT date_commande FROM main)"""

SQL["month_year_pivot"] = "SELECT mois::BIGINT AS mois, " + ", ".join(
    f'max(nb_commandes) FILTER (annee = {y}) AS "{y}_cmd", '
    f'max(total_qte) FILTER (annee = {y}) AS "{y}_qte"'
    for y in range(1995, 2002)) + " FROM months GROUP BY mois"

SQL["sparsity"] = """
SELECT count(*) FILTER (q > 0) AS non_zero,
  count(DISTINCT code_client) AS n_clients,
  count(DISTINCT code_article) AS n_products,
  count(DISTINCT code_client) * count(DISTINCT code_article) AS total_cells,
  count(DISTINCT code_client) * count(DISTINCT code_article)
    - count(*) FILTER (q > 0) AS zero_cells,
  round(100.0::DOUBLE * (count(DISTINCT code_client)
    * count(DISTINCT code_article) - count(*) FILTER (q > 0))
    / (count(DISTINCT code_client) * count(DISTINCT code_article)), 4)
    AS sparsity_pct,
  'dense' AS density_class
FROM (SELECT code_client, code_article, sum(quantite) AS q FROM main
      GROUP BY ALL)"""

_CORR = ["avg_qty", "std_qty", "total_qty", "frequency", "last_qty",
         "recency_days", "avg_delay_days", "trend", "client_total_products",
         "client_total_invoices", "client_avg_basket_size"]
SQL["feature_corr"] = " UNION ALL ".join(
    f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, "
    f"round(corr({x}, {y}), 4) AS corr FROM matrix"
    for i, x in enumerate(_CORR) for y in _CORR[i + 1:])

_BINS = {"frequency": (30, 30), "recency_days": (365, 35),
         "avg_qty": (150, 50), "client_total_invoices": (50, 50),
         "last_qty": (500, 100)}
SQL["histograms"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, least(floor(least(greatest("
    f"{c}::DOUBLE, 0), {hi}) / ({hi}::DOUBLE / {n})), {n - 1})::BIGINT "
    f"AS bin, count(*) AS n FROM matrix GROUP BY 2"
    for c, (hi, n) in _BINS.items())

SQL["client_month_intensity"] = """
SELECT annee_mois, count(*) AS active_clients,
  round(avg(n), 4) AS avg_orders_per_client
FROM (SELECT annee_mois, code_client,
        count(DISTINCT (code_facture, societe)) AS n FROM main GROUP BY 1, 2)
GROUP BY annee_mois"""

SQL["active_clients_summary"] = """
SELECT round(avg(n), 4) AS mean_clients, max(n) AS max_clients,
  arg_min(annee_mois, (-n, annee_mois)) AS max_month, min(n) AS min_clients,
  arg_min(annee_mois, (n, annee_mois)) AS min_month,
  round(stddev_samp(n) / avg(n) * 100, 4) AS cov_pct
FROM (SELECT annee_mois, count(DISTINCT code_client) AS n FROM main
      GROUP BY 1)"""

SQL["mom_yoy"] = """
SELECT annee::BIGINT AS annee, mois::BIGINT AS mois, nb_commandes,
  round((nb_commandes::DOUBLE / lag(nb_commandes, 1) OVER w - 1) * 100, 4)
    AS mom_pct,
  round((nb_commandes::DOUBLE / lag(nb_commandes, 12) OVER w - 1) * 100, 4)
    AS yoy_pct
FROM months WINDOW w AS (ORDER BY annee, mois)"""

SQL["seasonal_profile"] = """
SELECT mois::BIGINT AS mois, round(avg_commandes, 4) AS avg_commandes,
  round(avg_qte, 4) AS avg_qte, round(std_commandes, 4) AS std_commandes
FROM month_profile"""
SQL["seasonal_index"] = """
SELECT mois::BIGINT AS mois, round(avg_commandes, 4) AS avg_commandes,
  round(seasonal_index, 4) AS seasonal_index FROM month_profile"""
SQL["month_cv"] = """
SELECT mois::BIGINT AS mois,
  round(std_commandes / avg_commandes * 100, 4) AS cv_pct
FROM month_profile"""
SQL["seasonal_norm"] = """
SELECT annee::BIGINT AS annee, mois::BIGINT AS mois,
  round(nb_commandes / avg(nb_commandes) OVER (PARTITION BY annee), 4)
    AS seasonal_index
FROM months"""
SQL["month_vs_mean"] = """
SELECT mois::BIGINT AS mois, round(avg(quantite), 4) AS avg_qty,
  round((SELECT avg(quantite) FROM main), 4) AS overall_avg,
  avg(quantite) > (SELECT avg(quantite) FROM main) AS above_mean
FROM main GROUP BY mois"""
SQL["top_category_rows"] = """
SELECT * REPLACE (annee::BIGINT AS annee, mois::BIGINT AS mois)
FROM cat_months"""
SQL["category_season"] = """
SELECT categorie, mois::BIGINT AS mois, round(avg(nb_lignes), 4)
  AS avg_lignes, round(avg(nb_lignes) / avg(avg(nb_lignes)) OVER (
    PARTITION BY categorie), 4) AS seasonal_index
FROM cat_months GROUP BY categorie, mois"""
SQL["category_season_all"] = """
SELECT categorie, mois::BIGINT AS mois, round(avg(nb_lignes), 4)
  AS avg_lignes, round(avg(nb_lignes) / avg(avg(nb_lignes)) OVER (
    PARTITION BY categorie), 4) AS seasonal_index
FROM (SELECT categorie, annee, mois, count(*) AS nb_lignes FROM main
      GROUP BY ALL) GROUP BY categorie, mois"""
SQL["weekday_profile"] = "SELECT * FROM weekdays"
SQL["weekday_share"] = """
SELECT *, round(nb_commandes * 100.0::DOUBLE / sum(nb_commandes) OVER (), 4)
  AS share_pct
FROM weekdays WHERE nb_commandes IS NOT NULL"""
SQL["seasonal_decompose"] = """
SELECT annee::BIGINT AS annee, mois::BIGINT AS mois, observed,
  round(trend, 4) AS trend, round(seasonal, 4) AS seasonal,
  round(resid, 4) AS resid, is_interior FROM parts"""
SQL["seasonal_strength"] = """
SELECT round(var_pop(seasonal), 4) AS var_seasonal,
  round(var_pop(resid), 4) AS var_resid,
  round(greatest(0, 1 - var_pop(resid)
    / (var_pop(seasonal) + var_pop(resid))), 4) AS strength
FROM parts"""
SQL["kruskal_h"] = """
WITH ranks AS (
  SELECT mois, nb_commandes, rank() OVER (ORDER BY nb_commandes)
    + (count(*) OVER (PARTITION BY nb_commandes) - 1) / 2.0::DOUBLE AS r
  FROM months),
ties AS (SELECT sum(t * t * t - t)::DOUBLE AS s FROM (
  SELECT count(*) AS t FROM months GROUP BY nb_commandes)),
size AS (SELECT count(*)::DOUBLE AS n FROM months)
SELECT round(h, 4) AS h_stat, df, n::BIGINT AS n_months,
  round(tail / whole, 4) AS p_value, tail / whole < 0.05 AS is_seasonal
FROM (
  SELECT h, df, n,
    (SELECT sum(pow(h + (i + 0.5::DOUBLE) * 0.01::DOUBLE, df / 2 - 1)
       * exp(-(h + (i + 0.5::DOUBLE) * 0.01::DOUBLE) / 2))
     FROM range(0, 40000) AS r(i)) AS tail,
    (SELECT sum(pow((i + 0.5::DOUBLE) * 0.01::DOUBLE, df / 2 - 1)
       * exp(-((i + 0.5::DOUBLE) * 0.01::DOUBLE) / 2))
     FROM range(0, 40000) AS r(i)) AS whole
  FROM (SELECT (12 / (n * (n + 1)) * sum(q) - 3 * (n + 1))
          / (1 - s / (n * n * n - n)) AS h, count(*) - 1 AS df, n
        FROM (SELECT mois, sum(r) * sum(r) / count(*) AS q
              FROM ranks GROUP BY mois), ties, size
        GROUP BY n, s))"""
SQL["acf"] = """
WITH dev AS (SELECT i, observed - avg(observed) OVER () AS d FROM series)
SELECT l.lag::BIGINT AS lag, round(sum(a.d * b.d)
  / (SELECT sum(d * d) FROM dev), 4) AS acf
FROM (SELECT unnest(range(0, (SELECT least(24, count(*) // 2 - 1) + 1
        FROM series))) AS lag) l
JOIN dev a ON true JOIN dev b ON b.i = a.i + l.lag
GROUP BY l.lag"""
SQL["season_verdict"] = """
SELECT coalesce(string_agg(mois::VARCHAR, ',' ORDER BY mois)
    FILTER (seasonal_index > 1.10), '') AS strong_months,
  coalesce(string_agg(mois::VARCHAR, ',' ORDER BY mois)
    FILTER (seasonal_index < 0.90), '') AS weak_months,
  round(stddev_samp(seasonal_index) / avg(seasonal_index) * 100, 4)
    AS cv_pct,
  CASE WHEN stddev_samp(seasonal_index) / avg(seasonal_index) > 0.15
    THEN 'marked' WHEN stddev_samp(seasonal_index) / avg(seasonal_index)
    > 0.08 THEN 'moderate' ELSE 'weak' END AS verdict
FROM month_profile"""
SQL["top_products"] = """
SELECT code_article, designation, sum(quantite) AS total_qty,
  code_article || ' — ' || substr(designation, 1, 30) AS label
FROM main GROUP BY code_article, designation
ORDER BY total_qty DESC, code_article, designation LIMIT 15"""
SQL["category_quantities"] = """
SELECT categorie, sum(quantite) AS total_qty FROM main GROUP BY categorie"""
SQL["top_lines"] = """
SELECT code_facture, societe, code_article, designation, quantite,
  code_client FROM main
ORDER BY quantite DESC, code_facture, societe, code_article LIMIT 20"""
SQL["pair_history"] = """
SELECT code_client, code_article, date_commande, code_facture, societe,
  quantite, min(quantite) OVER w AS min_qty, max(quantite) OVER w AS max_qty,
  round(avg(quantite) OVER w, 4) AS avg_qty,
  median(quantite) OVER w AS median_qty,
  round(stddev_pop(quantite) OVER w, 4) AS std_qty,
  max(date_commande) OVER w AS last_date,
  row_number() OVER (PARTITION BY code_client, code_article
    ORDER BY date_commande, code_facture, societe, quantite) AS position
FROM main WINDOW w AS (PARTITION BY code_client, code_article)"""
SQL["outlier_weight"] = """
SELECT count(*) AS n_orders, count(*) FILTER (quantite >= 20) AS n_large,
  round(max(m), 4) AS mean_qty,
  round(sum((quantite - m) ** 2) FILTER (quantite >= 20), 4)
    AS square_large,
  round(sum((quantite - m) ** 2) FILTER (quantite < 20), 4)
    AS square_normal,
  round(sum((quantite - m) ** 2) FILTER (quantite >= 20)
    / sum((quantite - m) ** 2) FILTER (quantite < 20) * 100, 4)
    AS large_vs_normal_pct
FROM main, (SELECT avg(quantite) AS m FROM main)"""
SQL["scalar_pack"] = """
SELECT code_facture, societe, week(date_commande) AS iso_week,
  dayname(date_commande) AS day_name,
  strftime(date_commande, '%b') AS month_name,
  date_trunc('month', date_commande)::DATE AS month_start,
  make_date(year(date_commande), month(date_commande), 1) AS made_date,
  (date_commande + 30)::DATE AS plus_30, round(ln(1 + num), 4) AS log1p,
  round(exp(ln(1 + num)) - 1, 4) AS expm1, round(sqrt(num), 4) AS root,
  abs(num - 2500) AS distance, round_even(num / 2, 0) AS half_even,
  ceil(num / 7)::BIGINT AS up, trunc(num / 7)::BIGINT AS cut,
  contains(lower(ref_commercial), 'urgent') AS is_urgent,
  coalesce(nullif(month(date_commande), 6), 0) AS no_june,
  (societe IN ('CO1', 'CO3'))::INTEGER AS in_list,
  '{"facture":"' || code_facture || '","societe":"' || societe || '"}'
    AS as_json,
  code_facture AS from_json,
  upper(substr(ref_commercial, 3, 4)) AS priority
FROM (SELECT *, substr(code_facture, 2)::DOUBLE AS num FROM inv)"""
