"""Checks for catalog_cleaning."""

SQL = {}

SQL["src_invoices"] = "SELECT * FROM raw_inv"
SQL["csv_quarantine"] = """
SELECT reason, count(*) AS n, sum(quantite) FILTER (reason = 'read')
  AS total_qty
FROM (SELECT quantite, CASE WHEN draw < 3 THEN 'number of fields'
    WHEN draw BETWEEN 3 AND 5 THEN 'Quantity is no double'
    WHEN draw BETWEEN 6 AND 7 THEN 'Line No_ is no bigint'
    ELSE 'read' END AS reason
  FROM (SELECT quantite, ('0x' || substr(md5(coalesce(code_facture, '') || '|'
      || coalesce(numero_ligne, 0)), 1, 12))::BIGINT % 100 AS draw
    FROM raw_lin))
GROUP BY reason"""
SQL["src_lines"] = "SELECT * FROM raw_lin"
SQL["src_clients"] = "SELECT * FROM raw_gps"

SQL["load_profile"] = """
SELECT 'commandes' AS table_name, count(*) AS n_rows,
  count(DISTINCT code_client) AS n_clients, CAST(NULL AS BIGINT) AS n_products,
  min(date_commande) AS date_min, max(date_commande) AS date_max FROM raw_inv
UNION ALL
SELECT 'lignes', count(*), NULL, count(DISTINCT code_article), NULL, NULL
FROM raw_lin
UNION ALL
SELECT 'gps', count(*), count(DISTINCT code_client), NULL, NULL, NULL
FROM raw_gps"""

SQL["dataset_overview"] = """
SELECT 'commandes_clean' AS table_name, count(*) AS n_rows,
  10::BIGINT AS n_columns, min(date_commande) AS date_min,
  max(date_commande) AS date_max FROM inv
UNION ALL SELECT 'lignes_clean', count(*), 7, NULL, NULL FROM lin
UNION ALL SELECT 'gps_clean', count(*), 4, NULL, NULL FROM gps"""

SQL["write_roundtrip"] = """
SELECT societe_ligne, count(*) AS n_rows, sum(quantite) AS total_qty,
  count(DISTINCT code_article) AS n_products
FROM lin GROUP BY societe_ligne"""

SQL["sample_preview"] = """
SELECT code_facture, societe, code_article, code_client, date_commande,
  quantite
FROM main
ORDER BY ('0x' || substr(md5(code_facture || '|' || societe || '|'
  || code_article), 1, 12))::BIGINT, code_facture, societe, code_article
LIMIT 50"""

SQL["clean_invoices"] = "SELECT * FROM inv"
SQL["clean_lines"] = "SELECT * FROM lin"

SQL["clean_all"] = """
SELECT 'commandes_clean' AS table_name, count(*) AS n_rows,
  count(DISTINCT (code_facture, societe)) AS n_keys,
  round(sum(mois::DOUBLE), 2) AS amount FROM inv
UNION ALL
SELECT 'lignes_clean', count(*), count(DISTINCT (code_facture, code_article)),
  round(sum(quantite), 2) FROM lin
UNION ALL
SELECT 'gps_clean', count(*), count(DISTINCT code_client),
  round(sum(latitude), 2) FROM gps"""

SQL["calendar_parts"] = """
SELECT annee, mois, annee_mois, jour_semaine, trimestre,
  count(*) AS n_invoices
FROM inv GROUP BY ALL"""

SQL["dedup_lines"] = "SELECT * FROM lin_unique"

SQL["impute_category"] = """
SELECT code_article, coalesce(categorie, 'UNKNOWN') AS categorie,
  count(*) AS n_lines FROM lin_filled GROUP BY 1, 2"""

SQL["bulk_flag"] = """
SELECT code_article, quantite > 1000 AS is_bulk_order, count(*) AS n_lines,
  max(quantite) AS max_qty FROM raw_lin GROUP BY 1, 2"""

SQL["clean_audit"] = """
SELECT 'commandes' AS table_name, count(*) AS rows_read,
  count(*) FILTER (code_facture IS NULL OR code_client IS NULL)
    AS rows_without_key,
  0::BIGINT AS copies_removed, 0::BIGINT AS categories_missing,
  0::BIGINT AS categories_unknown, 0::BIGINT AS designations_missing,
  0::BIGINT AS quantities_rejected,
  count(*) FILTER (code_facture IS NOT NULL AND code_client IS NOT NULL)
    AS rows_kept
FROM raw_inv
UNION ALL
SELECT 'lignes', (SELECT count(*) FROM raw_lin),
  (SELECT count(*) FROM raw_lin
   WHERE code_facture IS NULL OR code_article IS NULL),
  (SELECT count(*) FROM raw_lin WHERE code_facture IS NOT NULL
   AND code_article IS NOT NULL) - count(*),
  count(*) FILTER (was_missing), count(*) FILTER (categorie IS NULL),
  count(*) FILTER (designation IS NULL),
  count(*) FILTER (NOT (quantite > 0)), count(*) FILTER (quantite > 0)
FROM lin_filled
UNION ALL
SELECT 'gps', count(*), count(*) FILTER (code_client IS NULL), 0, 0, 0, 0, 0,
  count(code_client) FROM raw_gps"""

SQL["uncategorised_by_invoice"] = """
SELECT code_facture, min(societe_ligne) AS company, count(*) AS nb_lignes,
  coalesce(string_agg(designation, ' | ' ORDER BY designation), '')
    AS designation
FROM lin_filled WHERE categorie IS NULL GROUP BY code_facture"""

SQL["main_table"] = """
SELECT code_facture, societe, code_article, code_client, date_commande,
  ref_commercial, designation, categorie, quantite, is_bulk_order, latitude,
  longitude, mois, annee, annee_mois, jour_semaine, trimestre FROM main"""

SQL["join_coverage"] = """
SELECT count(*) AS lines_total, count(i.code_facture) AS lines_with_invoice,
  count(*) - count(i.code_facture) AS lines_without_invoice,
  count(g.latitude) AS lines_with_gps,
  count(*) - count(g.latitude) AS lines_without_gps
FROM lin l
LEFT JOIN inv i ON l.code_facture = i.code_facture
  AND l.societe_ligne = i.societe
LEFT JOIN gps g ON i.code_client = g.code_client AND i.societe = g.societe"""

SQL["fanout_check"] = """
SELECT count(*)::BIGINT AS rows_on_number,
  (count(*) FILTER (l.societe_ligne = i.societe))::BIGINT
    AS rows_on_number_and_company,
  (count(*) FILTER (l.societe_ligne IS DISTINCT FROM i.societe))::BIGINT
    AS rows_across_companies
FROM lin l JOIN inv i ON l.code_facture = i.code_facture"""
