"""Common table expressions and a helper that prefixes only those needed."""

import re

CTES: dict[str, str] = {}

# Computed once per statement and shielded from join reordering.
SHARED = {"main", "day_hist", "day_month", "day_feat", "visit_hist",
          "dataset", "matrix", "scored", "lin_unique"}


def define(name: str, sql: str) -> None:
    CTES[name] = _nudged(sql.strip())


def _needs(sql: str) -> list[str]:
    """Names of used expressions, dependencies first."""
    seen: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in seen and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in seen:
                    seen.append(name)

    visit(sql)
    return seen


def _nudged(sql: str) -> str:
    """round(x, 4) -> round((x) + 1e-9, 4), as the queries do."""
    out, at = "", 0
    for found in re.finditer(r"\bround\(", sql):
        if found.start() < at:
            continue
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[found.end():end - 1]
        if inner.rstrip().endswith(", 4"):
            inner = f"({_nudged(inner.rstrip()[:-3])}) + 1e-9, 4"
        out += sql[at:found.end()] + inner + ")"
        at = end
    return out + sql[at:]


def with_ctes(sql: str) -> str:
    sql = _nudged(sql.strip())
    names = _needs(sql)
    if not names:
        return sql
    parts = ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({CTES[n]})"
        for n in names)
    if sql.upper().startswith("WITH "):
        return f"WITH {parts},\n{sql[5:]}"
    return f"WITH {parts}\n{sql}"


define("raw_inv", """
SELECT 'F' || CAST(o_orderkey // 3 AS VARCHAR) AS code_facture,
  CASE WHEN o_orderkey % 101 <> 0 THEN 'C' || CAST(o_custkey AS VARCHAR)
       || CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE '' END END AS code_client,
  CASE WHEN o_orderkey % 50 = 7
       THEN CAST(DATE '2001-06-01' + CAST(o_orderkey % 60 AS INTEGER) AS DATE)
       ELSE CAST(o_orderdate AS DATE) END AS date_commande,
  o_orderpriority || ' ' AS ref_commercial,
  'CO' || CAST(o_orderkey % 3 + 1 AS VARCHAR) AS societe
FROM orders""")

define("raw_lin", """
SELECT CASE WHEN l_partkey % 499 <> 0
       THEN 'F' || CAST(l_orderkey // 3 AS VARCHAR) END AS code_facture,
  CASE WHEN l_partkey % 97 = 0 THEN 0.0 WHEN l_partkey % 89 = 0
       THEN -l_quantity WHEN l_partkey % 83 = 0 THEN l_quantity * 50
       ELSE l_quantity END::DOUBLE AS quantite,
  CASE WHEN l_partkey % 211 <> 5 THEN
       CASE WHEN l_orderkey % 50 = 7 AND l_partkey % 4 = 1
            THEN 'New#' || CAST(l_partkey % 3 AS VARCHAR)
            ELSE p_brand END END AS code_article,
  CASE WHEN l_partkey % 41 <> 0 THEN p_name END AS designation,
  CASE WHEN NOT (l_partkey % 37 = 0 OR p_brand = 'Brand#25')
       THEN CASE WHEN l_partkey % 5 = 0 THEN lower(p_type) || ' '
                 ELSE p_type END END AS categorie,
  CASE WHEN l_partkey % 307 <> 0
       THEN 'CO' || CAST(l_orderkey % 3 + 1 AS VARCHAR) END AS societe_ligne,
  l_linenumber::BIGINT AS numero_ligne
FROM lineitem JOIN part ON l_partkey = p_partkey""")

define("raw_gps", """
SELECT CASE WHEN c_custkey % 500 <> 499
       THEN 'C' || CAST(c_custkey AS VARCHAR) END AS code_client,
  'CO' || CAST(c_custkey % 3 + 1 AS VARCHAR) AS societe,
  CASE WHEN c_acctbal >= 0
       THEN 30 + CAST(c_custkey * 37 % 1000 AS DOUBLE) / 100 END AS latitude,
  CASE WHEN c_acctbal >= 0
       THEN 8 + CAST(c_custkey * 91 % 700 AS DOUBLE) / 100 END AS longitude
FROM customer""")

define("inv", """
SELECT trim(code_facture) AS code_facture, trim(code_client) AS code_client,
  date_commande, trim(ref_commercial) AS ref_commercial,
  trim(societe) AS societe,
  CAST(month(date_commande) AS INTEGER) AS mois,
  CAST(year(date_commande) AS INTEGER) AS annee,
  strftime(date_commande, '%Y-%m') AS annee_mois,
  CAST(isodow(date_commande) - 1 AS INTEGER) AS jour_semaine,
  CAST(quarter(date_commande) AS INTEGER) AS trimestre
FROM raw_inv WHERE code_facture IS NOT NULL AND code_client IS NOT NULL""")

define("lin_unique", """
SELECT * EXCLUDE (copy) FROM (
  SELECT *, row_number() OVER (
    PARTITION BY code_facture, societe_ligne, code_article
    ORDER BY numero_ligne NULLS LAST, coalesce(quantite > 0, false) DESC,
             quantite NULLS LAST, designation NULLS LAST,
             categorie NULLS LAST) AS copy
  FROM raw_lin
  WHERE code_facture IS NOT NULL AND code_article IS NOT NULL)
WHERE copy = 1""")

define("cat_mode", """
SELECT code_article, categorie AS categorie_mode FROM (
  SELECT code_article, categorie, row_number() OVER (
    PARTITION BY code_article ORDER BY count(*) DESC, categorie) AS rank
  FROM lin_unique WHERE categorie IS NOT NULL
  GROUP BY code_article, categorie)
WHERE rank = 1""")

define("lin_filled", """
SELECT l.* REPLACE (coalesce(l.categorie, m.categorie_mode) AS categorie),
  l.categorie IS NULL AS was_missing
FROM lin_unique l LEFT JOIN cat_mode m USING (code_article)""")

define("lin", """
SELECT trim(code_facture) AS code_facture, quantite,
  trim(code_article) AS code_article,
  trim(coalesce(designation, code_article)) AS designation,
  upper(trim(coalesce(categorie, 'UNKNOWN'))) AS categorie,
  trim(societe_ligne) AS societe_ligne, quantite > 1000 AS is_bulk_order
FROM lin_filled WHERE quantite > 0""")

define("gps", """
SELECT latitude, longitude, trim(code_client) AS code_client,
  trim(societe) AS societe
FROM raw_gps WHERE code_client IS NOT NULL""")

define("main", """
SELECT l.*, i.code_client, i.date_commande, i.ref_commercial, i.societe,
  i.mois, i.annee, i.annee_mois, i.jour_semaine, i.trimestre,
  g.latitude, g.longitude
FROM lin l
JOIN inv i ON l.code_facture = i.code_facture AND l.societe_ligne = i.societe
LEFT JOIN gps g ON i.code_client = g.code_client AND i.societe = g.societe""")

define("season", """
SELECT * FROM (VALUES (1, 0.85::DOUBLE), (2, 0.90), (3, 1.10), (4, 1.20),
  (5, 1.00), (6, 1.05), (7, 1.25), (8, 1.20), (9, 1.15), (10, 1.00),
  (11, 1.10), (12, 1.30)) AS t(m, coef)""")
