"""Checks for catalog_evaluation."""

from oracle.base import define

define("score_rows", """
SELECT target_bought AS label,
  round(1 / (1 + recency_relative), 4) AS score FROM dataset""")

define("pos_rows", """
SELECT *, CASE WHEN avg_qty > 0 THEN std_qty / avg_qty ELSE 999 END AS cv,
  ceil(avg_qty) AS historic_qty,
  greatest(round_even(median_qty * 0.75::DOUBLE + last_qty * 0.25::DOUBLE, 0),
           1.0) AS prediction,
  CASE WHEN ('0x' || substr(md5(code_client || '|42'), 1, 12))::BIGINT % 1000
    < 200 THEN 'test'
  WHEN ('0x' || substr(md5(code_client || '|43'), 1, 12))::BIGINT % 1000
    < 125 THEN 'validation' ELSE 'train' END AS part
FROM dataset WHERE target_qty > 0""")

define("by_date", """
SELECT *, CASE WHEN visit_date <= DATE '2000-06-30' THEN 'train'
  WHEN visit_date <= DATE '2000-12-31' THEN 'validation' ELSE 'test' END
  AS part FROM dataset""")

define("by_client", """
SELECT *, CASE
  WHEN ('0x' || substr(md5(code_client || '|42'), 1, 12))::BIGINT % 1000
    < 200 THEN 'test'
  WHEN ('0x' || substr(md5(code_client || '|43'), 1, 12))::BIGINT % 1000
    < 125 THEN 'validation' ELSE 'train' END AS part FROM dataset""")

SQL = {}
SQL["encode_category"] = """
SELECT categorie, dense_rank() OVER (ORDER BY categorie) - 1
  AS categorie_encoded, count(*) AS n_rows
FROM dataset GROUP BY categorie"""
SQL["temporal_split"] = """
SELECT part, count(*) AS n_rows, count(DISTINCT code_client) AS n_clients,
  min(visit_date) AS date_min, max(visit_date) AS date_max
FROM by_date GROUP BY part"""
SQL["group_split"] = """
SELECT part, count(*) AS n_rows, count(DISTINCT code_client) AS n_clients,
  min(visit_date) AS date_min, max(visit_date) AS date_max
FROM pos_rows GROUP BY part"""
SQL["split_leak_check"] = " UNION ALL ".join(f"""
SELECT '{name}' AS split,
  max(visit_date) FILTER (part = 'train') AS train_max,
  min(visit_date) FILTER (part = 'validation') AS validation_min,
  min(visit_date) FILTER (part = 'test') AS test_min,
  (SELECT count(*) FROM (SELECT code_client FROM {src} WHERE part = 'train'
     INTERSECT SELECT code_client FROM {src} WHERE part = 'test'))
    AS shared_clients
FROM {src}""" for name, src in (("temporal", "by_date"),
                                ("client", "by_client")))
SQL["class_weight"] = """
SELECT count(*) FILTER (target_bought = 0) AS n_negative,
  count(*) FILTER (target_bought = 1) AS n_positive,
  round(count(*) FILTER (target_bought = 0)::DOUBLE
    / greatest(count(*) FILTER (target_bought = 1), 1), 4)
    AS scale_pos_weight
FROM by_date WHERE part = 'train'"""
SQL["auc_from_scores"] = """
WITH by_score AS (SELECT score, sum(label)::DOUBLE AS pos,
    (count(*) - sum(label))::DOUBLE AS neg FROM score_rows GROUP BY score),
run AS (SELECT *, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
    sum(pos) OVER w - pos AS pos_before, sum(neg) OVER w - neg AS neg_before
  FROM by_score WINDOW w AS (ORDER BY score))
SELECT round(sum(pos * (neg_before + neg / 2) / (p * n)), 4) AS roc_auc,
  round(sum(pos / p * (p - pos_before)
    / (p - pos_before + n - neg_before)), 4) AS pr_auc,
  max(p)::BIGINT AS n_positive, max(n)::BIGINT AS n_negative
FROM run"""
SQL["confusion_matrix"] = """
SELECT label::BIGINT AS label, (score >= 0.5)::BIGINT AS predicted,
  count(*) AS n FROM score_rows GROUP BY 1, 2"""
SQL["classification_report"] = """
WITH c AS (SELECT
    count(*) FILTER (label = 0 AND score < 0.5)::DOUBLE AS tn,
    count(*) FILTER (label = 0 AND score >= 0.5)::DOUBLE AS fp,
    count(*) FILTER (label = 1 AND score < 0.5)::DOUBLE AS fn,
    count(*) FILTER (label = 1 AND score >= 0.5)::DOUBLE AS tp
  FROM score_rows),
r AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0,
    2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS s0,
    tp / (tp + fp) AS p1, tp / (tp + fn) AS r1,
    2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS s1,
    (tp + tn) / (tp + tn + fp + fn) AS acc FROM c)
SELECT '0' AS label, round(p0, 4) AS precision, round(r0, 4) AS recall,
  round(f0, 4) AS f1, s0::BIGINT AS support FROM r
UNION ALL SELECT '1', round(p1, 4), round(r1, 4), round(f1, 4), s1::BIGINT
FROM r
UNION ALL SELECT 'accuracy', round(acc, 4), round(acc, 4), round(acc, 4),
  (s0 + s1)::BIGINT FROM r
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 4),
  round((r0 + r1) / 2, 4), round((f0 + f1) / 2, 4), (s0 + s1)::BIGINT FROM r
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 4),
  round((r0 * s0 + r1 * s1) / (s0 + s1), 4),
  round((f0 * s0 + f1 * s1) / (s0 + s1), 4), (s0 + s1)::BIGINT FROM r"""


def _mae(guess, rows="true"):
    return f"avg(abs(target_qty - {guess})) FILTER ({rows})"


def _rmse(guess, rows="true"):
    return f"sqrt(avg((target_qty - {guess}) ** 2) FILTER ({rows}))"


SQL["regression_report"] = f"""
SELECT n_rows, round(mae, 4) AS mae, round(rmse, 4) AS rmse,
  round(mb, 4) AS mae_baseline, round(rb, 4) AS rmse_baseline,
  round((mb - mae) / mb * 100, 4) AS improvement_mae_pct,
  round((rb - rmse) / rb * 100, 4) AS improvement_rmse_pct
FROM (SELECT count(*) AS n_rows, {_mae("prediction")} AS mae,
  {_rmse("prediction")} AS rmse, {_mae("avg_qty")} AS mb,
  {_rmse("avg_qty")} AS rb FROM pos_rows)"""
SQL["error_quantiles"] = """
SELECT round(quantile_cont(e, 0.5), 4) AS p50,
  round(quantile_cont(e, 0.9), 4) AS p90,
  round(quantile_cont(e, 0.99), 4) AS p99
FROM (SELECT abs(target_qty - prediction) AS e FROM pos_rows)"""
SQL["prediction_distribution"] = """
SELECT count(*) AS n, round(avg(prediction), 4) AS mean,
  round(stddev_samp(prediction), 4) AS std, min(prediction) AS min,
  quantile_cont(prediction, 0.25) AS p25,
  quantile_cont(prediction, 0.5) AS p50,
  quantile_cont(prediction, 0.75) AS p75, max(prediction) AS max
FROM pos_rows"""


def _above(top, bottom):
    """The variation exceeds top / bottom, in whole numbers and decimals."""
    return f"""(total_qty <= 0
    OR qty_dispersion::DECIMAL(28, 4) * {bottom ** 2} > total_qty::DECIMAL(
      15, 4) * total_qty::DECIMAL(15, 4) * {top ** 2})"""


_GUESSES = {"baseline": "historic_qty", "model": "prediction",
            "hybrid_cv_1.0": f"CASE WHEN {_above(1, 1)} THEN historic_qty "
                             "ELSE prediction END",
            "hybrid_cv_0.8": f"CASE WHEN {_above(4, 5)} THEN historic_qty "
                             "ELSE prediction END"}
SQL["cv_threshold_eval"] = " UNION ALL ".join(f"""
SELECT '{name}' AS approach, round({_mae(g)}, 4) AS mae,
  round({_rmse(g)}, 4) AS rmse, round(({_mae("historic_qty")} - {_mae(g)})
    / {_mae("historic_qty")} * 100, 4) AS gain_pct
FROM pos_rows WHERE part = 'test'""" for name, g in _GUESSES.items())
SQL["cv_curve"] = """
WITH v AS (SELECT CASE WHEN total_qty > 0
    THEN sqrt(qty_dispersion) / total_qty ELSE 999 END AS threshold,
    abs(target_qty - prediction) AS ma, abs(target_qty - historic_qty) AS ha
  FROM pos_rows WHERE part = 'test'),
s AS (SELECT threshold, sum(ma) AS ma, sum(ha) AS ha, sum(ma * ma) AS ms,
    sum(ha * ha) AS hs, count(*) AS n FROM v GROUP BY threshold
  UNION ALL SELECT -1, 0, 0, 0, 0, 0),
c AS (SELECT threshold, (sum(ma) OVER upto + sum(ha) OVER () - sum(ha) OVER
    upto) / sum(n) OVER () AS mae,
    sqrt((sum(ms) OVER upto + sum(hs) OVER () - sum(hs) OVER upto)
      / sum(n) OVER ()) AS rmse,
    (sum(n) OVER () - sum(n) OVER upto)::BIGINT AS n_history
  FROM s WINDOW upto AS (ORDER BY threshold))
SELECT threshold, round(mae, 4) AS mae, round(rmse, 4) AS rmse, n_history,
  row_number() OVER (ORDER BY mae, threshold) = 1 AS is_best FROM c"""
_EDGE = f"{_above(1, 2)} AND NOT {_above(7, 10)}"
SQL["cv_frontier"] = f"""
SELECT count(*) FILTER ({_EDGE}) AS n_frontier, count(*) AS n_rows,
  round({_mae("prediction", _EDGE)}, 4) AS mae_model,
  round({_rmse("prediction", _EDGE)}, 4) AS rmse_model,
  round({_mae("historic_qty", _EDGE)}, 4) AS mae_history,
  round({_rmse("historic_qty", _EDGE)}, 4) AS rmse_history,
  round(count(*) FILTER ({_EDGE}) * 100.0::DOUBLE / count(*), 4)
    AS share_pct,
  CASE WHEN {_mae("prediction", _EDGE)} > {_mae("historic_qty", _EDGE)}
    THEN 'history' ELSE 'model' END AS winner
FROM pos_rows"""
SQL["cv_switches"] = f"""
SELECT c.*, f.position, f.code_article, round(f.cv, 4) AS cv, f.prediction,
  f.historic_qty, f.target_qty
FROM (SELECT code_client, count(*) AS n_rows,
    count(*) FILTER ({_above(7, 10)}) AS n_history_both,
    count(*) FILTER (NOT {_above(1, 2)}) AS n_model_both,
    count(*) FILTER ({_EDGE}) AS n_switched FROM pos_rows GROUP BY 1) c
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY code_client ORDER BY visit_date, code_facture, societe,
      code_article) AS position FROM pos_rows WHERE {_EDGE})
    WHERE position <= 5) f USING (code_client)"""
SQL["case_rows"] = """
SELECT code_client, code_article, code_facture, societe, visit_date,
  target_qty, round(avg_qty, 4) AS avg_qty, median_qty
FROM (SELECT *, row_number() OVER (PARTITION BY code_client, code_article
    ORDER BY visit_date DESC, code_facture DESC, societe DESC) AS r
  FROM dataset WHERE target_bought = 1) WHERE r = 1"""
SQL["winsorise"] = """
SELECT code_client, code_article, round(avg_qty, 4) AS avg_qty, max_qty,
  round(least(avg_qty, (SELECT quantile_cont(avg_qty, 0.95) FROM matrix)), 4)
    AS avg_qty_capped,
  round(least(max_qty, (SELECT quantile_cont(max_qty, 0.99) FROM matrix)), 4)
    AS max_qty_capped
FROM matrix"""
SQL["drift_psi"] = """
WITH cells AS (
  SELECT 'categorie' AS variable, categorie AS bin, date_commande FROM main
  UNION ALL SELECT 'code_article', code_article, date_commande FROM main
  UNION ALL SELECT 'quantite', least(floor(quantite / 10), 10)::BIGINT
    ::VARCHAR, date_commande FROM main),
counts AS (SELECT variable, bin,
    count(*) FILTER (date_commande > DATE '2000-12-31') AS n_new,
    count(*) FILTER (date_commande <= DATE '2000-12-31') AS n_old
  FROM cells GROUP BY ALL),
shares AS (SELECT variable,
    greatest(n_new / sum(n_new) OVER v, 0.0001::DOUBLE) AS a,
    greatest(n_old / sum(n_old) OVER v, 0.0001::DOUBLE) AS b
  FROM counts WINDOW v AS (PARTITION BY variable))
SELECT variable, round(sum((a - b) * ln(a / b)), 4) AS psi,
  count(*) AS n_bins FROM shares GROUP BY variable"""
