"""Fixed values shared by all jobs."""

# ---------------------------------------------------------------------------
# They must equal the published ones for results to agree.
# ---------------------------------------------------------------------------

# Season coefficient by calendar month.
SEASON_COEFFICIENTS = {
    1: 0.85, 2: 0.90, 3: 1.10, 4: 1.20, 5: 1.00, 6: 1.05,
    7: 1.25, 8: 1.20, 9: 1.15, 10: 1.00, 11: 1.10, 12: 1.30,
}

# Cleaning and feature thresholds.
UNKNOWN_CATEGORY = "UNKNOWN"
BULK_QUANTITY = 1000
NEW_PRODUCT_DAYS = 90
DEFAULT_GAP_DAYS = 30.0
TREND_EPSILON = 1e-6
MIN_HISTORY_LINES = 3
MIN_PRODUCT_APPEARANCES = 1
DEFAULT_REFERENCE_DATE = "2026-06-22"

# Defaults for never-bought pairs.
NEGATIVE_RECENCY_DAYS = 9999.0
NEGATIVE_GAP_DAYS = 999.0
NEGATIVES_PER_POSITIVE = 3

# Temporal split.
TRAIN_CUTOFF = "2025-12-31"
VALIDATION_CUTOFF = "2026-03-31"

# Ranking.
URGENT_RECENCY = 1.0
URGENT_SCORE = 0.80
URGENT_CAP = 7
RECOMMENDED_SCORE = 0.65
RECOMMENDED_CAP = 5
CV_THRESHOLD = 1.0
CV_UNDEFINED = 999.0
HIGH_PRIORITY_PROBABILITY = 0.80

# Columns read by the two models, in training order.
CLASSIFIER_FEATURES = [
    "frequency", "total_qty", "avg_qty", "avg_delay_days", "recency_days",
    "recency_relative", "std_qty", "min_qty", "best_month",
    "avg_seasonal_coef",
]
REGRESSOR_FEATURES = [
    "avg_qty", "median_qty", "std_qty", "min_qty", "max_qty", "last_qty",
    "frequency", "recency_days", "avg_delay_days", "current_month_coef",
    "avg_seasonal_coef",
]

# Boosted-tree settings of both models.
TREES = 200
TREE_DEPTH = 5
LEARNING_RATE = 0.05
ROW_SAMPLING = 0.8
COLUMN_SAMPLING = "0.8"
MIN_ROWS_PER_LEAF = 5
PATIENCE = 20

# Correlation report columns.
CORRELATED_FEATURES = [
    "avg_qty", "std_qty", "total_qty", "frequency", "last_qty",
    "recency_days", "avg_delay_days", "trend", "client_total_products",
    "client_total_invoices", "client_avg_basket_size",
]

# Labels written into results.
SOURCE_MODEL = "IA"
SOURCE_HISTORY = "historique"
SOURCE_VARIANCE = "historique (variance trop élevée)"
GROUP_URGENT = "urgent"
GROUP_RECOMMENDED = "recommande"
PRIORITY_HIGH = "PRIORITE HAUTE (Achat tres probable)"
PRIORITY_SECONDARY = "PROPOSITION SECONDAIRE"

# Explanation texts, one per rule, in rule order.
TEXT_VARIANCE = (
    "Quantité de %d unités basée sur la moyenne historique du client en "
    "raison d'achats très irréguliers. Confiance IA : %d%%."
)
TEXT_NEW_PRODUCT = (
    "Nouveau produit suggéré pour tester la gamme. Confiance IA : %d%%. "
    "Quantité recommandée : %d unités."
)
TEXT_LOYAL = (
    "Client fidèle sur cet article (acheté %d fois, dernier achat il y a %d "
    "jours). Réapprovisionnement suggéré de %d unités (Confiance %d%%)."
)
TEXT_RISING = (
    "Tendance à la hausse détectée pour cet article. Volume de %d unités "
    "suggéré pour répondre à la demande (Confiance %d%%)."
)
TEXT_FALLING = (
    "Baisse légère de la demande historique. Quantité prudente recommandée "
    "de %d unités (Confiance %d%%)."
)
TEXT_DEFAULT = (
    "Réassort classique de %d unités basé sur l'historique et la "
    "saisonnalité. Confiance IA : %d%%."
)

# Prompt text for an external writer; text only, nothing is called.
PROMPT_VARIANCE_NOTE = (
    "Instruction spéciale: Cette quantité est basée sur la moyenne historique "
    "du client car son comportement d'achat est trop irrégulier pour une "
    "prédiction précise — formule l'explication en conséquence, sans "
    "mentionner de tendance ou de prédiction IA.\n"
)
PROMPT_TEMPLATE = (
    "Tu es un assistant IA pour une équipe de vente. Rédige une phrase courte "
    "et professionnelle en français (15-25 mots maximum) justifiant au "
    "commercial pourquoi il doit recommander ce produit à son client.\n"
    "Client: %s\n"
    "Produit: %s (%s)\n"
    "Quantité suggérée: %d unités\n"
    "Source de la quantité: %s\n"
    "Score de confiance de l'IA: %d%%\n"
    "Historique d'achat du client pour ce produit: %d fois acheté au total, "
    "dernier achat il y a %d jours.\n"
    "Tendance d'achat récente: %s.\n"
    "Nouveau produit dans la gamme: %s.\n"
    "%s"
    "Règle stricte: Retourne UNIQUEMENT l'explication, sans introduction, "
    "sans salutations, ni guillemets."
)
TREND_UP = "en hausse"
TREND_FLAT = "stable"
TREND_DOWN = "en baisse"
YES = "Oui"
NO = "Non"

# Season verdict.
STRONG_MONTH = 1.10
WEAK_MONTH = 0.90
CV_MARKED = 15.0
CV_MODERATE = 8.0
WEEKDAY_NAMES = [
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday",
    "Sunday",
]

# ---------------------------------------------------------------------------
# Job defaults (parameters, not fixed values).
# ---------------------------------------------------------------------------

# Company name -> code; pass your own mapping for other company names.
COMPANY_CODES = {"CO1": 0, "CO2": 1, "CO3": 2}
