"""Explicit schemas of every table; nothing is inferred on read."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
    T.BooleanType(),
)


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_INVOICES = _struct(
    ("No_", _S), ("client_code", _S), ("Posting Date", T.TimestampNTZType()),
    ("Salesperson Code", _S), ("company", _S),
)
RAW_LINES = _struct(
    ("Document No_", _S), ("Quantity", _D), ("code_article", _S),
    ("designation_article", _S), ("Item Category Code", _S), ("company", _S),
    ("Line No_", _L),
)
RAW_CLIENTS = _struct(
    ("clientCode", _S), ("company", _S), ("lat", _D), ("lng", _D),
)

INVOICES = _struct(
    ("code_facture", _S), ("code_client", _S), ("date_commande", T.DateType()),
    ("ref_commercial", _S), ("societe", _S), ("mois", _I), ("annee", _I),
    ("annee_mois", _S), ("jour_semaine", _I), ("trimestre", _I),
)
LINES = _struct(
    ("code_facture", _S), ("quantite", _D), ("code_article", _S),
    ("designation", _S), ("categorie", _S), ("societe_ligne", _S),
    ("is_bulk_order", _B),
)
CLIENTS = _struct(
    ("latitude", _D), ("longitude", _D), ("code_client", _S), ("societe", _S),
)

FEEDBACK_ITEM = _struct(
    ("code_article", _S), ("accepte", _B), ("quantite_finale", _I),
    ("modifie", _B),
)
FEEDBACK_REQUEST = _struct(
    ("client_id", _S), ("commercial_id", _S), ("code_facture", _S),
    ("submitted_at", T.TimestampNTZType()),
    ("received_at", T.TimestampNTZType()),
    ("items", T.ArrayType(FEEDBACK_ITEM)),
)
FEEDBACK = _struct(
    ("submitted_at", T.TimestampNTZType()), ("client_id", _S),
    ("commercial_id", _S), ("code_facture", _S), ("code_article", _S),
    ("accepte", _B), ("quantite_finale", _I), ("modifie", _B),
    ("date_visite_mois", _S),
)

FEATURE_MATRIX_COLUMNS = [
    "code_client", "code_article", "avg_qty", "median_qty", "std_qty",
    "min_qty", "max_qty", "total_qty", "frequency", "last_qty",
    "recency_days", "avg_delay_days", "recency_relative", "trend",
    "company_encoded", "current_month_coef", "avg_seasonal_coef",
    "best_month", "has_gps", "latitude", "longitude", "categorie",
    "designation", "is_bulk_product", "nb_clients", "days_since_first_order",
    "is_new_product", "client_total_products", "client_total_invoices",
    "client_avg_basket_size",
]
