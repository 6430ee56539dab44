"""The 30-column feature matrix, one row per (client, product)."""

from pyspark.sql import DataFrame, functions as F

from cadenza import constants as C
from cadenza.operators import entity_features, pair_features
from cadenza.schemas import FEATURE_MATRIX_COLUMNS


def feature_matrix(main: DataFrame,
                   reference_date: str = C.DEFAULT_REFERENCE_DATE,
                   company_codes: dict | None = None,
                   only_before_reference: bool = False,
                   stage=None) -> DataFrame:
    """Join pair, client and product features.

    ``stage`` (``write_and_read``) writes the client and product tables first:
    their size is then known, a small one is broadcast and the pairs are not
    shuffled by product, where one product may hold a third of them.

    ``only_before_reference`` cuts rows on or after the reference date; it is
    off by default, so an early reference date sees later orders and yields a
    negative recency.
    """
    if only_before_reference:
        main = main.filter(
            F.col("date_commande") < F.lit(reference_date).cast("date"))
    pairs = pair_features.pair_matrix(main, reference_date, company_codes)
    clients = entity_features.client_profile(main).join(
        entity_features.client_geo(main), "code_client")
    products = entity_features.product_profile(main, reference_date)
    if stage is not None:
        clients = stage(clients, "client-features")
        products = stage(products, "product-features")
    return (pairs
            .join(clients, "code_client", "left")
            .join(products, "code_article", "left")
            .select(*FEATURE_MATRIX_COLUMNS))
