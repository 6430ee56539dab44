"""All registered queries."""

from cadenza.plans import (  # noqa: F401
    catalog_cleaning, catalog_features, catalog_profiles, catalog_proposals,
    catalog_evaluation, catalog_feedback, catalog_models)
from cadenza.plans.registry import QUERIES  # noqa: F401
