"""All check statements, ready to run."""

from oracle import (cleaning, evaluation, features, feedback, models,
                    profiles, proposals)
from oracle.base import with_ctes

MODULES = (cleaning, features, profiles, proposals, evaluation, feedback,
           models)


def statements() -> dict[str, str]:
    return {name: with_ctes(sql) for module in MODULES
            for name, sql in module.SQL.items()}
