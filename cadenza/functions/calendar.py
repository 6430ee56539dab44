"""Calendar expressions on a date column."""

import math

from pyspark.sql import Column, functions as F

from cadenza.constants import SEASON_COEFFICIENTS


def month(day: Column) -> Column:
    return F.month(day)


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def weekday_from_monday(day: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(day)


def week_ending_sunday(day: Column) -> Column:
    return F.date_add(F.trunc(day, "week"), 6)


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Value of ``key`` in a literal map, NULL (or ``default``) if absent."""
    literal = F.create_map(
        *[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(literal, key)
    return found if default is None else F.coalesce(found, default)


def season_coefficient(month_number: Column, mapping: dict | None = None,
                       default: Column | None = None) -> Column:
    return lookup(mapping or SEASON_COEFFICIENTS, month_number, default)


def month_sin(month_number: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * month_number / F.lit(12))


def month_cos(month_number: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * month_number / F.lit(12))
