"""Business codes and the labels they stand for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and the codes (upper case, trimmed) that mean them.
UNKNOWN = "n/a"
GENDER_LABELS = {"Female": ("F", "FEMALE"), "Male": ("M", "MALE")}
MARITAL_LABELS = {"Married": ("M", "MARRIED"), "Single": ("S", "SINGLE")}
PRODUCT_LINE_LABELS = {
    "Mountain": ("M", "MOUNTAIN"),
    "Road": ("R", "ROAD"),
    "Other Sales": ("S", "OTHER SALES"),
    "Touring": ("T", "TOURING"),
}
# Country codes are matched as written, case included.
COUNTRY_NAMES = {"Germany": ("DE",), "United States": ("US", "USA")}


def normal_code(column: Column) -> Column:
    """Upper-case, space-trimmed form in which codes are compared."""
    return F.upper(F.trim(column))


def _labelled(code: Column, labels: dict[str, tuple[str, ...]], otherwise: Column) -> Column:
    chain = reduce(lambda acc, entry: acc.when(code.isin(*entry[1]), F.lit(entry[0])), labels.items(), F)
    return chain.otherwise(otherwise)


def code_label(
    column: Column,
    labels: dict[str, tuple[str, ...]],
    *,
    default: str | None = UNKNOWN,
    short_codes_only: bool = False,
) -> Column:
    """Label of a code. ``default=None`` keeps a value that has no label as it is.

    ``short_codes_only`` matches one-letter codes but not spelled-out ones.
    """
    if short_codes_only:
        labels = {label: codes[:1] for label, codes in labels.items()}
    return _labelled(normal_code(column), labels, column if default is None else F.lit(default))


def label_if_blank(column: Column, label: str = UNKNOWN) -> Column:
    """Trimmed text, or ``label`` when it is NULL or blank."""
    trimmed = F.trim(column)
    return F.when(trimmed != "", trimmed).otherwise(label)


def country_name(column: Column) -> Column:
    """Full country name; blank and NULL become ``n/a``."""
    return _labelled(F.trim(column), COUNTRY_NAMES, label_if_blank(column))


def first_known(first: Column, second: Column) -> Column:
    """``first`` unless it is the unknown label (or NULL), else ``second``."""
    return F.when(first != UNKNOWN, first).otherwise(second)
