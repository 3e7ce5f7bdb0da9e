"""Column builders: each takes Columns and returns a Column."""

from tidemark.functions.amounts import expected_amount, needs_repair, repair_amount, unit_price
from tidemark.functions.codes import (
    COUNTRY_NAMES,
    GENDER_LABELS,
    MARITAL_LABELS,
    PRODUCT_LINE_LABELS,
    UNKNOWN,
    code_label,
    country_name,
    first_known,
    label_if_blank,
    normal_code,
)
from tidemark.functions.dates import day_before, iso_to_date, null_if_after, timestamp_literal, yyyymmdd_to_date
from tidemark.functions.text import drop_character, key_head, key_tail, recover_key, strip_prefix

__all__ = [
    "COUNTRY_NAMES",
    "GENDER_LABELS",
    "MARITAL_LABELS",
    "PRODUCT_LINE_LABELS",
    "UNKNOWN",
    "code_label",
    "country_name",
    "day_before",
    "drop_character",
    "expected_amount",
    "first_known",
    "iso_to_date",
    "key_head",
    "key_tail",
    "label_if_blank",
    "needs_repair",
    "normal_code",
    "null_if_after",
    "recover_key",
    "repair_amount",
    "strip_prefix",
    "timestamp_literal",
    "unit_price",
    "yyyymmdd_to_date",
]
