"""Cleaned form of the six source tables.

Each function takes the raw current-state table and touches only the columns it
names; other columns pass through. Raw tables are never overwritten by their
cleaned form, so cleaning again starts from the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.functions import (
    GENDER_LABELS,
    MARITAL_LABELS,
    PRODUCT_LINE_LABELS,
    code_label,
    country_name,
    drop_character,
    expected_amount,
    iso_to_date,
    key_head,
    key_tail,
    null_if_after,
    repair_amount,
    strip_prefix,
    unit_price,
    yyyymmdd_to_date,
)
from tidemark.operators.changes import latest_per_key
from tidemark.operators.versions import with_version_end


def trimmed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.trim(F.col(c)) for c in columns})


def clean_crm_customers(df: DataFrame, *, newest_by: Sequence[str] = ("_created_at",)) -> DataFrame:
    """Newest row per customer with trimmed names and spelled-out codes; unknown codes stay as they are.

    Rows of one time are ordered by their other columns, so that any run keeps the same one.
    """
    order = [*newest_by, *[c for c in df.columns if c not in (*newest_by, "cst_id")]]
    newest = latest_per_key(df.filter(F.col("cst_id").isNotNull()), ["cst_id"], order)
    return trimmed(newest, ["cst_key", "cst_firstname", "cst_lastname"]).withColumns(
        {
            name: code_label(F.col(name), labels, default=None, short_codes_only=True)
            for name, labels in (("cst_marital_status", MARITAL_LABELS), ("cst_gndr", GENDER_LABELS))
        }
    )


def clean_crm_products(df: DataFrame) -> DataFrame:
    """Split product keys, default cost and line, and give every version its end date."""
    dated = df.withColumn("prd_start_dt", iso_to_date(F.col("prd_start_dt")))
    return with_version_end(dated, "prd_key", "prd_start_dt", "prd_end_dt", ["prd_id"]).select(
        "prd_id",
        key_head(F.col("prd_key")).alias("cat_id"),
        key_tail(F.col("prd_key")).alias("prd_key"),
        "prd_nm",
        F.coalesce(F.col("prd_cost"), F.lit(0)).alias("prd_cost"),
        code_label(F.col("prd_line"), PRODUCT_LINE_LABELS, short_codes_only=True).alias("prd_line"),
        "prd_start_dt",
        "prd_end_dt",
        "_created_at",
    )


def repaired_amount(df: DataFrame) -> Column:
    """Sales amount that agrees with quantity and price, in the row's own types."""
    types = {c: df.schema[c].dataType for c in ("sls_sales", "sls_quantity", "sls_price")}
    expected = expected_amount(F.col("sls_quantity"), F.col("sls_price"), types["sls_quantity"], types["sls_price"])
    whole = all(isinstance(t, IntegralType) for t in types.values())
    return repair_amount(F.col("sls_sales"), expected, types["sls_sales"], whole)


def sales_date(df: DataFrame, column: str) -> Column:
    return yyyymmdd_to_date(F.col(column), df.schema[column].dataType)


def clean_crm_sales(df: DataFrame) -> DataFrame:
    """Real dates, amounts that agree with quantity and price, and a price derived from the repaired amount."""
    repaired = repaired_amount(df)
    return df.withColumns(
        {
            **{c: sales_date(df, c) for c in ("sls_order_dt", "sls_ship_dt", "sls_due_dt")},
            "sls_sales": repaired,
            "sls_price": unit_price(F.col("sls_price"), repaired, F.col("sls_quantity")),
        }
    )


def clean_erp_customers(df: DataFrame, *, as_of: date | None = None) -> DataFrame:
    """Plain customer ids, no birthdate after ``as_of`` (default today), gender as a label."""
    return df.withColumns(
        {
            "cid": strip_prefix(F.col("cid"), "NAS"),
            "bdate": null_if_after(F.col("bdate"), as_of, df.schema["bdate"].dataType),
            "gen": code_label(F.col("gen"), GENDER_LABELS),
        }
    )


def clean_erp_locations(df: DataFrame) -> DataFrame:
    """Customer ids without dashes, country names spelled out."""
    return df.withColumns({"cid": drop_character(F.col("cid"), "-"), "cntry": country_name(F.col("cntry"))})


def clean_erp_categories(df: DataFrame) -> DataFrame:
    return trimmed(df, ["cat", "subcat", "maintenance"])
