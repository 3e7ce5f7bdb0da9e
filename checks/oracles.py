"""The same results as ``checks.queries``, as SQL for DuckDB over the given tables.

``{name}`` stands for a view of ``checks.views`` or for a part defined here.
"""

from __future__ import annotations

import re

from checks.views import VIEWS, view_sql


def _gender(c: str) -> str:
    return (
        f"CASE WHEN upper(trim({c})) IN ('F', 'FEMALE') THEN 'Female'"
        f" WHEN upper(trim({c})) IN ('M', 'MALE') THEN 'Male' ELSE 'n/a' END"
    )


def _marital(c: str) -> str:
    return (
        f"CASE WHEN upper(trim({c})) IN ('S', 'SINGLE') THEN 'Single'"
        f" WHEN upper(trim({c})) IN ('M', 'MARRIED') THEN 'Married' ELSE 'n/a' END"
    )


def _line(c: str) -> str:
    return (
        f"CASE WHEN upper(trim({c})) IN ('M', 'MOUNTAIN') THEN 'Mountain' WHEN upper(trim({c})) IN ('R', 'ROAD') THEN 'Road'"
        f" WHEN upper(trim({c})) IN ('S', 'OTHER SALES') THEN 'Other Sales'"
        f" WHEN upper(trim({c})) IN ('T', 'TOURING') THEN 'Touring' ELSE 'n/a' END"
    )


def _day(c: str) -> str:
    return f"CASE WHEN length(CAST({c} AS VARCHAR)) = 8 THEN CAST(try_strptime(CAST({c} AS VARCHAR), '%Y%m%d') AS DATE) END"


def _repaired(expected: str) -> str:
    return f"CASE WHEN sls_sales IS NULL OR sls_sales <= 0 OR sls_sales <> {expected} THEN {expected} ELSE CAST(sls_sales AS BIGINT) END"


_EXPECTED = "CAST(sls_quantity AS BIGINT) * abs(CAST(sls_price AS BIGINT))"
_REPAIRED = _repaired(_EXPECTED)
# Cleaned sales have prices with fractions.
_REPAIRED_ON_CLEAN = _repaired("sls_quantity * abs(sls_price)")


def _clean_customers(source: str) -> str:
    return f"""
SELECT cst_id, trim(cst_key) AS cst_key, trim(cst_firstname) AS cst_firstname, trim(cst_lastname) AS cst_lastname,
       CASE upper(trim(cst_marital_status)) WHEN 'M' THEN 'Married' WHEN 'S' THEN 'Single' ELSE cst_marital_status END AS cst_marital_status,
       CASE upper(trim(cst_gndr)) WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE cst_gndr END AS cst_gndr,
       cst_create_date, _created_at
FROM (SELECT * FROM {source} WHERE cst_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY cst_id ORDER BY _created_at DESC) = 1) newest"""


def _clean_products(source: str) -> str:
    return f"""
SELECT prd_id, replace(substr(prd_key, 1, 5), '-', '_') AS cat_id, substr(prd_key, 7) AS prd_key, prd_nm,
       coalesce(prd_cost, 0) AS prd_cost,
       CASE upper(trim(prd_line)) WHEN 'M' THEN 'Mountain' WHEN 'R' THEN 'Road' WHEN 'S' THEN 'Other Sales' WHEN 'T' THEN 'Touring' ELSE 'n/a' END AS prd_line,
       try_cast(prd_start_dt AS DATE) AS prd_start_dt,
       lead(try_cast(prd_start_dt AS DATE)) OVER (PARTITION BY prd_key ORDER BY try_cast(prd_start_dt AS DATE) NULLS FIRST, prd_id) - 1 AS prd_end_dt,
       _created_at
FROM {source}"""


def _clean_sales(source: str) -> str:
    return f"""
SELECT sls_ord_num, sls_prd_key, sls_cust_id, {_day("sls_order_dt")} AS sls_order_dt, {_day("sls_ship_dt")} AS sls_ship_dt,
       {_day("sls_due_dt")} AS sls_due_dt, {_REPAIRED} AS sls_sales, sls_quantity,
       CASE WHEN sls_price IS NULL OR sls_price <= 0 THEN CAST({_REPAIRED} AS DOUBLE) / nullif(sls_quantity, 0)
            ELSE CAST(sls_price AS DOUBLE) END AS sls_price
FROM {source}"""


def _dim_customers(customers: str) -> str:
    return f"""
SELECT row_number() OVER (ORDER BY cst_id) AS customer_key, cst_id AS customer_id, cst_key AS customer_number,
       trim(cst_firstname) AS first_name, trim(cst_lastname) AS last_name, coalesce(cntry, 'n/a') AS country,
       {_marital("cst_marital_status")} AS marital_status,
       CASE WHEN {_gender("cst_gndr")} <> 'n/a' THEN {_gender("cst_gndr")} ELSE {_gender("gen")} END AS gender,
       bdate AS birthdate, cst_create_date AS create_date
FROM {customers} c LEFT JOIN ({{clean_erp_customers}}) e ON c.cst_key = e.cid
     LEFT JOIN ({{clean_erp_locations}}) l ON c.cst_key = l.cid"""


def _dim_products(products: str, head: str, tail: str) -> str:
    return f"""
SELECT row_number() OVER (ORDER BY prd_id) AS product_key, prd_id AS product_id, {tail} AS product_number, prd_nm AS product_name,
       {head} AS category_id, coalesce(cat, 'n/a') AS category, coalesce(subcat, 'n/a') AS subcategory,
       coalesce(maintenance, 'n/a') AS maintenance, prd_cost AS cost, {_line("prd_line")} AS product_line, prd_start_dt AS start_date
FROM {products} p LEFT JOIN ({{clean_erp_categories}}) k ON {head} = k.id WHERE p.prd_end_dt IS NULL"""


def _fact(sales: str, day, products: str, customers: str, amount: str = _REPAIRED) -> str:
    return f"""
SELECT sls_ord_num AS order_number, product_key, customer_key, {day("sls_order_dt")} AS order_date,
       {day("sls_ship_dt")} AS shipping_date, {day("sls_due_dt")} AS due_date, {amount} AS sales_amount, sls_quantity AS quantity,
       CASE WHEN sls_price IS NULL OR sls_price <= 0 THEN CAST(sls_sales AS DOUBLE) / nullif(sls_quantity, 0)
            ELSE CAST(sls_price AS DOUBLE) END AS price
FROM {sales} s LEFT JOIN {products} p ON s.sls_prd_key = p.product_number LEFT JOIN {customers} c ON s.sls_cust_id = c.customer_id"""


_SOURCE_COLUMNS = "o.cst_key, o.cst_lastname, o.cst_gndr"


def _extract(window: str) -> str:
    return f"""
SELECT l.log_id, l.operation_type, l.changed_at, coalesce(o.cst_id, try_cast(l.id AS INTEGER)) AS cst_id, {_SOURCE_COLUMNS}
FROM ({{cdc_log}}) l LEFT JOIN ({{customers_now}}) o ON l.id = CAST(o.cst_id AS VARCHAR)
WHERE l.table_name = 'crm_customer' {window}"""


_IN_WINDOW = "AND l.changed_at > TIMESTAMP '2024-01-08 00:00:00' AND l.changed_at <= TIMESTAMP '2024-01-22 12:30:00'"


def _merge(overwriting: str, adding: str) -> str:
    def pick(c: str, new: str | None = None) -> str:
        return f"CASE WHEN t.cst_id IS NULL OR s.operation_type IN ({overwriting}) THEN {new or 's.' + c} ELSE t.{c} END AS {c}"

    return f"""
SELECT coalesce(t.cst_id, s.cst_id) AS cst_id, {pick("cst_key")}, {pick("cst_lastname")}, {pick("cst_gndr")},
       {pick("_created_at", "CAST(s.changed_at AS DATE)")}
FROM ({{customers_then}}) t FULL JOIN ({{latest_customer_changes}}) s ON t.cst_id = s.cst_id
WHERE CASE WHEN t.cst_id IS NULL THEN s.operation_type IN ({adding}) ELSE coalesce(s.operation_type, '') <> 'DELETE' END"""


# Columns of the six tables, key first, and the key's type.
_TABLES = {
    "crm_customers": ("crm", "crm_customer", "INTEGER", "cst_id cst_key cst_firstname cst_lastname cst_marital_status cst_gndr cst_create_date"),
    "crm_products": ("crm", "crm_products", "INTEGER", "prd_id prd_key prd_nm prd_cost prd_line prd_start_dt prd_end_dt"),
    "crm_sales": ("crm", "crm_sales", "VARCHAR", "sls_ord_num sls_prd_key sls_cust_id sls_order_dt sls_ship_dt sls_due_dt sls_sales sls_quantity sls_price"),
    "erp_customers": ("erp", "erp_customers", "VARCHAR", "cid bdate gen"),
    "erp_locations": ("erp", "erp_locations", "VARCHAR", "cid cntry"),
    "erp_categories": ("erp", "erp_categories", "VARCHAR", "id cat subcat maintenance"),
}
_MODES = {"strict": ("'UPDATE'", "'INSERT'"), "upsert": ("'UPDATE', 'INSERT'", "'INSERT', 'UPDATE'")}


def _once(view: str) -> str:
    """The rows of a table by its key; order numbers that come twice are one row."""
    if "sales" not in view:
        return f"({{{view}}})"
    columns = _TABLES["crm_sales"][3].split()[1:]
    order = ", ".join(f"{c} DESC NULLS LAST" for c in columns)
    return f"(SELECT * FROM ({{{view}}}) QUALIFY row_number() OVER (PARTITION BY sls_ord_num ORDER BY {order}) = 1)"


def _applied(base: str, name: str, window: str, mode: str) -> str:
    """``base`` after the merge of a table's logged changes in a window, which carry its rows as they are now."""
    log, log_name, key_type, columns = _TABLES[name]
    key, *rest = columns.split()
    overwriting, adding = _MODES[mode]
    new = f"t.{key} IS NULL OR s.operation_type IN ({overwriting})"
    picked = "".join(f", CASE WHEN {new} THEN n.{c} ELSE t.{c} END AS {c}" for c in rest)
    return f"""
SELECT coalesce(t.{key}, CAST(s.id AS {key_type})) AS {key}{picked}, CASE WHEN {new} THEN s.changed_at ELSE t._created_at END AS _created_at
FROM ({base}) t FULL JOIN (
  SELECT id, operation_type, changed_at FROM ({{{log}_log}}) WHERE table_name = '{log_name}' AND {window}
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY changed_at DESC, log_id DESC) = 1) s ON CAST(t.{key} AS VARCHAR) = s.id
LEFT JOIN {_once(f"{name}_now")} n ON CAST(n.{key} AS VARCHAR) = s.id
WHERE CASE WHEN t.{key} IS NULL THEN s.operation_type IN ({adding}) ELSE coalesce(s.operation_type, '') <> 'DELETE' END"""


def _raw(name: str, days: int, mode: str = "strict") -> str:
    """A raw table after so many days."""
    columns = ", ".join(_TABLES[name][3].split())
    rows = f"SELECT {columns}, TIMESTAMP '2024-06-30 12:00:00' AS _created_at FROM {_once(name)}"
    end = "TIMESTAMP '1998-05-01 00:00:00'" if name in ("crm_sales", "erp_customers", "erp_locations") else "TIMESTAMP '2024-01-16 00:00:00'"
    for window in (f"changed_at <= {end}", f"changed_at > {end}")[:days]:
        rows = _applied(rows, name, window, mode)
    return rows


def _cleaned_erp(name: str, rows: str, as_of: str) -> str:
    if name == "erp_customers":
        return f"""SELECT CASE WHEN starts_with(cid, 'NAS') THEN substr(cid, 4) ELSE cid END AS cid,
       CASE WHEN bdate > DATE '{as_of}' THEN NULL ELSE bdate END AS bdate, {_gender("gen")} AS gen, _created_at FROM ({rows})"""
    if name == "erp_locations":
        return f"""SELECT replace(cid, '-', '') AS cid,
       CASE WHEN trim(cntry) = 'DE' THEN 'Germany' WHEN trim(cntry) IN ('US', 'USA') THEN 'United States'
            WHEN cntry IS NULL OR trim(cntry) = '' THEN 'n/a' ELSE trim(cntry) END AS cntry, _created_at FROM ({rows})"""
    return f"SELECT id, trim(cat) AS cat, trim(subcat) AS subcat, trim(maintenance) AS maintenance, _created_at FROM ({rows})"


_CLEANERS = {"crm_customers": _clean_customers, "crm_products": _clean_products, "crm_sales": _clean_sales}


def _clean_after(name: str, days: int, mode: str = "strict") -> str:
    rows, as_of = _raw(name, days, mode), "2024-06-30" if days == 1 else "2187-03-09"
    if name.startswith("erp"):
        return _cleaned_erp(name, rows, as_of)
    # Cleaned sales keep the time of their row behind their other columns.
    cleaned = _CLEANERS[name](f"({rows})")
    return cleaned.replace("END AS sls_price\nFROM", "END AS sls_price, _created_at\nFROM") if name == "crm_sales" else cleaned


def _star(mode: str) -> str:
    """Dimensions and fact after two days as parts of a WITH clause; ids that are new on the second are numbered after the others."""
    parts = []
    for days in (1, 2):
        parts += [f"{n}{days} AS MATERIALIZED ({_clean_after(n, days, mode)})" for n in _TABLES]
        dimensions = {
            "customers": _dim_customers(f"crm_customers{days}"),
            "products": _dim_products(f"crm_products{days}", "p.cat_id", "p.prd_key"),
        }
        for n, text in dimensions.items():
            for erp in ("customers", "locations", "categories"):
                text = text.replace(f"({{clean_erp_{erp}}})", f"erp_{erp}{days}")
            parts.append(f"ranked_{n}{days} AS MATERIALIZED ({text})")
    for n, one in (("customers", "customer"), ("products", "product")):
        first, second, key, by = f"ranked_{n}1", f"ranked_{n}2", f"{one}_key", f"{one}_id"
        parts.append(
            f"""keys_{n} AS MATERIALIZED (SELECT {by}, {key} FROM {first} UNION ALL
  SELECT {by}, (SELECT count(*) FROM {first}) + row_number() OVER (ORDER BY {by}) FROM {second} WHERE {by} NOT IN (SELECT {by} FROM {first}))"""
        )
        parts.append(f"dim_{n} AS MATERIALIZED (SELECT r.* REPLACE (k.{key} AS {key}) FROM {second} r JOIN keys_{n} k USING ({by}))")
    fact = _fact("crm_sales2", lambda c: c, "dim_products", "dim_customers", _REPAIRED_ON_CLEAN)
    return ", ".join([*parts, f"fact AS MATERIALIZED ({fact})"])


def _content(name: str) -> str:
    """All columns of a clean table as one text."""
    columns = {"crm_products": "prd_id cat_id prd_key prd_nm prd_cost prd_line prd_start_dt prd_end_dt".split()}.get(name, _TABLES[name][3].split())
    texts = [f"CAST(CAST(round({c} * 1000) AS BIGINT) AS VARCHAR)" if c == "sls_price" else f"CAST({c} AS VARCHAR)" for c in columns]
    return ", ".join(f"coalesce({t}, '~')" for t in [*texts, "strftime(_created_at, '%Y-%m-%d %H:%M')"])


_PARTS = {
    "latest_customer_changes": f"""
SELECT * FROM ({_extract("")}) changes
QUALIFY row_number() OVER (PARTITION BY cst_id ORDER BY changed_at DESC, log_id DESC) = 1""",
}

_TEXTS = {
    "clean_crm_customers": _clean_customers("({crm_customer_versions})"),
    "clean_crm_products": _clean_products("({crm_products})"),
    "clean_crm_sales": _clean_sales("({crm_sales})"),
    "clean_erp_customers": f"""
SELECT CASE WHEN starts_with(cid, 'NAS') THEN substr(cid, 4) ELSE cid END AS cid,
       CASE WHEN bdate > DATE '2024-06-30' THEN NULL ELSE bdate END AS bdate, {_gender("gen")} AS gen FROM ({{erp_customers}})""",
    "clean_erp_locations": """
SELECT replace(cid, '-', '') AS cid,
       CASE WHEN trim(cntry) = 'DE' THEN 'Germany' WHEN trim(cntry) IN ('US', 'USA') THEN 'United States'
            WHEN cntry IS NULL OR trim(cntry) = '' THEN 'n/a' ELSE trim(cntry) END AS cntry FROM ({erp_locations})""",
    "clean_erp_categories": """
SELECT id, trim(cat) AS cat, trim(subcat) AS subcat, trim(maintenance) AS maintenance FROM ({erp_categories})""",
    "dim_customers": _dim_customers("({crm_customers})"),
    "dim_products": _dim_products(
        "({crm_products})", "replace(substr(prd_key, 1, 5), '-', '_')", "substr(prd_key, 7)"
    ),
    "dim_products_on_clean": _dim_products("({clean_crm_products})", "p.cat_id", "p.prd_key"),
    "fact_sales": _fact("({crm_sales})", _day, "({dim_products})", "({dim_customers})"),
    "fact_sales_on_clean": _fact(
        "({clean_crm_sales})", lambda c: c, "({dim_products_on_clean})", "({dim_customers})", _REPAIRED_ON_CLEAN
    ),
    "surrogate_key_distributed": """
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS order_number, o_orderkey, o_orderdate, o_orderpriority FROM orders""",
    "surrogate_key_incremental": """
WITH kept AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F')
SELECT n AS order_number, o_orderkey, o_orderdate FROM kept
UNION ALL SELECT (SELECT count(*) FROM kept) + row_number() OVER (ORDER BY o_orderdate, o_orderkey), o_orderkey, o_orderdate
FROM orders WHERE o_orderstatus = 'F'""",
    "change_window": _extract(_IN_WINDOW).replace(
        "o.cst_gndr", "o.cst_gndr, o._created_at"
    ),
    "pushed_change_query": f"""
SELECT l.log_id, l.operation_type, l.changed_at, o.cst_id, o.cst_key, o.cst_lastname, l.id AS _logged_id
FROM ({{cdc_log}}) l LEFT JOIN ({{customers_now}}) o ON l.id = CAST(o.cst_id AS VARCHAR)
WHERE l.table_name = 'crm_customer' {_IN_WINDOW}""",
    "batch_end": """
SELECT n.table_name, coalesce(max(l.changed_at), TIMESTAMP '2024-12-31 00:00:00') AS batch_end
FROM (VALUES ('crm_customer'), ('crm_products'), ('crm_sales')) n(table_name)
LEFT JOIN ({cdc_log}) l ON l.table_name = n.table_name GROUP BY n.table_name""",
    "latest_change_per_key": """
SELECT * FROM ({cdc_log}) QUALIFY row_number() OVER (PARTITION BY table_name, id ORDER BY changed_at DESC, log_id DESC) = 1""",
    "distinct_changes": """
SELECT DISTINCT operation_type, table_name, id, CAST(changed_at AS DATE) AS changed_on FROM ({cdc_log})""",
    "one_row_per_key": """
SELECT sls_ord_num, sls_sales, sls_quantity, sls_price FROM ({crm_sales})
QUALIFY row_number() OVER (PARTITION BY sls_ord_num
  ORDER BY sls_quantity DESC NULLS LAST, sls_price DESC NULLS LAST, sls_sales DESC NULLS LAST) = 1""",
    "merge_strict": _merge("'UPDATE'", "'INSERT'"),
    "merge_upsert": _merge("'UPDATE', 'INSERT'", "'INSERT', 'UPDATE'"),
    "stream_merge": _merge("'UPDATE'", "'INSERT'"),
    "snapshot_diff": """
SELECT CASE WHEN a.cst_id IS NULL THEN 'INSERT' WHEN b.cst_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation_type,
       coalesce(b.cst_id, a.cst_id) AS cst_id, b.cst_key, b.cst_lastname, b.cst_gndr, b._created_at
FROM ({customers_then}) a FULL JOIN ({customers_now}) b ON a.cst_id = b.cst_id
WHERE a.cst_id IS NULL OR b.cst_id IS NULL OR a.cst_key IS DISTINCT FROM b.cst_key OR a.cst_lastname IS DISTINCT FROM b.cst_lastname
   OR a.cst_gndr IS DISTINCT FROM b.cst_gndr OR a._created_at IS DISTINCT FROM b._created_at""",
    "apply_diff_roundtrip": "SELECT * FROM ({customers_now})",
    "unprocessed_files": """
SELECT file_name FROM ({order_files}) f
WHERE NOT EXISTS (SELECT 1 FROM ({order_ledger}) l WHERE l.table_name = 'orders' AND l.file_name = f.file_name)""",
    "ledger_insert_if_absent": """
SELECT 'orders' AS table_name, file_name, CASE WHEN file_name IN (SELECT file_name FROM ({order_ledger}) WHERE table_name = 'orders')
       THEN DATE '2024-01-01' ELSE DATE '2024-01-02' END AS processed_on
FROM (SELECT file_name FROM ({order_files}) UNION SELECT file_name FROM ({order_ledger}) WHERE table_name = 'orders') names""",
    "scd_end_date": """
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS valid_from,
       CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS DATE) - 1 AS valid_to FROM orders""",
    "yyyymmdd_to_date": f"SELECT sls_ord_num, sls_order_dt, {_day('sls_order_dt')} AS order_date FROM ({{crm_sales}})",
    "iso_to_date": """
SELECT prd_id, try_cast(prd_start_dt AS DATE) AS starts, try_cast(prd_start_dt AS DATE) - 1 AS day_before FROM ({crm_products})""",
    "safe_unit_price": """
SELECT sls_ord_num, CASE WHEN sls_price IS NULL OR sls_price <= 0
       THEN CAST(sls_sales AS DOUBLE) / CASE WHEN sls_quantity % 7 = 0 THEN NULL ELSE sls_quantity END
       ELSE CAST(sls_price AS DOUBLE) END AS unit_price FROM ({crm_sales})""",
    "repair_amount": f"""
SELECT sls_ord_num, CAST({_EXPECTED} AS BIGINT) AS expected, {_REPAIRED} AS amount FROM ({{crm_sales}})""",
    "code_map": f"""
SELECT cst_id, {_gender("cst_gndr")} AS gender,
       CASE upper(trim(cst_gndr)) WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE cst_gndr END AS gender_or_code,
       {_marital("cst_marital_status")} AS marital FROM ({{crm_customers}})""",
    "strip_prefix": """
SELECT cid, CASE WHEN starts_with(cid, 'NAS') THEN substr(cid, 4) ELSE cid END AS plain FROM ({erp_customers})""",
    "split_composite_key": """
SELECT prd_id, replace(substr(prd_key, 1, 5), '-', '_') AS head, substr(prd_key, 7) AS tail, '' AS empty_tail FROM ({crm_products})""",
    "blank_to_label": """
SELECT cid, CASE WHEN cntry IS NULL OR trim(cntry) = '' THEN 'n/a' ELSE trim(cntry) END AS country FROM ({erp_locations})""",
    "first_known_value": f"""
SELECT cst_id, CASE WHEN {_gender("cst_gndr")} <> 'n/a' THEN {_gender("cst_gndr")} ELSE {_marital("cst_marital_status")} END AS first_known
FROM ({{crm_customers}})""",
    "current_versions": "SELECT prd_id, prd_key, prd_start_dt FROM ({clean_crm_products}) WHERE prd_end_dt IS NULL",
    "profile_snapshot": """
SELECT count(*) AS row_count, CAST(9 AS BIGINT) AS column_count,
       'struct<sls_ord_num:string,sls_prd_key:string,sls_cust_id:int,sls_order_dt:int,sls_ship_dt:int,sls_due_dt:int,sls_sales:int,sls_quantity:int,sls_price:int>' AS schema
FROM ({crm_sales})""",
    "quality_report": """
WITH counted AS (SELECT count(*) FILTER (sls_ord_num IS NULL) AS a, count(*) FILTER (sls_sales IS NULL) AS b, count(*) FILTER (sls_price IS NULL) AS c,
                        count(*) FILTER (sls_sales < 0) AS d, count(*) FILTER (sls_price < 0) AS e FROM ({crm_sales}))
SELECT 'sls_ord_num' AS column_name, 'not_null' AS check_name, a AS violations FROM counted
UNION ALL SELECT 'sls_sales', 'not_null', b FROM counted UNION ALL SELECT 'sls_price', 'not_null', c FROM counted
UNION ALL SELECT 'sls_sales', 'not_negative', d FROM counted UNION ALL SELECT 'sls_price', 'not_negative', e FROM counted""",
    "snapshot_profile_written": """
SELECT 'CRM' AS source, 'sales' AS "table", 'snapshot' AS extract_type, '2024-06-30' AS load_date, count(*) AS row_count, CAST(9 AS BIGINT) AS column_count,
       'struct<sls_ord_num:string,sls_prd_key:string,sls_cust_id:int,sls_order_dt:int,sls_ship_dt:int,sls_due_dt:int,sls_sales:int,sls_quantity:int,sls_price:int>' AS schema
FROM ({crm_sales})""",
    "snapshot_latest_load": """
SELECT order_id, status, load_date FROM ({order_snapshots})
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY load_date DESC) = 1""",
    "stream_merge_batches": _merge("'UPDATE', 'INSERT'", "'INSERT', 'UPDATE'"),
    "snapshot_diff_wide": """
SELECT CASE WHEN a.seen IS NULL THEN 'INSERT' WHEN b.seen IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation_type,
       coalesce(b.order_id, a.order_id) AS order_id, b.o_custkey, b.o_orderstatus, b.o_totalprice, b.o_orderdate, b.o_orderpriority
FROM (SELECT *, 1 AS seen FROM ({orders_then})) a FULL JOIN (SELECT *, 1 AS seen FROM ({orders_now})) b ON a.order_id = b.order_id
WHERE a.seen IS NULL OR b.seen IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""",
    "incremental_version_ends": """
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS valid_from,
       CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS DATE) - 1 AS valid_to FROM orders""",
    "rejected_rows": " UNION ALL ".join(
        f"SELECT prd_id AS key_prd_id, '{c}' AS column_name, {c} AS value, '{reason}' AS reason FROM ({{products_as_text}}) WHERE {has}"
        for c, reason, has in (
            ("prd_id", "lost value", "prd_id IS NOT NULL AND try_cast(prd_id AS INTEGER) IS NULL"),
            ("prd_cost", "lost value", "prd_cost IS NOT NULL AND try_cast(prd_cost AS INTEGER) IS NULL"),
            ("prd_start_dt", "lost value", "prd_start_dt IS NOT NULL AND try_cast(prd_start_dt AS DATE) IS NULL"),
            ("prd_id", "missing key", "prd_id IS NULL"),
        )
    ),
    "overwrite_one_month": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS rows,
       CASE WHEN CAST(date_trunc('month', o_orderdate) AS DATE) = DATE '1997-03-01' THEN count(*) ELSE 0 END AS redone,
       CAST(date_trunc('month', o_orderdate) AS DATE) <> DATE '1997-03-01' AS old_files
FROM orders WHERE CAST(date_trunc('month', o_orderdate) AS DATE) <> DATE '1999-06-01' GROUP BY 1""",
    "ordered_layout": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS overlapping FROM orders",
    "even_splits": """
WITH cuts AS (SELECT part, min(k) AS cut FROM (SELECT k, ntile(8) OVER (ORDER BY k) AS part FROM ({sparse_keys}) WHERE k IS NOT NULL) GROUP BY part)
SELECT CAST(greatest(1, (SELECT count(DISTINCT cut) FROM cuts WHERE cut <= k)) AS INTEGER) AS part, count(*) AS rows FROM ({sparse_keys}) GROUP BY 1""",
    "daily_run": f"""WITH {_star("strict")}
SELECT f.*, c.customer_id, c.first_name, c.country, c.birthdate, r._created_at AS customer_changed_at
FROM fact f LEFT JOIN dim_customers c ON f.customer_key = c.customer_key LEFT JOIN ({_raw("crm_customers", 2)}) r ON c.customer_id = r.cst_id""",
    "incremental_clean": " UNION ALL ".join(
        f"SELECT '{n.replace('_', '.', 1)}' AS table_name, concat_ws('|', {_content(n)}) AS content, CAST({1 if n == 'erp_categories' else 2} AS BIGINT) AS version FROM ({_clean_after(n, 2)})"
        for n in _TABLES
    ),
    "incremental_fact": f"""WITH {_star("upsert")}
SELECT f.*, p.product_id, p.category, p.start_date, c.customer_id, c.gender
FROM fact f LEFT JOIN dim_products p ON f.product_key = p.product_key LEFT JOIN dim_customers c ON f.customer_key = c.customer_key""",
    "late_commits": _applied(_raw("crm_customers", 0), "crm_customers", "true", "upsert"),
}


def oracle(name: str) -> str:
    """Complete SQL text for a query."""

    def fill(match: re.Match[str]) -> str:
        inner = match.group(1)
        if inner in VIEWS:
            return view_sql(inner)
        return expand(_PARTS.get(inner) or _TEXTS[inner])

    def expand(text: str) -> str:
        return re.sub(r"\{(\w+)\}", fill, text)

    return expand(_TEXTS[name]).strip()


ORACLES = {name: oracle(name) for name in _TEXTS}
