"""Inputs shaped like the source tables, derived from the given tables.

Each view is SQL that means the same on Spark and DuckDB. ``{name}`` stands for a
given table or for another view. Every view takes its base table whole; what has to
be missing (a customer's location, say) is there under another id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "nation", "part", "orders", "lineitem", "events")

VIEWS = {
    # Customers with padded names and every spelling of the codes.
    "crm_customers": """
SELECT CAST(c_custkey AS INT) AS cst_id,
       concat('KD', lpad(CAST(c_custkey AS STRING), 8, '0')) AS cst_key,
       concat(' ', c_name, ' ') AS cst_firstname, concat(c_mktsegment, ' ') AS cst_lastname,
       CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN ' s ' WHEN 2 THEN 'Married' END AS cst_marital_status,
       CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'f' WHEN 2 THEN 'n/a' WHEN 3 THEN ' F ' END AS cst_gndr,
       DATE '2024-01-01' + CAST(c_custkey % 365 AS INT) AS cst_create_date
FROM {customer}""",
    # One row per customer and order: versions of a customer over time, some without an id.
    # Two orders of a customer on one day give the same row twice.
    "crm_customer_versions": """
SELECT CASE WHEN c_custkey % 97 = 5 THEN NULL ELSE c.cst_id END AS cst_id, c.cst_key, c.cst_firstname,
       concat(c.cst_lastname, CAST(year(o_orderdate) AS STRING), '  ') AS cst_lastname,
       CASE WHEN month(o_orderdate) = 5 THEN 'm ' ELSE c.cst_marital_status END AS cst_marital_status,
       c.cst_gndr, c.cst_create_date, o_orderdate AS _created_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN ({crm_customers}) c ON c.cst_id = c_custkey""",
    # Some ids belong to no customer, so some customers have no row here.
    "erp_customers": """
SELECT concat(CASE WHEN c_custkey % 2 = 0 THEN 'NAS' ELSE '' END, CASE WHEN c_custkey % 7 = 3 THEN 'XX' ELSE 'KD' END,
              lpad(CAST(c_custkey AS STRING), 8, '0')) AS cid,
       CASE WHEN c_custkey % 11 = 0 THEN DATE '2187-03-09'
            ELSE DATE '1950-01-01' + CAST((c_custkey * 37) % 18000 AS INT) END AS bdate,
       CASE c_custkey % 6 WHEN 0 THEN 'F' WHEN 1 THEN 'male' WHEN 2 THEN ' Female ' WHEN 3 THEN 'M' WHEN 4 THEN 'x' END AS gen
FROM {customer}""",
    # Likewise.
    "erp_locations": """
SELECT concat(CASE WHEN c_custkey % 9 = 4 THEN 'XX-' ELSE 'KD-' END, lpad(CAST(c_custkey AS STRING), 8, '0')) AS cid,
       CASE c_custkey % 6 WHEN 0 THEN 'DE' WHEN 1 THEN 'US' WHEN 2 THEN ' USA' WHEN 3 THEN '' WHEN 4 THEN NULL
            ELSE concat(' ', n_name, ' ') END AS cntry
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # Two versions per product key a year apart; the older one of a key has expired.
    # A few start dates are no dates.
    "crm_products": """
SELECT CAST(p_partkey AS INT) AS prd_id,
       concat('G', CAST(pair % 7 AS STRING), '-S', CAST(pair % 9 AS STRING), '-PK-', lpad(CAST(pair AS STRING), 7, '0')) AS prd_key,
       p_name AS prd_nm, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END AS prd_cost,
       CASE p_partkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN ' r' WHEN 2 THEN 'S ' WHEN 3 THEN 't' WHEN 4 THEN 'Road' END AS prd_line,
       CASE WHEN p_partkey % 101 = 0 THEN 'soon' ELSE CAST(DATE '2020-01-01' + CAST((p_partkey % 2) * 365 AS INT) AS STRING) END AS prd_start_dt,
       CASE WHEN p_partkey % 2 = 0 THEN '2020-12-30' END AS prd_end_dt,
       DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS _created_at
FROM (SELECT *, CAST(floor(p_partkey / 2) AS INT) AS pair FROM {part}) parts""",
    # The groups of the products; one group is known here by other ids, so its products have no category.
    "erp_categories": """
SELECT DISTINCT concat(CASE WHEN pair % 7 = 3 THEN 'X' ELSE 'G' END, CAST(pair % 7 AS STRING), '_S', CAST(pair % 9 AS STRING)) AS id,
       concat(' Group ', CAST(pair % 7 AS STRING)) AS cat, concat('Sub ', CAST(pair % 9 AS STRING), '  ') AS subcat,
       CASE WHEN pair % 2 = 0 THEN ' Yes' ELSE 'No ' END AS maintenance
FROM (SELECT CAST(floor(p_partkey / 2) AS INT) % 63 AS pair FROM {part}) groups""",
    # Amounts missing, negative or wrong; prices missing or negative; dates 0 or of five digits.
    "crm_sales": """
SELECT concat('SO', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS sls_ord_num,
       concat('PK-', lpad(CAST(CAST(floor(l_partkey / 2) AS INT) AS STRING), 7, '0')) AS sls_prd_key,
       CAST(o_custkey AS INT) AS sls_cust_id,
       CASE WHEN l_orderkey % 50 = 0 THEN 0 WHEN l_orderkey % 77 = 0 THEN 32154
            WHEN l_orderkey % 83 = 0 THEN 20241301
            ELSE CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) END AS sls_order_dt,
       CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS INT) AS sls_ship_dt,
       CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS INT) AS sls_due_dt,
       CASE l_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN -5 WHEN 2 THEN 7
            ELSE CAST(l_quantity AS INT) * CAST(floor(l_extendedprice / l_quantity) AS INT) END AS sls_sales,
       CAST(l_quantity AS INT) AS sls_quantity,
       CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN -CAST(floor(l_extendedprice / l_quantity) AS INT)
            ELSE CAST(floor(l_extendedprice / l_quantity) AS INT) END AS sls_price
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # Two tables share the log, with overlapping ids. Ids are multiples of 2 or 3.
    "cdc_log": """
SELECT CAST(event_id AS INT) AS log_id,
       CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation_type,
       CASE WHEN event_id % 10 = 0 THEN 'crm_products' ELSE 'crm_customer' END AS table_name,
       CAST(user_id * (2 + event_id % 2) * (1 + event_id % 3) AS STRING) AS id, ts AS changed_at
FROM {events}""",
    # The customer table when it was loaded (even ids) and now (multiples of three):
    # ids in both, in one, in none of the two.
    "customers_then": """
SELECT CAST(c_custkey * 2 AS INT) AS cst_id, concat('KD', CAST(c_custkey * 2 AS STRING)) AS cst_key,
       'old' AS cst_lastname, CASE WHEN c_custkey % 6 = 3 OR c_custkey % 60 = 6 THEN NULL ELSE 'M' END AS cst_gndr,
       DATE '2023-01-01' AS _created_at FROM {customer}""",
    "customers_now": """
SELECT CAST(c_custkey * 3 AS INT) AS cst_id, concat('KD', CAST(c_custkey * 3 AS STRING)) AS cst_key,
       CASE WHEN c_custkey % 4 = 2 THEN 'new' ELSE 'old' END AS cst_lastname,
       CASE WHEN c_custkey % 10 = 4 THEN NULL WHEN c_custkey % 4 = 2 THEN NULL ELSE 'M' END AS cst_gndr,
       DATE '2023-01-01' AS _created_at FROM {customer}""",
    # Three dated snapshots of the order table: each holds the orders placed until then (the last
    # one all), with a status of its date.
    "order_snapshots": " UNION ALL ".join(
        f"""SELECT CAST(o_orderkey AS INT) AS order_id, concat(o_orderstatus, '{year}') AS status, DATE '{year}-12-31' AS load_date
FROM {{orders}} WHERE o_orderdate <= DATE '{year}-12-31'"""
        for year in (1996, 1998, 2001)
    ),
    # The source tables after all changes. Every row differs from what was loaded, so that a
    # table that took up rows without a logged change, or left out logged ones, would show it.
    "crm_customers_now": """
SELECT cst_id, CASE WHEN cst_id % 3 = 0 THEN concat('KD', lpad(CAST(cst_id + 1 AS STRING), 8, '0')) ELSE cst_key END AS cst_key,
       concat(' N', trim(cst_firstname)) AS cst_firstname, cst_lastname, 's' AS cst_marital_status,
       CASE WHEN cst_id % 2 = 0 THEN 'n/a' ELSE 'M' END AS cst_gndr, cst_create_date
FROM ({crm_customers}) c""",
    # A quarter of the products moves to the next key, which changes the versions of two keys.
    "crm_products_now": """
SELECT prd_id, CASE WHEN prd_id % 4 = 0 THEN concat(substr(prd_key, 1, 9), lpad(CAST(CAST(floor(prd_id / 2) AS INT) + 1 AS STRING), 7, '0')) ELSE prd_key END AS prd_key,
       concat('N', prd_nm) AS prd_nm, 7 AS prd_cost, prd_line, '2021-06-30' AS prd_start_dt, prd_end_dt
FROM ({crm_products}) p""",
    "crm_sales_now": """
SELECT sls_ord_num, sls_prd_key, sls_cust_id + 1 AS sls_cust_id, sls_order_dt, sls_ship_dt, sls_due_dt, sls_sales,
       sls_quantity + 1 AS sls_quantity, sls_price FROM ({crm_sales}) old
UNION ALL
SELECT concat('NO', sls_ord_num) AS sls_ord_num, sls_prd_key, sls_cust_id, sls_order_dt, sls_ship_dt, sls_due_dt, sls_sales, sls_quantity, sls_price
FROM ({crm_sales}) new""",
    "erp_customers_now": """
SELECT cid, bdate + CAST(1 AS INT) AS bdate, 'female' AS gen FROM ({erp_customers}) c""",
    "erp_locations_now": "SELECT cid, ' Elsewhere' AS cntry FROM ({erp_locations}) l",
    "erp_categories_now": "SELECT id, concat(cat, '*') AS cat, subcat, 'Yes' AS maintenance FROM ({erp_categories}) c",
    # Logs of both sources. A fifth of the order lines and a quarter of the orders name a row that
    # was loaded; the others a new one, which only an INSERT makes.
    "crm_log": """
SELECT CAST(log_id AS BIGINT) AS log_id, operation_type, table_name, id, changed_at FROM ({cdc_log}) events
UNION ALL
SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS log_id,
       CASE WHEN l_orderkey % 25 IN (0, 3) THEN 'DELETE' WHEN l_orderkey % 25 IN (1, 15) THEN 'INSERT' ELSE 'UPDATE' END AS operation_type,
       'crm_sales' AS table_name,
       concat(CASE WHEN l_orderkey % 5 = 0 THEN 'SO' ELSE 'NOSO' END, CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS id,
       max(l_shipdate) AS changed_at
FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_partkey""",
    "erp_log": """
SELECT o_orderkey AS log_id,
       CASE WHEN o_orderkey % 32 = 0 THEN 'DELETE' WHEN o_orderkey % 8 = 3 THEN 'INSERT' ELSE 'UPDATE' END AS operation_type,
       'erp_customers' AS table_name,
       concat(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'ZZ' END, CASE WHEN o_custkey % 2 = 0 THEN 'NAS' ELSE '' END,
              CASE WHEN o_custkey % 7 = 3 THEN 'XX' ELSE 'KD' END, lpad(CAST(o_custkey AS STRING), 8, '0')) AS id,
       o_orderdate AS changed_at FROM {orders}
UNION ALL
SELECT o_orderkey AS log_id, CASE WHEN o_orderkey % 32 = 1 THEN 'DELETE' WHEN o_orderkey % 8 = 3 THEN 'INSERT' ELSE 'UPDATE' END AS operation_type,
       'erp_locations' AS table_name,
       concat(CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE 'ZZ' END, CASE WHEN o_custkey % 9 = 4 THEN 'XX-' ELSE 'KD-' END, lpad(CAST(o_custkey AS STRING), 8, '0')) AS id,
       o_orderdate AS changed_at FROM {orders}
UNION ALL
SELECT CAST(ascii(substr(id, 2, 1)) * 1000 + ascii(substr(id, 5, 1)) AS BIGINT) AS log_id, 'UPDATE' AS operation_type, 'erp_categories' AS table_name, id,
       (SELECT min(o_orderdate) FROM {orders}) AS changed_at FROM ({erp_categories}) c""",
    # Order tables before and after: unchanged rows, changed ones, new and gone ones, and a third without a key.
    "orders_then": """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey * 2 END AS order_id, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders}""",
    "orders_now": """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_orderkey * 2 + 1 ELSE o_orderkey * 2 END AS order_id, o_custkey,
       CASE WHEN o_orderkey % 7 = 1 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 11 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM {orders}""",
    # Products as a source gives them that knows text only: numbers that are none, and rows without a key.
    "products_as_text": """
SELECT CASE WHEN prd_id % 50 = 7 THEN NULL WHEN prd_id % 60 = 9 THEN concat('P', CAST(prd_id AS STRING)) ELSE CAST(prd_id AS STRING) END AS prd_id,
       prd_key, CASE WHEN prd_id % 9 = 1 THEN 'none' ELSE CAST(prd_cost AS STRING) END AS prd_cost, prd_start_dt FROM ({crm_products}) p""",
    # Keys that lie ever farther apart, and some rows without one.
    "sparse_keys": "SELECT CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE o_orderkey * o_orderkey END AS k FROM {orders}",
    # Change files as the orders would have been delivered in, and those already merged.
    "order_files": """
SELECT DISTINCT concat('load_date=', CAST(CAST(o_orderdate AS DATE) AS STRING), '/part-', CAST(o_orderkey % 16 AS STRING)) AS file_name
FROM {orders}""",
    "order_ledger": """
SELECT DISTINCT concat('load_date=', CAST(CAST(o_orderdate AS DATE) AS STRING), '/part-', CAST(o_orderkey % 16 AS STRING)) AS file_name,
       CASE WHEN o_orderpriority < '3' AND year(o_orderdate) < 2000 THEN 'orders' ELSE 'lines' END AS table_name
FROM {orders}""",
}


def view_sql(name: str, table_names: dict[str, str] | None = None) -> str:
    """Text of a view, with the views and tables it stands on filled in."""

    def fill(match: re.Match[str]) -> str:
        inner = match.group(1)
        return view_sql(inner, table_names) if inner in VIEWS else (table_names or {}).get(inner, inner)

    return re.sub(r"\{(\w+)\}", fill, VIEWS[name])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over the given tables, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = view_sql(name, {t: "{" + t + "}" for t in TABLES})
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
