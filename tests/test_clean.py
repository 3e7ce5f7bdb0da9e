from datetime import date

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import clean

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_crm_customers(spark, rows):
    df = spark.createDataFrame(
        [
            (1, " N-1 ", " Ada", "Byron ", "m", " f ", "2024-01-01", 1, "first"),
            (1, "N-1", "Ada", "Byron ", " S", "M", "2024-01-01", 2, "second"),
            (2, "N-2", None, "Hopper", "Married", "n/a", None, 1, "only"),
            (None, "N-3", "No", "Id", "S", "M", None, 9, "dropped"),
        ],
        "cst_id int, cst_key string, cst_firstname string, cst_lastname string, cst_marital_status string,"
        " cst_gndr string, cst_create_date string, _created_at int, other string",
    )
    out = clean.clean_crm_customers(df)
    assert out.columns == df.columns
    assert rows(out) == [
        (1, "N-1", "Ada", "Byron", "Single", "Male", "2024-01-01", 2, "second"),
        (2, "N-2", None, "Hopper", "Married", "n/a", None, 1, "only"),
    ]


PRODUCTS = (
    "prd_id int, prd_key string, prd_nm string, prd_cost int, prd_line string, prd_start_dt string,"
    " prd_end_dt string, _created_at date, extra string"
)


def test_crm_products(spark, rows):
    df = spark.createDataFrame(
        [
            (1, "TO-OL-HM-1", "Hammer", None, "R ", "2016-03-01", "1999-01-01", None, "x"),
            (2, "TO-OL-HM-1", "Hammer", 12, "m", "2017-03-01", None, None, "x"),
            (3, "TO-OL-HM-1", "Hammer", 13, "Mountain", "2018-03-01", "2000-01-01", None, "x"),
            (4, "GA-RD-HM-1", "Rake", 4, None, "2016-03-01", None, None, "x"),
            (5, "GA-RD-HM-2", "Rake", 4, "S", "later", None, None, "x"),
        ],
        PRODUCTS,
    )
    out = clean.clean_crm_products(df)
    assert out.columns == [
        "prd_id", "cat_id", "prd_key", "prd_nm", "prd_cost", "prd_line", "prd_start_dt", "prd_end_dt", "_created_at",
    ]
    assert rows(out.drop("prd_nm", "_created_at")) == [
        (1, "TO_OL", "HM-1", 0, "Road", date(2016, 3, 1), date(2017, 2, 28)),
        (2, "TO_OL", "HM-1", 12, "Mountain", date(2017, 3, 1), date(2018, 2, 28)),
        (3, "TO_OL", "HM-1", 13, "n/a", date(2018, 3, 1), None),
        (4, "GA_RD", "HM-1", 4, "n/a", date(2016, 3, 1), None),
        (5, "GA_RD", "HM-2", 4, "Other Sales", None, None),
    ]


SALES = (
    "sls_ord_num string, sls_prd_key string, sls_cust_id int, sls_order_dt int, sls_ship_dt int, sls_due_dt int,"
    " sls_sales int, sls_quantity int, sls_price int"
)


def test_crm_sales(spark, rows):
    df = spark.createDataFrame(
        [
            ("A", "P", 1, 20240115, 20240116, 20240117, 30, 3, 10),
            ("B", "P", 1, 0, 32154, 20241301, None, 3, -10),
            ("C", "P", 1, None, 20230229, 20240229, 99, 4, None),
            ("D", "P", 1, 20240115, 20240116, 20240117, -8, 0, 0),
        ],
        SALES,
    )
    out = clean.clean_crm_sales(df)
    assert out.columns == df.columns
    assert dict(out.dtypes)["sls_price"] == "double"
    assert rows(out.drop("sls_prd_key", "sls_cust_id")) == [
        ("A", date(2024, 1, 15), date(2024, 1, 16), date(2024, 1, 17), 30, 3, 10.0),
        ("B", None, None, None, 30, 3, 10.0),
        ("C", None, None, date(2024, 2, 29), 99, 4, 24.75),
        ("D", date(2024, 1, 15), date(2024, 1, 16), date(2024, 1, 17), 0, 0, None),
    ]
    priced = out.filter("sls_quantity <> 0")
    assert rows(clean.clean_crm_sales(priced)) == rows(priced)


def test_erp_customers(spark, rows):
    df = spark.createDataFrame(
        [
            ("NAS-7", date(1961, 2, 28), "FEMALE ", 1),
            ("K7NAS", date(1999, 12, 31), " m", 2),
            ("NAS", date(3001, 6, 15), "Male", 3),
            ("nas8", None, None, 4),
            (None, date(1970, 1, 1), "f.", 5),
        ],
        "cid string, bdate date, gen string, line int",
    )
    assert rows(clean.clean_erp_customers(df), "line", "cid", "bdate", "gen") == [
        (1, "-7", date(1961, 2, 28), "Female"),
        (2, "K7NAS", date(1999, 12, 31), "Male"),
        (3, "", None, "Male"),
        (4, "nas8", None, "n/a"),
        (5, None, date(1970, 1, 1), "n/a"),
    ]
    early = clean.clean_erp_customers(df, as_of=date(1970, 1, 1))
    assert {r.line for r in early.collect() if r.bdate} == {1, 5}


def test_erp_locations_and_categories(spark, rows):
    spellings = ["DE ", "US", " USA", "   ", None, "  Viet Nam", "Usa", "United States"]
    places = spark.createDataFrame([(f"{n}--{n}-", c) for n, c in enumerate(spellings)], "cid string, cntry string")
    assert rows(clean.clean_erp_locations(places)) == [
        ("00", "Germany"), ("11", "United States"), ("22", "United States"), ("33", "n/a"), ("44", "n/a"),
        ("55", "Viet Nam"), ("66", "Usa"), ("77", "United States"),
    ]
    groups = spark.createDataFrame(
        [("TO_OL", "  Tools", "Hand tools ", " No "), (" A ", None, "", "Yes")],
        "id string, cat string, subcat string, maintenance string",
    )
    assert rows(clean.clean_erp_categories(groups)) == [
        (" A ", None, "", "Yes"),
        ("TO_OL", "Tools", "Hand tools", "No"),
    ]


CODE = st.sampled_from(["M", " m", "S ", "F", "n/a", "Married", "", None, "DE", "USA", " x "])


@FEW
@given(st.lists(st.tuples(st.integers(1, 5) | st.none(), CODE, CODE, CODE, st.integers(0, 3)), max_size=30))
def test_cleaning_customers_twice_changes_nothing(spark, rows, data):
    df = spark.createDataFrame(
        [(i, k, k, k, m, g, None, t) for i, k, m, g, t in data],
        "cst_id int, cst_key string, cst_firstname string, cst_lastname string, cst_marital_status string,"
        " cst_gndr string, cst_create_date string, _created_at int",
    )
    once = clean.clean_crm_customers(df, newest_by=["_created_at", "cst_key", "cst_marital_status", "cst_gndr"])
    assert rows(clean.clean_crm_customers(once)) == rows(once)
    assert {r.cst_id for r in once.collect()} == {i for i, *_ in data if i is not None}


@FEW
@given(st.lists(st.tuples(CODE, CODE, CODE, CODE), max_size=30))
def test_cleaning_lookups_twice_changes_nothing(spark, rows, data):
    places = clean.clean_erp_locations(spark.createDataFrame([r[:2] for r in data], "cid string, cntry string"))
    assert rows(clean.clean_erp_locations(places)) == rows(places)
    groups = spark.createDataFrame(data, "id string, cat string, subcat string, maintenance string")
    once = clean.clean_erp_categories(groups)
    assert rows(clean.clean_erp_categories(once)) == rows(once)
