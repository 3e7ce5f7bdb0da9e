"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from checks.views import VIEWS, load
from tidemark.functions import (
    GENDER_LABELS,
    MARITAL_LABELS,
    code_label,
    day_before,
    expected_amount,
    first_known,
    iso_to_date,
    key_head,
    key_tail,
    label_if_blank,
    repair_amount,
    strip_prefix,
    unit_price,
    yyyymmdd_to_date,
)
from tidemark.operators import clean, star
from tidemark.operators.changes import batch_end, distinct_rows, extract_changes, in_window, latest_per_key, snapshot_diff, wide_snapshot_diff
from tidemark.operators.keys import extend_surrogate_key, with_surrogate_key
from tidemark.operators.merge import apply_changes
from tidemark.operators.quality import profile, quality_report, rejected_rows
from tidemark.operators.staging import release, scratch_folder, scratch_released, shuffles_released, staged
from tidemark.operators.versions import extend_versions, with_version_end
from tidemark.plans import jobs
from tidemark.plans.specs import CRM_CUSTOMERS, CRM_SALES, TABLES
from tidemark.sinks.files import range_overlaps, write_ranges, write_snapshot
from tidemark.sinks.state import FileLedger
from tidemark.sinks.tables import VersionedTable, by_day, overwrite_days
from tidemark.sources.files import newest_snapshot_rows, read_snapshots, unprocessed
from tidemark.sources.jdbc import change_query, quantile_query, range_predicates, rough_pieces
from tidemark.sources.systems import FrameSource
from tidemark.streaming import once_per_entry, run_merge_stream, stream_changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = date(2024, 6, 30)
WINDOW = (datetime(2024, 1, 8), datetime(2024, 1, 22, 12, 30))


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


# --- cleaning -----------------------------------------------------------------


@query("clean_crm_customers")
def clean_crm_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_crm_customers(load(spark, sf_dir, "crm_customer_versions"))


@query("clean_crm_products")
def clean_crm_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_crm_products(load(spark, sf_dir, "crm_products"))


@query("clean_crm_sales")
def clean_crm_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_crm_sales(load(spark, sf_dir, "crm_sales"))


@query("clean_erp_customers")
def clean_erp_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_erp_customers(load(spark, sf_dir, "erp_customers"), as_of=AS_OF)


@query("clean_erp_locations")
def clean_erp_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_erp_locations(load(spark, sf_dir, "erp_locations"))


@query("clean_erp_categories")
def clean_erp_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_erp_categories(load(spark, sf_dir, "erp_categories"))


# --- star schema --------------------------------------------------------------


@query("dim_customers")
def dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.build_dim_customers(
        load(spark, sf_dir, "crm_customers"), clean_erp_customers(spark, sf_dir), clean_erp_locations(spark, sf_dir)
    )


@query("dim_products")
def dim_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.build_dim_products(load(spark, sf_dir, "crm_products"), clean_erp_categories(spark, sf_dir))


@query("dim_products_on_clean")
def dim_products_on_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.build_dim_products(clean_crm_products(spark, sf_dir), clean_erp_categories(spark, sf_dir))


@query("fact_sales")
def fact_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.build_fact_sales(
        load(spark, sf_dir, "crm_sales"), dim_products(spark, sf_dir), dim_customers(spark, sf_dir)
    )


@query("fact_sales_on_clean")
def fact_sales_on_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.build_fact_sales(
        clean_crm_sales(spark, sf_dir), dim_products_on_clean(spark, sf_dir), dim_customers(spark, sf_dir)
    )


@query("surrogate_key_distributed")
def surrogate_key_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return with_surrogate_key(orders, "order_number", ["o_orderdate", "o_orderkey"])


@query("surrogate_key_incremental")
def surrogate_key_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that were there keep their numbers when the finished ones come in."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    before = orders.filter("o_orderstatus <> 'F'").drop("o_orderstatus")
    given = with_surrogate_key(before, "order_number", ["o_orderdate", "o_orderkey"], unique=True)
    return extend_surrogate_key(orders.drop("o_orderstatus"), given, "order_number", ["o_orderkey"], ["o_orderdate", "o_orderkey"])


# --- changes ------------------------------------------------------------------


@query("change_window")
def change_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_changes(
        load(spark, sf_dir, "cdc_log"),
        load(spark, sf_dir, "customers_now"),
        table_name="crm_customer",
        key="cst_id",
        after=WINDOW[0],
        until=WINDOW[1],
    )


@query("pushed_change_query")
def pushed_change_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-query a database would be sent, run by Spark on the same rows."""
    text = change_query(
        "{log}",
        "{source}",
        ["cst_id", "cst_key", "cst_lastname"],
        table_name="crm_customer",
        key="cst_id",
        after=WINDOW[0],
        until=WINDOW[1],
    )
    return spark.sql(
        f"SELECT * FROM {text}", log=load(spark, sf_dir, "cdc_log"), source=load(spark, sf_dir, "customers_now")
    )


@query("batch_end")
def batch_end_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "cdc_log")
    ends = [
        batch_end(log, name, fallback="2024-12-31 00:00:00").withColumn("table_name", F.lit(name))
        for name in ("crm_customer", "crm_products", "crm_sales")
    ]
    return ends[0].unionByName(ends[1]).unionByName(ends[2])


@query("latest_change_per_key")
def latest_change_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(load(spark, sf_dir, "cdc_log"), ["table_name", "id"], ["changed_at", "log_id"])


@query("distinct_changes")
def distinct_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "cdc_log")
    return distinct_rows(
        log.select("operation_type", "table_name", "id", F.to_date("changed_at").alias("changed_on"))
    )


@query("one_row_per_key")
def one_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = load(spark, sf_dir, "crm_sales").select("sls_ord_num", "sls_sales", "sls_quantity", "sls_price")
    return latest_per_key(sales, ["sls_ord_num"], ["sls_quantity", "sls_price", "sls_sales"])


def _customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_changes(
        load(spark, sf_dir, "cdc_log"), load(spark, sf_dir, "customers_now"), table_name="crm_customer", key="cst_id"
    )


def _merged(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    changes = _customer_changes(spark, sf_dir).withColumn("_created_at", F.to_date("changed_at"))
    latest = latest_per_key(changes, ["cst_id"], ["changed_at", "log_id"])
    return apply_changes(load(spark, sf_dir, "customers_then"), latest, ["cst_id"], mode=mode)


@query("merge_strict")
def merge_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "strict")


@query("merge_upsert")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "upsert")


@query("snapshot_diff")
def diff_of_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff(load(spark, sf_dir, "customers_then"), load(spark, sf_dir, "customers_now"), ["cst_id"])


@query("apply_diff_roundtrip")
def apply_diff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_changes(
        load(spark, sf_dir, "customers_then"), diff_of_snapshots(spark, sf_dir), ["cst_id"], mode="strict"
    )


@query("unprocessed_files")
def unprocessed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unprocessed(load(spark, sf_dir, "order_files"), load(spark, sf_dir, "order_ledger"), "orders")


@query("ledger_insert_if_absent")
def ledger_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping deliveries of file names; each name is kept once, with its first time."""
    ledger = FileLedger(spark, scratch_folder(spark), "orders")
    known = load(spark, sf_dir, "order_ledger").filter(F.col("table_name") == "orders")
    ledger.add(known, datetime(2024, 1, 1))
    ledger.add(load(spark, sf_dir, "order_files"), datetime(2024, 1, 2))
    return ledger.read().select("table_name", "file_name", F.to_date("processed_at").alias("processed_on"))


# --- columns ------------------------------------------------------------------


@query("scd_end_date")
def scd_end_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a customer's standing order: valid until the day before the next one."""
    orders = load(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("valid_from")
    )
    return with_version_end(orders, "o_custkey", "valid_from", "valid_to", ["o_orderkey"])


@query("yyyymmdd_to_date")
def yyyymmdd_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = load(spark, sf_dir, "crm_sales")
    day = yyyymmdd_to_date(F.col("sls_order_dt"), sales.schema["sls_order_dt"].dataType)
    return sales.select("sls_ord_num", "sls_order_dt", day.alias("order_date"))


@query("iso_to_date")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = iso_to_date(F.col("prd_start_dt"))
    return load(spark, sf_dir, "crm_products").select(
        "prd_id", start.alias("starts"), day_before(start).alias("day_before")
    )


@query("safe_unit_price")
def safe_unit_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = load(spark, sf_dir, "crm_sales")
    quantity = F.when(F.col("sls_quantity") % 7 == 0, 0).otherwise(F.col("sls_quantity"))
    price = unit_price(F.col("sls_price"), F.col("sls_sales"), quantity)
    return sales.select("sls_ord_num", price.alias("unit_price"))


@query("repair_amount")
def repair_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = load(spark, sf_dir, "crm_sales")
    types = {c: sales.schema[c].dataType for c in ("sls_quantity", "sls_price", "sls_sales")}
    expected = expected_amount(
        F.col("sls_quantity"), F.col("sls_price"), types["sls_quantity"], types["sls_price"]
    )
    return sales.select(
        "sls_ord_num",
        expected.alias("expected"),
        repair_amount(F.col("sls_sales"), expected, types["sls_sales"], True).alias("amount"),
    )


@query("code_map")
def code_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "crm_customers").select(
        "cst_id",
        code_label(F.col("cst_gndr"), GENDER_LABELS).alias("gender"),
        code_label(F.col("cst_gndr"), GENDER_LABELS, default=None, short_codes_only=True).alias("gender_or_code"),
        code_label(F.col("cst_marital_status"), MARITAL_LABELS).alias("marital"),
    )


@query("strip_prefix")
def prefix_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    cid = F.col("cid")
    return load(spark, sf_dir, "erp_customers").select(cid, strip_prefix(cid, "NAS").alias("plain"))


@query("split_composite_key")
def composite_key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("prd_key")
    return load(spark, sf_dir, "crm_products").select(
        "prd_id", key_head(key).alias("head"), key_tail(key).alias("tail"), key_tail(key_head(key)).alias("empty_tail")
    )


@query("blank_to_label")
def blank_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "erp_locations").select("cid", label_if_blank(F.col("cntry")).alias("country"))


@query("first_known_value")
def first_known_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "crm_customers")
    gender = code_label(F.col("cst_gndr"), GENDER_LABELS)
    marital = code_label(F.col("cst_marital_status"), MARITAL_LABELS)
    return customers.select("cst_id", first_known(gender, marital).alias("first_known"))


@query("current_versions")
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = clean_crm_products(spark, sf_dir)
    return products.filter(F.col("prd_end_dt").isNull()).select("prd_id", "prd_key", "prd_start_dt")


# --- quality ------------------------------------------------------------------


@query("profile_snapshot")
def profile_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(load(spark, sf_dir, "crm_sales"))


@query("quality_report")
def quality_of_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = ["sls_ord_num", "sls_sales", "sls_price"]
    return quality_report(load(spark, sf_dir, "crm_sales"), not_null=checked, not_negative=checked[1:])


# --- files, streams, whole runs -----------------------------------------------


@query("snapshot_latest_load")
def snapshot_latest_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dated snapshots written and read back; the newest row of each order."""
    root = scratch_folder(spark)
    snapshots = load(spark, sf_dir, "order_snapshots")
    for day in ("1996-12-31", "1998-12-31", "2001-12-31"):
        rows = snapshots.filter(F.col("load_date") == F.lit(day).cast("date")).drop("load_date")
        write_snapshot(rows, root, source="CRM", table="orders", load_date=day)
    return newest_snapshot_rows(read_snapshots(spark, root), ["order_id"])


@query("snapshot_profile_written")
def snapshot_profile_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile that is written beside a snapshot, read back."""
    root = scratch_folder(spark)
    write_snapshot(load(spark, sf_dir, "crm_sales"), root, source="CRM", table="sales", load_date="2024-06-30")
    profiles = spark.read.json(f"{root}/load_date=2024-06-30/metadata")
    return profiles.select("source", "table", "extract_type", F.col("load_date").cast("string").alias("load_date"), "row_count", "column_count", "schema")


@query("stream_merge")
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict merge as a stream over change files, all of them in one batch."""
    root = scratch_folder(spark)
    changes = _customer_changes(spark, sf_dir).withColumn("_created_at", F.to_date("changed_at"))
    changes.write.parquet(f"{root}/changes")
    table = VersionedTable(spark, f"{root}/customers")
    table.replace(load(spark, sf_dir, "customers_then"))
    run_merge_stream(
        stream_changes(spark, f"{root}/changes", changes.schema),
        table.root,
        key=["cst_id"],
        order_by=["changed_at", "log_id"],
        checkpoint=f"{root}/checkpoint",
    )
    return table.read()


@query("stream_merge_batches")
def stream_merge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upsert as a stream of five micro-batches, of which the last delivers the first file again."""
    root = scratch_folder(spark)
    changes = staged(_customer_changes(spark, sf_dir).withColumn("_created_at", F.to_date("changed_at")))
    cuts = [None, datetime(2024, 1, 8), datetime(2024, 1, 15), datetime(2024, 1, 22), None]
    for after, until in [*zip(cuts, cuts[1:], strict=False), (cuts[0], cuts[1])]:
        in_window(changes, "changed_at", after, until).coalesce(1).write.mode("append").parquet(f"{root}/changes")
    table = VersionedTable(spark, f"{root}/customers")
    table.replace(load(spark, sf_dir, "customers_then"))
    arriving = stream_changes(spark, f"{root}/changes", changes.schema, max_files_per_trigger=1)
    run_merge_stream(
        once_per_entry(arriving, delay="60 days"), table, key=["cst_id"], order_by=["changed_at", "log_id"], checkpoint=f"{root}/checkpoint", mode="upsert"
    )
    return table.read()


@query("snapshot_diff_wide")
def wide_diff_of_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_snapshot_diff(load(spark, sf_dir, "orders_then"), load(spark, sf_dir, "orders_now"), ["order_id"])


@query("incremental_version_ends")
def incremental_version_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of ``scd_end_date``, arriving in three batches whose dates lie among each other."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("valid_from"))
    columns = ("o_custkey", "valid_from", "valid_to", ["o_orderkey"])
    versions = with_version_end(orders.filter("o_orderkey % 3 = 0"), *columns)
    for turn in (1, 2):
        versions = extend_versions(staged(versions), orders.filter(f"o_orderkey % 3 = {turn}"), *columns)
    return versions


@query("rejected_rows")
def rejected_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What casts would lose of products that come as text, and rows without a key."""
    schema = StructType.fromDDL("prd_id int, prd_key string, prd_cost int, prd_start_dt date")
    return rejected_rows(load(spark, sf_dir, "products_as_text"), schema, ["prd_id"])


@query("overwrite_one_month")
def overwrite_one_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One month of a partitioned dataset is rewritten and one emptied; per month its rows and whether its files are the old ones."""
    path, fixed, emptied = scratch_folder(spark), F.lit("1997-03-01").cast("date"), F.lit("1999-06-01").cast("date")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.trunc("o_orderdate", "month").alias("month"))
    by_day(orders, "month").write.partitionBy("_created_date").parquet(path)
    before = staged(spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct())
    redone = orders.filter(F.col("month") == fixed).withColumn("o_orderstatus", F.lit("R"))
    days = spark.range(1).select(F.explode(F.array(fixed, emptied)).alias("day"))
    overwrite_days(redone, days, path, "month")
    after = spark.read.schema("o_orderkey bigint, o_orderstatus string, month date, _created_date date").parquet(path)
    after = after.select("month", "o_orderstatus", F.col("_metadata.file_path").alias("file")).join(before.withColumn("old", F.lit(True)), "file", "left")
    return after.groupBy("month").agg(F.count("*").alias("rows"), F.count_if(F.col("o_orderstatus") == "R").alias("redone"), F.bool_and(F.coalesce("old", F.lit(False))).alias("old_files"))


@query("ordered_layout")
def ordered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in files by customer and time: rows in files, and how many files begin before one ahead of them ends."""
    path, order = scratch_folder(spark), ["o_custkey", "o_orderdate"]
    write_ranges(load(spark, sf_dir, "orders"), path, order, parts=12)
    files = range_overlaps(spark.read.parquet(path), order)
    return files.agg(F.sum("rows").alias("rows"), F.count_if("overlaps").alias("overlapping"))


@query("even_splits")
def even_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in each of the parts that a scan is cut into; the question to the database is run by Spark."""
    table = load(spark, sf_dir, "sparse_keys")
    question = quantile_query("{rows}", "k", 8, pieces=rough_pieces(table, "k"))
    cuts = spark.sql(f"SELECT * FROM {question}", rows=table).orderBy("part").collect()  # eight rows
    conditions = range_predicates("k", [r["cut"] for r in cuts])
    part = F.coalesce(*[F.when(F.expr(c), F.lit(i)) for i, c in enumerate(conditions, 1)])
    return table.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))


# Up to when the logs can be seen on the first day, by table; later entries on the second.
FIRST_DAY = {"crm_sales": datetime(1998, 5, 1), "erp_customers": datetime(1998, 5, 1), "erp_locations": datetime(1998, 5, 1)}
FIRST_DAY_ELSE = datetime(2024, 1, 16)
LATER = date(2187, 3, 9)  # birthdates that were in the future have come by then


def _days(spark: SparkSession, sf_dir: str) -> tuple[FrameSource, FrameSource, FrameSource]:
    """The sources as they are loaded, on the first day, and on the second."""
    names = ("crm_customers", "crm_products", "crm_sales", "erp_customers", "erp_locations", "erp_categories")
    loaded = {n.replace("_", ".", 1): load(spark, sf_dir, n) for n in names}
    now = {n.replace("_", ".", 1): load(spark, sf_dir, f"{n}_now") for n in names if n != "crm_sales"}
    loaded["crm.sales"] = staged(_one_each(loaded["crm.sales"]), tight=True)
    now["crm.sales"] = _sales_now(spark, loaded["crm.sales"])
    logs = {source: staged(load(spark, sf_dir, f"{source.lower()}_log"), tight=True) for source in ("CRM", "ERP")}
    until = F.coalesce(*[F.when(F.col("table_name") == t, F.lit(str(day)).cast("timestamp_ntz")) for t, day in FIRST_DAY.items()], F.lit(str(FIRST_DAY_ELSE)).cast("timestamp_ntz"))
    seen = {source: log.filter(F.col("changed_at") <= until) for source, log in logs.items()}
    return FrameSource(loaded, {}), FrameSource(now, seen), FrameSource(now, logs)


def _one_each(sales: DataFrame) -> DataFrame:
    """Order numbers that come twice are one row of a source table, whose key they are."""
    return latest_per_key(sales, CRM_SALES.key, [c for c in sales.columns if c != CRM_SALES.key[0]])


def _sales_now(spark: SparkSession, sales: DataFrame) -> DataFrame:
    """The sales table after all changes, from the loaded one: its view gives other keys to copies of
    the rows and leaves their order as it is, so but for rows without a key none comes twice again."""
    now = spark.sql(VIEWS["crm_sales_now"], crm_sales=sales)
    keyed = F.col(CRM_SALES.key[0]).isNotNull()
    return now.filter(keyed).unionByName(_one_each(now.filter(~keyed)))


def _after_two_days(spark: SparkSession, sf_dir: str, mode: str = "strict", *, read: Sequence[str], empty_day: bool = False) -> jobs.Lake:
    """A lake after all runs; layers and tables that are not to be ``read`` then have gone."""
    lake = jobs.Lake(spark, scratch_folder(spark))
    with scratch_released(spark), shuffles_released(spark):
        loaded, first, second = _days(spark, sf_dir)
        jobs.run_first_load(lake, loaded, date(2024, 6, 30), datetime(2024, 6, 30, 12))
        jobs.run_daily(lake, first, date(2024, 7, 1), as_of=AS_OF, mode=mode)
        jobs.run_daily(lake, second, date(2024, 7, 2), as_of=LATER, mode=mode)
        if empty_day:
            jobs.run_daily(lake, second, date(2024, 7, 3), as_of=LATER, mode=mode)
    layers = {"bronze": [], "raw": [s.name for s in TABLES], "clean": [s.name for s in TABLES], "star": []}
    folders = [f"{layer}/{name}" for layer, names in layers.items() for name in names or [""] if layer not in read]
    release(spark, [f"{lake.root}/{folder.rstrip('/')}" for folder in folders if folder not in read])
    return lake


@query("daily_run")
def daily_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First load and two days' runs over all six tables and both logs; the fact with its customer and when the customer last changed."""
    lake = _after_two_days(spark, sf_dir, read=["star", f"raw/{CRM_CUSTOMERS.name}"])
    customers = lake.star("dim_customers").read().select("customer_key", "customer_id", "first_name", "country", "birthdate")
    stamps = lake.raw(CRM_CUSTOMERS).read().select(F.col("cst_id").alias("customer_id"), F.col("_created_at").cast("timestamp_ntz").alias("customer_changed_at"))
    return lake.star("fact_sales").read().join(customers, "customer_key", "left").join(stamps, "customer_id", "left")


@query("incremental_clean")
def incremental_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six clean tables after two days and an empty one, with the number of versions that each took."""
    lake = _after_two_days(spark, sf_dir, read=["clean"], empty_day=True)
    tables = []
    for spec in TABLES:
        table = lake.clean(spec)
        rows = table.read()
        columns = [F.round(F.col(c) * 1000).cast("bigint") if t == "double" else F.col(c).cast("timestamp_ntz") if t == "timestamp" else F.col(c) for c, t in rows.dtypes]
        content = F.concat_ws("|", *[F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm") if t == "timestamp" else c.cast("string"), F.lit("~")) for c, (_, t) in zip(columns, rows.dtypes, strict=True)])
        tables.append(rows.select(F.lit(spec.name).alias("table_name"), content.alias("content"), F.lit(table.version()).cast("bigint").alias("version")))
    return reduce(DataFrame.unionByName, tables)


@query("incremental_fact")
def incremental_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact after two days, its changes merged as upserts, with the ids behind its keys."""
    lake = _after_two_days(spark, sf_dir, "upsert", read=["star"])
    products = lake.star("dim_products").read().select("product_key", "product_id", "category", "start_date")
    customers = lake.star("dim_customers").read().select("customer_key", "customer_id", "gender")
    return lake.star("fact_sales").read().join(products, "product_key", "left").join(customers, "customer_key", "left")


@query("late_commits")
def late_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ingests of one log, of which every seventh entry of the first days becomes visible after later ones have been read."""
    log, now = staged(load(spark, sf_dir, "cdc_log")), staged(load(spark, sf_dir, "crm_customers_now"))
    tables = {"crm.customers": load(spark, sf_dir, "crm_customers")}
    in_time = log.filter(F.col("changed_at") <= F.lit("2024-01-16").cast("timestamp_ntz")).filter((F.col("log_id") % 7 != 0) | (F.col("changed_at") <= F.lit("2024-01-10").cast("timestamp_ntz")))
    lake = jobs.Lake(spark, scratch_folder(spark))
    jobs.run_first_load(lake, FrameSource(tables, {}), date(2024, 6, 30), datetime(2024, 6, 30, 12), [CRM_CUSTOMERS])
    for day, seen in enumerate((in_time, log), 1):
        jobs.ingest(lake, FrameSource({"crm.customers": now}, {"CRM": seen}), CRM_CUSTOMERS, date(2024, 7, day), overlap=timedelta(days=7))
        jobs.merge(lake, CRM_CUSTOMERS, mode="upsert")
    rows = lake.raw(CRM_CUSTOMERS).read()
    return rows.withColumn("_created_at", F.col("_created_at").cast("timestamp_ntz"))
