"""What the planner makes of the operators: pushed filters, shuffles, join kinds."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from tidemark.operators.changes import extract_changes, latest_per_key, logged_changes, rows_of_keys
from tidemark.operators.keys import with_surrogate_key
from tidemark.operators.merge import apply_changes
from tidemark.operators.quality import quality_report
from tidemark.operators.star import build_fact_sales
from tidemark.operators.versions import with_version_end

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def whole_lines(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    """A frame as a Parquet table, so that its size is known to the planner."""

    def store(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    return store


@pytest.fixture
def only_small_broadcasts(spark):
    """A broadcast limit that a test's large side exceeds and its small side does not."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def big(spark):
    return spark.range(100_000).select(F.col("id").cast("int").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))


def shuffled(text):
    """What each shuffle of a plan takes in, as text."""
    lines = text.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for at, line in enumerate(lines):
        if "Exchange hash" in line:
            end = next((k for k in range(at + 1, len(lines)) if depth[k] <= depth[at]), len(lines))
            yield "\n".join(lines[at:end])


def test_a_small_change_batch_does_not_shuffle_the_target(spark, stored, only_small_broadcasts):
    target = stored(big(spark), "target")
    changes = stored(
        spark.range(50).select(F.lit("UPDATE").alias("operation_type"), F.col("id").cast("int").alias("k"), F.lit("x").alias("v")),
        "changes",
    )
    text = plan(apply_changes(target, changes, ["k"], mode="upsert"))
    kept, added = text[: text.index("LeftAnti")], text[text.index("LeftAnti") :]
    assert re.search("BroadcastHashJoin .*LeftOuter", kept)
    assert re.search("BroadcastHashJoin .*LeftSemi", added)
    assert not [x for x in shuffled(text) if "/target" in x and "LeftSemi" not in x]  # changes are, to count them by key
    key_scan = [line for line in text.splitlines() if "FileScan" in line and "/target" in line and "v:string" not in line]
    assert key_scan, "the second look at the target reads its key only"


def test_a_short_window_does_not_shuffle_the_source(spark, stored, only_small_broadcasts):
    source = stored(big(spark), "source")
    log = stored(
        spark.range(200).select(
            F.col("id").cast("int").alias("log_id"),
            F.lit("UPDATE").alias("operation_type"),
            F.lit("t").alias("table_name"),
            F.col("id").cast("string").alias("id"),
            F.lit("2024-01-01").cast("timestamp_ntz").alias("changed_at"),
        ),
        "log",
    )
    window = logged_changes(log, "t", source.schema["k"].dataType, datetime(2023, 1, 1), datetime(2025, 1, 1))
    keys = stored(window.select(F.col("_logged_key").alias("k")).distinct(), "keys")
    text = plan(rows_of_keys(source, keys, "k"))
    assert re.search("BroadcastHashJoin .*LeftSemi", text) and "Exchange hash" not in text and "cast(k" not in text
    log_scan = next(line for line in plan(window).splitlines() if "/log" in line)
    once = plan(extract_changes(log, source, table_name="t", key="k"))
    assert "/log" not in once and "/source" not in once  # both were read before, once
    assert "EqualTo(table_name,t)" in log_scan
    assert "GreaterThan(changed_at" in log_scan and "LessThanOrEqual(changed_at" in log_scan


def test_latest_per_key_cuts_groups_before_the_shuffle(spark, stored):
    text = plan(latest_per_key(stored(big(spark), "t"), ["k"], ["v"]))
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_dimensions_of_known_small_size_are_broadcast(spark, stored):
    sales = QUERIES["clean_crm_sales"](spark, SF_DIR)
    products = with_surrogate_key(spark.range(100).select(F.concat(F.lit("PK-"), "id").alias("product_number")), "product_key", ["product_number"])
    customers = with_surrogate_key(spark.range(100).select(F.col("id").alias("customer_id")), "customer_key", ["customer_id"])
    text = plan(build_fact_sales(stored(sales, "sales"), products, customers))
    assert text.count("BroadcastHashJoin") == 2 and "Exchange hash" not in text


def test_large_dimensions_are_shuffled(spark, stored, only_small_broadcasts):
    sales = stored(QUERIES["clean_crm_sales"](spark, SF_DIR), "sales")
    products = stored(big(spark).select(F.col("v").alias("product_number"), F.col("k").alias("product_key")), "products")
    customers = stored(spark.range(50).select(F.col("id").alias("customer_id"), F.col("id").alias("customer_key")), "customers")
    text = plan(build_fact_sales(sales, products, customers))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" in text


def test_the_window_over_versions_sees_days_not_rows(spark, stored):
    df = stored(spark.range(1000).select((F.col("id") % 3).alias("k"), F.current_date().alias("s"), "id"), "v")
    text = plan(with_version_end(df, "k", "s", "e", ["id"]))
    below = text[text.index("Window") :]
    assert "HashAggregate" in below and "partial_max" in below
    assert "SinglePartition" not in text


def test_quality_is_one_pass(spark, stored):
    text = plan(quality_report(stored(big(spark), "t"), not_null=["k", "v"], not_negative=["k"]))
    assert text.count("FileScan") == 1


EAGER = {"stream_merge", "stream_merge_batches", "daily_run", "incremental_clean", "incremental_fact", "late_commits", "ledger_insert_if_absent", "snapshot_latest_load"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_query_leaves_the_engine_or_crosses_rows(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not re.search("EvalPython|InPandas|InArrow|CartesianProduct|NestedLoopJoin", text)
    for window in re.finditer(r"\bWindow \[(.*)", text):
        assert "SinglePartition" not in text[window.start() :].split("FileScan")[0]
