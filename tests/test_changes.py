from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.changes import batch_end, distinct_rows, extract_changes, latest_per_key, snapshot_diff
from tidemark.operators.merge import apply_changes, merge_into_table

FEW = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
LOG = "log_id int, operation_type string, table_name string, id string, changed_at timestamp_ntz"


def at(minute):
    return datetime(2024, 1, 1, 0, minute)


def the_log(spark):
    return spark.createDataFrame(
        [
            (1, "INSERT", "crm_customer", "1", at(1)),
            (2, "UPDATE", "crm_products", "1", at(2)),
            (3, "DELETE", "crm_customer", "2", at(3)),
            (4, "UPDATE", "crm_customer", "1", at(5)),
            (5, "UPDATE", "crm_customer", "SO-7", at(5)),
            (6, "UPDATE", "crm_customer", "3", at(6)),
        ],
        LOG,
    )


def the_source(spark):
    return spark.createDataFrame([(1, "one", "Alan"), (3, "three", "Grace"), (4, "four", "Ada")], "cst_id int, id string, name string")


def test_extract_changes(spark, rows):
    changes = extract_changes(
        the_log(spark),
        the_source(spark),
        table_name="crm_customer",
        key="cst_id",
        after=at(1),
        until=at(5),
    )
    assert changes.columns == ["log_id", "operation_type", "changed_at", "cst_id", "id", "name"]
    assert rows(changes) == [
        (3, "DELETE", at(3), 2, None, None),
        (4, "UPDATE", at(5), 1, "one", "Alan"),
        (5, "UPDATE", at(5), None, None, None),
    ]


def test_extract_changes_without_bounds_and_of_a_text_key(spark, rows):
    source = the_source(spark).withColumn("cst_id", F.col("cst_id").cast("string"))
    changes = extract_changes(the_log(spark), source, table_name="crm_customer", key="cst_id")
    assert rows(changes, "log_id", "cst_id", "name") == [
        (1, "1", "Alan"),
        (3, "2", None),
        (4, "1", "Alan"),
        (5, "SO-7", None),
        (6, "3", "Grace"),
    ]


def test_batch_end(spark):
    assert batch_end(the_log(spark), "crm_customer").first()[0] == at(6)
    assert batch_end(the_log(spark), "other", fallback=at(9)).first()[0] == at(9)
    assert batch_end(the_log(spark), "other").first()[0] > at(9)


def test_latest_and_distinct(spark, rows):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 4, 9), (2, None, 1), (None, 1, 1), (None, 2, 1)], "k int, t int, n int")
    assert rows(latest_per_key(df, ["k"], ["t", "n"])) == [(1, 5, 2), (2, None, 1), (None, 2, 1)]
    assert distinct_rows(df.union(df)).count() == 6


def test_snapshot_diff(spark, rows):
    schema = "k int, j string, v string, w int"
    old = spark.createDataFrame([(1, "a", "x", 1), (1, "b", None, 2), (2, "a", "y", None), (3, "a", "z", 3)], schema)
    new = spark.createDataFrame([(1, "a", "x", 1), (1, "b", None, 3), (2, "a", None, None), (4, "a", "n", 4)], schema)
    diff = snapshot_diff(old, new, ["k", "j"])
    assert rows(diff) == [
        ("DELETE", 3, "a", None, None),
        ("INSERT", 4, "a", "n", 4),
        ("UPDATE", 1, "b", None, 3),
        ("UPDATE", 2, "a", None, None),
    ]


TARGET = [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
CHANGES = [("DELETE", 1, None), ("UPDATE", 2, "B"), ("INSERT", 3, "C"), ("UPDATE", 4, "D"), ("INSERT", 5, "E"), ("DELETE", 6, None), ("INSERT", None, "N")]


@pytest.mark.parametrize(
    ("mode", "expected"),
    [
        ("strict", [(2, "B"), (3, "c"), (5, "E"), (None, "n")]),
        ("upsert", [(2, "B"), (3, "C"), (4, "D"), (5, "E"), (None, "n")]),
    ],
)
def test_apply_changes(spark, rows, mode, expected):
    target = spark.createDataFrame(TARGET, "k int, v string")
    changes = spark.createDataFrame(CHANGES, "operation_type string, k int, v string")
    assert rows(apply_changes(target, changes, ["k"], mode=mode)) == expected


def test_two_changes_for_one_key_are_an_error(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    changes = spark.createDataFrame([("UPDATE", 1, "b"), ("UPDATE", 1, "c")], "operation_type string, k int, v string")
    with pytest.raises(Exception, match="more than one change"):
        apply_changes(target, changes, ["k"]).collect()


def test_a_value_that_does_not_fit_becomes_null(spark, rows):
    target = spark.createDataFrame([(1, 5)], "k int, v int")
    changes = spark.createDataFrame([("UPDATE", 1, "many"), ("INSERT", 2, "7")], "operation_type string, k int, v string")
    assert rows(apply_changes(target, changes, ["k"])) == [(1, None), (2, 7)]


def test_apply_changes_rejects_other_modes(spark):
    df = spark.createDataFrame(TARGET, "k int, v string")
    with pytest.raises(ValueError, match="mode"):
        apply_changes(df, df, ["k"], mode="replace")


def test_apply_changes_casts_to_the_target(spark, rows):
    target = spark.createDataFrame([(1, 1.5)], "k bigint, v double")
    changes = spark.createDataFrame([("UPDATE", "1", 2), ("INSERT", "7", 3)], "operation_type string, k string, v int")
    out = apply_changes(target, changes, ["k"])
    assert out.dtypes == target.dtypes
    assert rows(out) == [(1, 2.0), (7, 3.0)]


def merged(table, changes, mode):
    """The merge on a dict, one change per key."""
    out = dict(table)
    for operation, key, value in changes:
        if operation == "DELETE":
            out.pop(key, None)
        elif (key in table) == (operation == "UPDATE") or mode == "upsert":
            out[key] = value
    return out


KEYS = st.integers(0, 9)
TABLES = st.dictionaries(KEYS, st.sampled_from(["p", "q", None]), max_size=8)
LOGGED = st.lists(st.tuples(st.sampled_from(["INSERT", "UPDATE", "DELETE"]), KEYS, st.sampled_from(["x", "y", None])), max_size=20)


@FEW
@given(TABLES, LOGGED, st.sampled_from(["strict", "upsert"]))
def test_merge_agrees_with_a_dict(spark, rows, table, logged, mode):
    last = {key: (operation, key, value) for operation, key, value in logged}
    target = spark.createDataFrame(list(table.items()), "k int, v string")
    log = spark.createDataFrame([(i, *c) for i, c in enumerate(logged)], "n int, operation_type string, k int, v string")
    out = apply_changes(target, latest_per_key(log, ["k"], ["n"]), ["k"], mode=mode)
    assert rows(out) == sorted(merged(table, last.values(), mode).items(), key=repr)


@FEW
@given(TABLES, LOGGED)
def test_one_batch_equals_one_by_one(spark, rows, table, logged):
    state = dict(table)
    for change in logged:
        state = merged(state, [change], "upsert")
    target = spark.createDataFrame(list(table.items()), "k int, v string")
    log = spark.createDataFrame([(i, *c) for i, c in enumerate(logged)], "n int, operation_type string, k int, v string")
    out = apply_changes(target, latest_per_key(log, ["k"], ["n"]), ["k"], mode="upsert")
    assert rows(out) == sorted(state.items(), key=repr)


@FEW
@given(TABLES, TABLES)
def test_diff_applied_gives_the_new_snapshot(spark, rows, old, new):
    before = spark.createDataFrame(list(old.items()), "k int, v string")
    after = spark.createDataFrame(list(new.items()), "k int, v string")
    diff = snapshot_diff(before, after, ["k"])
    assert rows(apply_changes(before, diff, ["k"])) == rows(after)
    assert snapshot_diff(after, after, ["k"]).isEmpty()


def test_merge_into_a_table_without_row_level_support_is_refused(spark):
    spark.range(3).withColumn("v", F.lit("a")).write.mode("overwrite").saveAsTable("plain_target")
    changes = spark.createDataFrame([("DELETE", 1, "b")], "operation_type string, id bigint, v string")
    with pytest.raises(Exception, match="UNSUPPORTED_FEATURE.TABLE_OPERATION"):
        merge_into_table("plain_target", spark.table("plain_target"), changes, ["id"])
    spark.sql("DROP TABLE plain_target")
