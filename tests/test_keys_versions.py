from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.keys import with_surrogate_key
from tidemark.operators.versions import with_version_end

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_surrogate_keys_are_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("k"), "id")
    out = with_surrogate_key(df, "n", ["k"]).collect()
    assert [r.n for r in sorted(out, key=lambda r: r.k)] == list(range(1, 5001))
    assert {r.id for r in out} == set(range(5000))


def test_surrogate_keys_of_a_key_with_most_rows(spark):
    """One key holds most of the rows, most of them exact copies; the ranges still split it."""
    df = spark.range(0, 9000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"),
        F.when(F.col("id") % 6 == 1, F.col("id")).otherwise(0).alias("v"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keyed = with_surrogate_key(df, "n", ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = keyed.collect()
    assert sorted(r.n for r in out) == list(range(1, 9001))
    by_number = [r.k for r in sorted(out, key=lambda r: r.n)]
    assert by_number == sorted(by_number)
    assert sorted((r.k, r.v) for r in out) == sorted((r.k, r.v) for r in df.collect())
    per_file = keyed.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert per_file < 9000 * 0.5


def test_surrogate_keys_put_null_first_and_take_no_rows(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "k int")
    assert [(r.n, r.k) for r in with_surrogate_key(df, "n", ["k"]).orderBy("n").collect()] == [(1, None), (2, 1), (3, 2)]
    empty = with_surrogate_key(df.limit(0), "n", ["k"])
    assert empty.dtypes == [("n", "bigint"), ("k", "int")] and empty.isEmpty()


DAYS = st.integers(0, 5).map(lambda n: date(2024, 1, 1) + timedelta(days=n)) | st.none()


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), DAYS), max_size=25))
def test_version_end_agrees_with_brute_force(spark, rows, versions):
    numbered = [(n, key, start) for n, (key, start) in enumerate(versions)]
    df = spark.createDataFrame(numbered, "n int, k string, starts date").withColumn("ends", F.lit("overwritten"))
    expected = []
    for n, key, start in numbered:
        own = sorted((s or date.min, m) for m, k, s in numbered if k == key)
        later = own[own.index((start or date.min, n)) + 1 :]
        following = later[0][0] if later else None
        ends = None if following in (None, date.min) else following - timedelta(days=1)
        expected.append((n, key, start, ends))
    out = with_version_end(df, "k", "starts", "ends", ["n"])
    assert rows(out, "n", "k", "starts", "ends") == sorted(expected, key=repr)


def test_version_end_with_two_tie_columns(spark, rows):
    df = spark.createDataFrame([("a", date(2024, 1, 1), 1, 2), ("a", date(2024, 1, 1), 1, 1), ("a", date(2024, 2, 1), 0, 0)], "k string, s date, x int, y int")
    assert rows(with_version_end(df, "k", "s", "e", ["x", "y"]), "y", "e") == [
        (0, None),
        (1, date(2023, 12, 31)),
        (2, date(2024, 1, 31)),
    ]
