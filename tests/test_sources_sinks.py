import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quality import profile, quality_report, require_quality
from tidemark.operators.staging import scratch_folder, staged
from tidemark.plans.specs import CRM_CUSTOMERS, TABLES
from tidemark.sinks.files import write_change_batch, write_snapshot
from tidemark.sinks.state import FileLedger, Watermarks
from tidemark.sinks.tables import VersionedTable, create_or_replace
from tidemark.sources.files import list_files, newest_snapshot_rows, read_files, read_snapshots, unprocessed
from tidemark.sources.jdbc import (
    JdbcDatabase,
    batch_end_query,
    bounds_query,
    change_bounds_query,
    change_query,
    hash_predicates,
    scan_table,
    split_options,
)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "lake")


def test_snapshots_keep_their_date(spark, rows, folder):
    days = {"2024-01-01": [(1, "a"), (2, "a")], "2024-01-02": [(2, "b"), (3, "b")]}
    for day, data in days.items():
        written = write_snapshot(spark.createDataFrame(data, "k int, v string"), folder, source="CRM", table="t", load_date=day)
        assert written == 2
    assert rows(read_snapshots(spark, folder), "k", "load_date") == [
        (1, date(2024, 1, 1)), (2, date(2024, 1, 1)), (2, date(2024, 1, 2)), (3, date(2024, 1, 2)),
    ]
    one_day = read_snapshots(spark, folder, [date(2024, 1, 2)])
    assert rows(one_day, "k", "v") == [(2, "b"), (3, "b")]
    assert rows(newest_snapshot_rows(read_snapshots(spark, folder), ["k"]), "k", "v") == [(1, "a"), (2, "b"), (3, "b")]


def test_a_snapshot_of_one_day_is_replaced(spark, folder):
    for data in ([(1,), (2,)], [(3,)]):
        write_snapshot(spark.createDataFrame(data, "k int"), folder, source="CRM", table="t", load_date="2024-01-01")
    assert [r.k for r in read_snapshots(spark, folder).collect()] == [3]


def test_snapshot_profile(spark, folder):
    empty = spark.createDataFrame([], "k int, v string")
    write_snapshot(empty, folder, source="ERP", table="loc", load_date="2024-01-01", created_at=datetime(2024, 1, 1, 9))
    lines = spark.read.text(f"{folder}/load_date=2024-01-01/metadata").collect()
    assert [json.loads(r.value) for r in lines] == [
        {
            "source": "ERP", "table": "loc", "extract_type": "snapshot", "load_date": "2024-01-01", "row_count": 0,
            "column_count": 2, "schema": "struct<k:int,v:string>", "created_at": "2024-01-01T09:00:00",
        }
    ]


def test_change_files_are_listed_and_read_once(spark, rows, folder):
    schema = "log_id int, changed_at timestamp_ntz, k int"
    for n, batch_id in ((1, "start"), (2, "second")):
        batch = spark.createDataFrame([(n, datetime(2024, 1, n), n)], schema).coalesce(1)
        assert write_change_batch(batch, folder, load_date="2024-01-03", batch_id=batch_id) == 1
    files = list_files(spark, folder)
    assert files.count() == 2
    ledger = FileLedger(spark, f"{folder}-files", "crm.customers")
    first = files.filter(F.col("file_name").contains("batch_id=start"))
    ledger.add(first, datetime(2024, 1, 4))
    ledger.add(first, datetime(2024, 1, 5))
    assert [r.processed_at for r in ledger.read().collect()] == [datetime(2024, 1, 4)]
    left = unprocessed(files, ledger.read(), "crm.customers")
    names = [r.file_name for r in left.collect()]
    assert len(names) == 1
    read = read_files(spark, folder, names)
    assert rows(read, "k", "load_date", "batch_id") == [(2, date(2024, 1, 3), "second")]
    assert unprocessed(files, ledger.read(), "crm.sales").count() == 2
    write_change_batch(batch, folder, load_date="2024-01-03", batch_id="second")
    assert list_files(spark, folder).count() == 2


def test_watermarks(spark, folder):
    marks = Watermarks(spark, folder)
    assert marks.read("crm_sales") is None
    for value in (datetime(2024, 1, 2, 3, 4, 5, 678901), datetime(2023, 1, 1)):
        marks.save("crm_sales", value)
        assert marks.read("crm_sales") == value
    assert marks.read("crm_customer") is None


def test_versioned_table(spark, rows, folder):
    table = VersionedTable(spark, folder)
    assert table.version() == 0
    with pytest.raises(LookupError):
        table.read()
    table.replace(spark.createDataFrame([(1, datetime(2024, 1, 1))], "k int, _created_at timestamp"), day_of="_created_at")
    before = table.read()
    assert before.columns == ["k", "_created_at"]
    grown = before.union(spark.createDataFrame([(2, datetime(2024, 1, 2))], before.schema))
    assert table.replace(grown, batch_id="b1") == 2
    assert rows(before, "k") == [(1,)]
    assert rows(table.read(), "k") == [(1,), (2,)]
    assert table.replace(grown.limit(0), batch_id="b1") == 2
    assert rows(table.read(), "k") == [(1,), (2,)]


def test_day_partitions_are_pruned(spark, rows, folder):
    df = spark.createDataFrame([(n, datetime(2024, 1, n)) for n in (1, 2, 3)], "k int, _created_at timestamp")
    table = VersionedTable(spark, folder)
    table.replace(df, day_of="_created_at")
    late = table.read(since=date(2024, 1, 2))
    assert rows(late, "k") == [(2,), (3,)]
    assert late.columns == df.columns and len(late.inputFiles()) == 3
    assert "PartitionFilters: [isnotnull(_created_date" in late._jdf.queryExecution().executedPlan().toString()


def test_a_version_that_was_not_committed_is_not_read(spark, rows, folder):
    table = VersionedTable(spark, folder)
    table.replace(spark.createDataFrame([(1,)], "k int"))
    spark.createDataFrame([(9,)], "k int").write.parquet(f"{folder}/versions/00000002")
    assert rows(table.read()) == [(1,)]
    table.replace(spark.createDataFrame([(2,)], "k int"))
    assert rows(table.read()) == [(2,)]


def test_catalog_tables(spark, rows):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 5))], "k int, _created_at timestamp")
    for _ in range(2):
        create_or_replace(df, "dated_table", day_of="_created_at")
    create_or_replace(df, "plain_table")
    assert rows(spark.table("dated_table"), "k") == rows(spark.table("plain_table"), "k") == [(1,)]
    assert "2024-01-01" in spark.sql("SHOW PARTITIONS dated_table").first()[0]
    for name in ("dated_table", "plain_table"):
        spark.sql(f"DROP TABLE {name}")


def test_staged_frames_are_fixed(spark):
    df = staged(spark.range(100).withColumn("r", F.rand()))
    assert df.collect() == df.collect()
    assert scratch_folder(spark) != scratch_folder(spark)


def test_quality(spark, rows):
    df = spark.createDataFrame([(1, -2.0), (None, 3.0), (None, None)], "a int, b double")
    assert rows(quality_report(df, not_null=["a", "b"], not_negative=["b"])) == [
        ("a", "not_null", 2), ("b", "not_negative", 1), ("b", "not_null", 1),
    ]
    with pytest.raises(ValueError, match="a not_null: 2 rows; b not_negative: 1 rows"):
        require_quality(df, not_null=["a"], not_negative=["b"])
    require_quality(df.filter("a = 1"), not_null=["a", "b"])
    with pytest.raises(ValueError, match="name at least one"):
        quality_report(df)
    assert rows(profile(df)) == [(3, 2, "struct<a:int,b:double>")]


def test_jdbc_reader_options_and_queries():
    assert split_options("cst_id", 1, 9000, 8) == {
        "partitionColumn": "cst_id", "lowerBound": "1", "upperBound": "9000", "numPartitions": "8",
    }
    assert bounds_query('"CRM".cust_info', "cst_id") == '(SELECT MIN(cst_id) AS lo, MAX(cst_id) AS hi FROM "CRM".cust_info) bounds'
    text = change_query("log", "src", ["k", "v"], table_name="it's", key="k", after=None, until=datetime(2024, 1, 2))
    assert text == (
        "(SELECT l.log_id, l.operation_type, l.changed_at, o.k, o.v, l.id AS _logged_id FROM log l LEFT JOIN src o"
        " ON o.k = CASE WHEN LENGTH(l.id) BETWEEN 1 AND 18 AND (TRANSLATE(l.id, '0123456789', '') = ''"
        " OR (TRANSLATE(l.id, '0123456789', '') = '-' AND l.id LIKE '-_%')) THEN CAST(l.id AS BIGINT) END"
        " WHERE l.table_name = 'it''s' AND l.changed_at <= TIMESTAMP '2024-01-02 00:00:00') changes"
    )


def test_pushed_changes_match_on_the_bare_key(spark, rows):
    long_key = "k" * 60
    log = spark.createDataFrame(
        [(1, "UPDATE", "t", i) for i in (long_key, "7", "-7", "seven", "7-", "", "9" * 30)], "log_id int, operation_type string, table_name string, id string"
    ).withColumn("changed_at", F.lit("2024-01-01").cast("timestamp"))
    texts = spark.createDataFrame([(long_key, "long"), ("7", "text")], "k string, v string")
    numbers = spark.createDataFrame([(7, "plus"), (-7, "minus")], "k int, v string")
    for source, text_key, expected in ((texts, True, {long_key: "long", "7": "text"}), (numbers, False, {"7": "plus", "-7": "minus"})):
        question = change_query("{log}", "{src}", ["v"], table_name="t", key="k", after=None, until=None, text_key=text_key)
        assert "CAST(o." not in question
        found = spark.sql(f"SELECT * FROM {question}", log=log, src=source)
        assert {r["_logged_id"]: r["v"] for r in found.collect() if r["v"]} == expected
        assert found.count() == 7


def test_every_table_has_a_split(spark):
    for spec in TABLES:
        if spec.split_column is None:
            conditions = hash_predicates("hash({column})", spec.key[0], 8)
            assert len(conditions) == 8 and conditions[0].startswith(f"{spec.key[0]} IS NULL OR")
            keys = spark.createDataFrame([(f"k{n}",) for n in range(200)] + [(None,)], f"{spec.key[0]} string")
            assert sum(keys.filter(c).count() for c in conditions) == 201
        else:
            assert spec.columns[spec.split_column].dataType.typeName() == "integer"


class NoSharedFolder:
    """A session that names no checkpoint folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        getCheckpointDir = staticmethod(lambda: None)


def test_scratch_needs_a_shared_folder():
    with pytest.raises(ValueError, match="share"):
        scratch_folder(NoSharedFolder)


class RecordingReader:
    """Stands in for the session's reader: notes what a scan asks for, answers bounds 1 and 9."""

    def __init__(self, scans=None):
        self.scans = [] if scans is None else scans
        self.options_seen = {}

    @property
    def read(self):
        return RecordingReader(self.scans)

    def format(self, name):
        self.options_seen["format"] = name
        return self

    def options(self, **given):
        self.options_seen.update(given)
        return self

    def jdbc(self, url, table, predicates, properties):
        self.scans.append({"url": url, "dbtable": table, "predicates": predicates, **properties})

    def load(self):
        self.scans.append(self.options_seen)
        return self

    def first(self):
        return (1, 9)


def test_jdbc_scans():
    database = JdbcDatabase("jdbc:x:db", {"user": "u"})
    plain = RecordingReader()
    scan_table(plain, database, "t")
    assert plain.scans == [{"format": "jdbc", "url": "jdbc:x:db", "dbtable": "t", "user": "u"}]
    split = RecordingReader()
    scan_table(split, database, "t", split_column="k", parts=4)
    assert [s["dbtable"] for s in split.scans] == ["(SELECT MIN(k) AS lo, MAX(k) AS hi FROM t) bounds", "t"]
    assert split.scans[1]["numPartitions"] == "4" and split.scans[1]["upperBound"] == "9"
    listed = RecordingReader()
    scan_table(listed, database, "t", predicates=["k < 5", "k >= 5 OR k IS NULL"])
    assert listed.scans[0]["predicates"] == ["k < 5", "k >= 5 OR k IS NULL"]


def test_jdbc_log_queries_run_as_sql(spark):
    schema = "log_id int, table_name string, changed_at timestamp"
    log = spark.createDataFrame([(n, "t" if n > 1 else "other", datetime(2024, 1, n)) for n in range(1, 6)], schema)
    end = spark.sql(f"SELECT * FROM {batch_end_query('{log}', 't')}", log=log).first()
    assert end.batch_end == datetime(2024, 1, 5)
    window = {"table_name": "t", "after": datetime(2024, 1, 2), "until": datetime(2024, 1, 4)}
    assert tuple(spark.sql(f"SELECT * FROM {change_bounds_query('{log}', **window)}", log=log).first()) == (3, 4)


def test_specs_name_six_tables(spark):
    assert [s.name for s in TABLES] == [
        "crm.customers", "crm.products", "crm.sales", "erp.customers", "erp.locations", "erp.categories",
    ]
    assert len({s.log_name for s in TABLES}) == 6
    with pytest.raises(ValueError, match="lacks columns"):
        CRM_CUSTOMERS.conform(spark.range(1))
