"""Tables of a database, read in parallel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JdbcDatabase:
    """Where a database is, and how it hashes a text column to a whole number."""

    url: str
    properties: Mapping[str, str] = field(default_factory=dict)
    text_hash: str = "HASHTEXT({column})"


def split_options(column: str, lower: object, upper: object, parts: int) -> dict[str, str]:
    """Reader options that cut a scan into ``parts`` ranges of a number, date or timestamp column.

    The bounds only place the cuts; rows outside them, and NULLs, are read as well.
    """
    return {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts)}


def hash_predicates(hashed: str, column: str, parts: int) -> list[str]:
    """One condition per task; together they cover every row once, rows without a value in the first."""
    share = f"ABS(MOD({hashed.format(column=column)}, {parts}))"
    return [f"{column} IS NULL OR {share} = {k}" if k == 0 else f"{column} IS NOT NULL AND {share} = {k}" for k in range(parts)]


def _quantile_query_in_pieces(table: str, column: str, parts: int, pieces: Sequence[str]) -> str:
    piece = "CASE " + " ".join(f"WHEN {c} THEN {k}" for k, c in enumerate(pieces)) + " END"
    numbers = " UNION ALL ".join(f"SELECT {k} AS part" for k in range(1, parts + 1))
    return (
        f"(WITH counted AS (SELECT {column}, COUNT(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}),"
        f" placed AS (SELECT {column} AS cut, n, {piece} AS piece FROM counted),"
        " sizes AS (SELECT piece, SUM(n) AS n FROM placed GROUP BY piece),"
        " ahead AS (SELECT piece, SUM(n) OVER (ORDER BY piece) - n AS ahead FROM sizes),"  # a row per piece
        " ranked AS (SELECT piece, cut, n, SUM(n) OVER (PARTITION BY piece ORDER BY cut) AS through FROM placed),"
        f" sized AS (SELECT SUM(n) AS total, MOD(SUM(n), {parts}) AS longer FROM sizes),"
        f" firsts AS (SELECT part, CAST((part - 1) * ((total - longer) / {parts}) AS BIGINT) + LEAST(part - 1, longer) + 1 AS first"
        f" FROM ({numbers}) numbers CROSS JOIN sized WHERE part <= total)"
        " SELECT part, cut FROM ranked JOIN ahead ON ranked.piece = ahead.piece"
        " JOIN firsts ON first > ahead + through - n AND first <= ahead + through) cuts"
    )


def quantile_query(table: str, column: str, parts: int, *, pieces: Sequence[str] = ()) -> str:
    """Where to cut a table into ``parts`` of about equal numbers of rows: the first value of each, NULLs aside.

    One row per part; an index on the column spares the database the sort. An engine that
    would sort the whole column in one task is given ``pieces``: conditions on the column, each
    a range and all together every value once, in order, within which values are counted and ranked.
    """
    if pieces:
        return _quantile_query_in_pieces(table, column, parts, pieces)
    ranked = f"SELECT {column} AS cut, NTILE({parts}) OVER (ORDER BY {column}) AS part FROM {table} WHERE {column} IS NOT NULL"
    return f"(SELECT part, MIN(cut) AS cut FROM ({ranked}) ranked GROUP BY part) cuts"


def _literal(value: object) -> str:
    if isinstance(value, bool | int | float | Decimal):
        return str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value}'"
    if isinstance(value, date):
        return f"DATE '{value}'"
    return "'" + str(value).replace("'", "''") + "'"


def range_predicates(column: str, cuts: Sequence[object]) -> list[str]:
    """One condition per task for the ranges that begin at ``cuts`` (ascending); together they cover every row once.

    The first range has no lower end and takes rows without a value. A value that several
    parts would begin with, one that is a large share of the rows, gets a range of its own.
    """
    starts = list(dict.fromkeys(cuts))  # in the database's own order
    if len(starts) < 2:
        return ["1 = 1"]
    held = [f"{column} < {_literal(starts[1])} OR {column} IS NULL"]
    held += [f"{column} >= {_literal(a)} AND {column} < {_literal(b)}" for a, b in zip(starts[1:], starts[2:], strict=False)]
    return [*held, f"{column} >= {_literal(starts[-1])}"]


def rough_pieces(rows: DataFrame, column: str, *, most: int = 2_000_000) -> list[str]:
    """Conditions for ranges of about ``most`` rows, of a number, date or timestamp column; there may be fewer."""
    pieces = rows.count() // most + 1
    cuts = rows.agg(F.percentile_approx(column, [k / pieces for k in range(pieces)], 100 * pieces)).first()[0]  # one row
    return range_predicates(column, sorted(cuts or []))


def bounds_query(table: str, column: str) -> str:
    return f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) bounds"


def _logged(table_name: str, after: datetime | str | None, until: datetime | str | None) -> str:
    conditions = ["l.table_name = '" + table_name.replace("'", "''") + "'"]
    if after is not None:
        conditions.append(f"l.changed_at > TIMESTAMP '{after}'")
    if until is not None:
        conditions.append(f"l.changed_at <= TIMESTAMP '{until}'")
    return " AND ".join(conditions)


def batch_end_query(log: str, table_name: str) -> str:
    """Time of the last logged change of a table; NULL if there is none."""
    return f"(SELECT MAX(l.changed_at) AS batch_end FROM {log} l WHERE {_logged(table_name, None, None)}) batch_end"


def change_bounds_query(
    log: str, *, table_name: str, after: datetime | str | None, until: datetime | str | None
) -> str:
    """First and last log number in a window, from the log alone."""
    where = _logged(table_name, after, until)
    return f"(SELECT MIN(l.log_id) AS lo, MAX(l.log_id) AS hi FROM {log} l WHERE {where}) bounds"


def change_query(
    log: str,
    source: str,
    columns: Sequence[str],
    *,
    table_name: str,
    key: str,
    after: datetime | str | None,
    until: datetime | str | None,
    text_key: bool = False,
) -> str:
    """The change extraction of ``operators.changes`` as one sub-query for the database to run.

    The logged id, a text, is turned into the type of the key and compared with the bare
    key column, so that an index on the key serves the join. A whole-number key takes only
    ids that are whole numbers of up to 18 digits, as no key has more. The logged id comes
    back as ``_logged_id``, with which the key is recovered.
    """
    signs = "TRANSLATE(l.id, '0123456789', '')"
    whole = f"LENGTH(l.id) BETWEEN 1 AND 18 AND ({signs} = '' OR ({signs} = '-' AND l.id LIKE '-_%'))"
    logged = "l.id" if text_key else f"CASE WHEN {whole} THEN CAST(l.id AS BIGINT) END"
    picked = ", ".join(["l.log_id", "l.operation_type", "l.changed_at", *[f"o.{c}" for c in columns]])
    return (
        f"(SELECT {picked}, l.id AS _logged_id FROM {log} l LEFT JOIN {source} o"
        f" ON o.{key} = {logged} WHERE {_logged(table_name, after, until)}) changes"
    )


def ask(spark: SparkSession, database: JdbcDatabase, question: str) -> Row:
    """The one row a sub-query answers with."""
    return scan_table(spark, database, question).first()


def scan_table(
    spark: SparkSession,
    database: JdbcDatabase,
    table: str,
    *,
    split_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    parts: int = 1,
    predicates: Sequence[str] | None = None,
) -> DataFrame:
    """A table or ``(sub-query) alias``.

    ``split_column`` with ``parts`` reads ranges of a number, date or timestamp
    column in as many tasks; its bounds are asked from the database unless given. A
    text key is split by ``predicates``, one condition per task, which together must
    cover every row once.
    """
    properties = dict(database.properties)
    if predicates is not None:
        return spark.read.jdbc(database.url, table, predicates=list(predicates), properties=properties)
    reader = spark.read.format("jdbc").options(url=database.url, dbtable=table, **properties)
    if split_column is not None and parts > 1:
        if bounds is None:
            bounds = tuple(ask(spark, database, bounds_query(table, split_column)))
        if bounds[0] is not None:
            reader = reader.options(**split_options(split_column, bounds[0], bounds[1], parts))
    return reader.load()
