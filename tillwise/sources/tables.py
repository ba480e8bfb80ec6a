"""The four tables of a shop: loading, current data, and stored sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.schemas import CANONICAL, RENAMES, TABLES, empty_table
from tillwise.sources.conform import conform, to_dialect
from tillwise.sources.csv import read_csv, write_csv
from tillwise.sources.ledger import Ledger, audited
from tillwise.sources.order import LOAD_NO, load_number
from tillwise.sources.validate import SchemaError, table_problems

# File name of each table in a data folder.
CSV_NAMES = {
    "transactions": "pos_transactions_week.csv",
    "refunds": "pos_refunds_week.csv",
    "payouts": "pos_payouts_week.csv",
    "products": "product_master.csv",
}


class NoData(ValueError):
    """Data was asked for before any was loaded."""


def _read(
    spark: SparkSession, table: str, path: str | Sequence[str], fmt: str, strict: bool, audit: bool, load_order: bool
) -> DataFrame:
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}; expected one of {TABLES}")
    if fmt == "csv":
        return read_csv(spark, path, strict, keep_malformed_text=audit, load_order=load_order)
    df = spark.read.format(fmt).load(path)
    return df.withColumn(LOAD_NO, load_number(path)) if load_order else df


def load_table(
    spark: SparkSession, table: str, path: str, fmt: str = "csv", dialect: str = "pos", strict: bool = False
) -> DataFrame:
    """One canonical table from CSV, JSON or Parquet; a missing path or column is an error."""
    return load_tables(spark, {table: path}, fmt, dialect, strict)[table]


def load_tables(
    spark: SparkSession,
    paths: Mapping[str, str | Sequence[str]],
    fmt: str = "csv",
    dialect: str = "pos",
    strict: bool = False,
    validate: bool = True,
    ledger: Ledger | None = None,
    load_order: bool = False,
) -> dict[str, DataFrame]:
    """The tables for which a path is given; at least one.

    What is wrong with any of them is reported in one error. ``validate=False``
    takes files as they are, with NULL for columns they lack. A ``ledger``
    counts the values and lines that do not come through whole. A table may
    come in several paths; with ``load_order`` its rows carry ``load_no``, and
    where results ask for what was loaded last, that decides.
    """
    given = {table: path for table, path in paths.items() if path}
    if not given:
        raise NoData("no files given")
    raw = {table: _read(spark, table, path, fmt, strict, ledger is not None, load_order) for table, path in given.items()}
    if validate:
        problems = [p for table, df in raw.items() for p in table_problems(df, table, dialect)]
        if problems:
            raise SchemaError("; ".join(problems))
    if ledger is not None and not strict:
        return {table: ledger.watch(audited(df, table, dialect), table) for table, df in raw.items()}
    return {table: conform(df, table, dialect, strict) for table, df in raw.items()}


def load_folder(spark: SparkSession, folder: str, **options) -> dict[str, DataFrame]:
    """All four tables from a data folder under their usual names."""
    return load_tables(spark, {t: f"{folder.rstrip('/')}/{name}" for t, name in CSV_NAMES.items()}, **options)


def save_folder(tables: Mapping[str, DataFrame], folder: str, dialect: str = "pos") -> None:
    """Write canonical tables into a data folder as CSV of one dialect, replacing only those given."""
    for table, df in tables.items():
        write_csv(to_dialect(df, table, dialect), f"{folder.rstrip('/')}/{CSV_NAMES[table]}")


def _view(table: str) -> str:
    return f"till_{table}"


def set_current(tables: Mapping[str, DataFrame]) -> None:
    """Make tables the current data; a table not given keeps what it had."""
    for table, df in tables.items():
        if table not in TABLES:
            raise ValueError(f"unknown table {table!r}; expected one of {TABLES}")
        df.createOrReplaceTempView(_view(table))


def current(spark: SparkSession) -> dict[str, DataFrame]:
    """The current tables; an error while there are no transactions."""
    known = {t: spark.table(_view(t)) for t in TABLES if spark.catalog.tableExists(_view(t))}
    if "transactions" not in known:
        raise NoData("no data loaded; load the tables first")
    return known


def with_empty(spark: SparkSession, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All four tables, those not given being empty."""
    return {t: tables[t] if t in tables else empty_table(spark, t) for t in TABLES}


def _session_path(folder: str, table: str, session_id: str, version: int) -> str:
    return f"{folder.rstrip('/')}/{table}/session_id={quote(session_id, safe='')}/v{version}"


def _commits(folder: str, session_id: str) -> str:
    return f"{folder.rstrip('/')}/commits/session_id={quote(session_id, safe='')}"


def session_version(spark: SparkSession, folder: str, session_id: str) -> int | None:
    """The number of the last save that went through; None if none did."""
    path = _commits(folder, session_id)
    if not _exists(spark, path):
        return None
    return spark.read.schema("version int").option("recursiveFileLookup", True).json(path).agg(F.max("version")).first()[0]


def save_session(tables: Mapping[str, DataFrame], folder: str, session_id: str) -> int:
    """Store a session: all four tables, those not given as empty ones, in place of whatever the session held before.

    Each save is a version of its own. Its commit record is written last: until
    then, and if the save breaks off, readers see the version before. Returns
    the version. Of two saves at the same time one fails.
    """
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    version = (session_version(spark, folder, session_id) or 0) + 1
    for table, df in with_empty(spark, tables).items():
        # In canonical types, which loading relies on; a value that does not fit is an error here, not a loss.
        path = _session_path(folder, table, session_id, version)
        conform(df, table, strict=True).select(*CANONICAL[table].names).write.mode("overwrite").parquet(path)
    record = spark.range(1).select(F.lit(session_id).alias("session"), F.lit(version).alias("version"))
    record.coalesce(1).write.mode("error").json(f"{_commits(folder, session_id)}/v{version}")
    return version


def session_paths(spark: SparkSession, folder: str, session_id: str, version: int | None = None) -> dict[str, str]:
    """Where the four tables of a session lie, all of the same save; an error if there is none."""
    known = session_version(spark, folder, session_id)
    if known is None or (version is not None and not 1 <= version <= known):
        raise NoData(f"no session {session_id!r}{'' if version is None else f' version {version}'} in {folder}")
    return {table: _session_path(folder, table, session_id, version or known) for table in TABLES}


def load_session(spark: SparkSession, folder: str, session_id: str, version: int | None = None) -> dict[str, DataFrame]:
    """The four tables of one session as last saved, or of one version; an error if there is none."""
    paths = session_paths(spark, folder, session_id, version)
    return {table: spark.read.schema(CANONICAL[table]).parquet(path) for table, path in paths.items()}


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


def load_session_json(spark: SparkSession, path: str, dialect: str = "pos", strict: bool = False) -> dict[str, DataFrame]:
    """A session kept as one JSON document holding four lists of records under a dialect's names."""

    renames = RENAMES.get(dialect, {})

    def record(table: str) -> T.StructType:
        names = dict.fromkeys([*renames.get(table, {}), *CANONICAL[table].fieldNames()])
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def rows(bundle: DataFrame, table: str) -> DataFrame:
        df = bundle.select(F.inline(table))
        for own, canonical in renames.get(table, {}).items():
            df = df.withColumn(canonical, F.coalesce(own, canonical)).drop(own)
        return conform(df, table, dialect, strict)

    lists = T.StructType([T.StructField(t, T.ArrayType(record(t))) for t in TABLES])
    bundle = spark.read.schema(lists).option("multiLine", True).json(path)
    return {t: rows(bundle, t) for t in TABLES}
