"""What loading could not keep: which values became NULL or lost digits, and which lines were malformed.

Canonical columns have fixed types, so a file can hold values that do not fit:
text where a number belongs, an amount with too many digits before the point
(it becomes NULL) or behind it (it is rounded). ``audited`` marks them in one
bitmask per row while the row is cast; nothing is read twice and no Python runs.
Almost all values are written plainly: one pattern shows that such a text fits
its type, and only the others are cast once more to compare them.

The mask serves three uses: ``reject_report`` counts the losses of a table by
column, ``rejected`` lists the rows that lost something, with the problems by
name, and a ``Ledger`` counts them on the side, as an observed metric of
whatever job reads the loaded table first.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.schemas import CANONICAL
from tillwise.sources.conform import cast_given, conform_columns, given_value
from tillwise.sources.csv import CORRUPT

LOST = "_lost"
NULLED, ROUNDED, MALFORMED = "became NULL", "lost digits", "malformed line"
_MALFORMED_BIT = 62


def _problems(table: str) -> dict[tuple[str, str], int]:
    """(column, problem) -> bit of the mask."""
    bits = {}
    for i, field in enumerate(CANONICAL[table].fields):
        if not isinstance(field.dataType, T.StringType):
            bits[field.name, NULLED] = 2 * i
        if isinstance(field.dataType, T.DecimalType):
            bits[field.name, ROUNDED] = 2 * i + 1
    return {**bits, ("", MALFORMED): _MALFORMED_BIT}


def _exact(given: Column, dtype: T.DecimalType) -> Column:
    """The value with all 38 digits, so many before the point as the type has."""
    return given.try_cast(T.DecimalType(38, 38 - (dtype.precision - dtype.scale)))


_DAY = (
    r"[1-9]\d{3}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"
    r"(?:[ T](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d)?"
)


def _plain(named: DataFrame, field: T.StructField) -> Column | None:
    """True where a text surely fits ``field``'s type: none, blank, or written plainly with no digit too many.

    None for columns of other types. Texts that do not match may fit all the same.
    """
    if not isinstance(named.schema[field.name].dataType, T.StringType):
        return None
    if isinstance(field.dataType, T.DecimalType):
        before, behind = field.dataType.precision - field.dataType.scale, field.dataType.scale
        value = rf"[+-]?\d{{1,{before}}}(?:\.\d{{1,{behind}}}+0*+)?" if behind else rf"[+-]?\d{{1,{before}}}"
    elif isinstance(field.dataType, T.DateType):
        value = _DAY
    else:
        return None
    column = F.col(field.name)
    # White space is possessive, so a long run of it is looked at once.
    return column.isNull() | column.rlike(rf"\A\s*+(?:{value})?\s*+\z")


def _lost(named: DataFrame, field: T.StructField, problem: str, given: Column) -> Column:
    kept = cast_given(named, field, given)
    if problem == NULLED:
        return given.isNotNull() & kept.isNull()
    exact = _exact(given, field.dataType)
    return kept.isNotNull() & (exact.isNull() | (exact != kept))


def audited(df: DataFrame, table: str, dialect: str = "pos") -> DataFrame:
    """The canonical table with the mask ``_lost``: 0 where the row came through whole.

    A malformed line counts if the reader kept its text (``keep_malformed_text``);
    what such a line lacks is NULL without a mark of its own.
    """
    named, columns = conform_columns(df, table, dialect)
    marks = [_marks(named, field, _problems(table)) for field in CANONICAL[table].fields if field.name in named.columns]
    if CORRUPT in named.columns:
        marks.append(F.when(F.col(CORRUPT).isNotNull(), F.lit(1 << _MALFORMED_BIT)).otherwise(F.lit(0)))
    mask = reduce(lambda a, b: a.bitwiseOR(b), marks, F.lit(0).cast("bigint"))
    return named.select(*columns, mask.cast("bigint").alias(LOST))


def _marks(named: DataFrame, field: T.StructField, bits: Mapping[tuple[str, str], int]) -> Column:
    """The bits of one column."""

    def marks(given: Column) -> Column:
        each = [
            F.when(_lost(named, field, problem, given), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
            for (column, problem), bit in bits.items()
            if column == field.name
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), each, F.lit(0).cast("bigint"))

    given, plain = given_value(named, field), _plain(named, field)
    if plain is None:
        return marks(given)
    # As an array's element the value is worked out once, and its casts stay out of the code that every row runs through.
    return F.when(plain, F.lit(0).cast("bigint")).otherwise(F.get(F.transform(F.array(given), marks), F.lit(0)))


def _has(bit: int) -> Column:
    return F.col(LOST).bitwiseAND(F.lit(1 << bit)) != 0


def reject_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``file, field, problem, n_rows`` over audited tables: one row for each problem that occurred."""
    return reduce(DataFrame.unionByName, [_counted(df, table) for table, df in tables.items()])


def _counted(df: DataFrame, table: str) -> DataFrame:
    bits = _problems(table)
    counts = df.agg(*[F.count_if(_has(bit)).alias(f"n{bit}") for bit in bits.values()])
    return counts.select(F.inline(F.array(*[_line(table, c, p, F.col(f"n{bit}")) for (c, p), bit in bits.items()]))).where("n_rows > 0")


def _line(table: str, column: str, problem: str, n: Column) -> Column:
    return F.struct(
        F.lit(table).alias("file"), F.lit(column).alias("field"), F.lit(problem).alias("problem"), n.cast("bigint").alias("n_rows")
    )


def rejected(df: DataFrame, table: str) -> DataFrame:
    """The rows of an audited table that lost something, with ``problems``: an array of ``column: problem``."""
    named = [
        F.when(_has(bit), F.lit(f"{column}: {problem}" if column else problem))
        for (column, problem), bit in _problems(table).items()
    ]
    return df.where(F.col(LOST) != 0).withColumn("problems", F.array_compact(F.array(*named))).drop(LOST)


class Ledger:
    """Counts what loading lost, on the side of the first job that reads each loaded table.

    A job that stops early, after some rows, counts those rows only.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, table: str) -> DataFrame:
        """An audited table without its mask, counted when it is read."""
        self._seen[table] = Observation(f"{table}-losses")
        counts = [F.count_if(_has(bit)).alias(f"n{bit}") for bit in _problems(table).values()]
        return df.observe(self._seen[table], F.count("*").alias("rows"), *counts).drop(LOST)

    def rows(self, table: str) -> int:
        """How many rows were read; waits until a job has read the table."""
        return self._seen[table].get["rows"]

    def losses(self, table: str) -> dict[tuple[str, str], int]:
        """(column, problem) -> rows, for problems that occurred; waits until a job has read the table."""
        seen = self._seen[table].get
        return {key: seen[f"n{bit}"] for key, bit in _problems(table).items() if seen[f"n{bit}"]}

    def report(self, spark: SparkSession) -> DataFrame:
        """The same for all tables as ``file, field, problem, n_rows``."""
        rows = [(t, c, p, n) for t in self._seen for (c, p), n in self.losses(t).items()]
        return spark.createDataFrame(rows, "file string, field string, problem string, n_rows bigint")
