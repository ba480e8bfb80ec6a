"""CSV files in and out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.sources.order import LOAD_NO, load_number

CORRUPT = "_malformed"


def _header(spark: SparkSession, path: str | list[str]) -> list[str]:
    return spark.read.options(header=True, inferSchema=False, escape='"', encoding="UTF-8").csv(path).columns


def _is_junk(name: str) -> bool:
    """Spreadsheet exports leave columns without a name behind."""
    return "Unnamed:" in name or re.fullmatch(r"_c\d+", name) is not None


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    strict: bool = False,
    multiline: bool = False,
    keep_malformed_text: bool = False,
    load_order: bool = False,
) -> DataFrame:
    """All columns as text, under trimmed names, without junk columns and blank lines.

    Only the header line is read to learn the columns; the data is read once,
    in parallel. A line with too few or too many fields stays, with what could
    be read of it (``keep_malformed_text`` adds the line as ``_malformed``),
    unless ``strict``, which fails. An open quote ends with its line and costs
    that line only; quoted values that really span lines are the caller's to
    announce with ``multiline=True``, which reads each file in one task. Files
    whose header differs from the first one's are refused, not read by
    position: read them one by one and unite them by name. Headers with nameless
    columns are compared file by file (one look at each file's first line), and
    files that have the same columns in another order are united by name.
    ``load_order`` adds ``load_no``, which sorts rows as the files were given.
    """
    options = {"strict": strict, "multiline": multiline, "keep_malformed_text": keep_malformed_text}
    options["load_order"] = load_number(path) if load_order else None
    header = _header(spark, path)
    if any(re.fullmatch(r"_c\d+", name) for name in header):
        groups: dict[tuple[str, ...], list[str]] = {}
        for file in spark.read.text(path).inputFiles():
            groups.setdefault(tuple(_header(spark, file)), []).append(file)
        if len(groups) > 1:
            names = [{_trimmed(n) for n in names if not _is_junk(n)} for names in groups]
            if any(n != names[0] for n in names):
                raise ValueError(f"headers differ: {'; '.join(', '.join(sorted(n)) for n in names)}")
            parts = [_read(spark, files, list(names), **options) for names, files in groups.items()]
            return reduce(DataFrame.unionByName, parts)
    return _read(spark, path, header, **options)


def _trimmed(name: str) -> str:
    return name.strip("\ufeff").strip()


def _read(
    spark: SparkSession, path: str | list[str], header: list[str], strict: bool, multiline: bool, keep_malformed_text: bool,
    load_order: Column | None,
) -> DataFrame:
    """Files of one header."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    # A header with nameless columns cannot be compared with the names that Spark makes up for them.
    nameless = any(re.fullmatch(r"_c\d+", name) for name in header)
    reader = spark.read.options(
        enforceSchema=nameless, header=True, escape='"', multiLine=multiline, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT
    )
    if strict or keep_malformed_text:
        # Otherwise a line is not checked as a whole when a query reads some of its columns only.
        reader = reader.option("columnPruning", False)
    raw = reader.schema(schema.add(CORRUPT, T.StringType())).csv(path)
    if load_order is not None:
        raw = raw.withColumn(LOAD_NO, load_order)
    if strict:
        # The first column appears in the message because Spark refuses to read the malformed text alone.
        line = F.coalesce(CORRUPT, F.col(f"`{header[0]}`"))
        raw = raw.where(F.assert_true(F.col(CORRUPT).isNull(), F.concat(F.lit("malformed row: "), line)).isNull())
    # Spark makes repeated header names unique by position, so names can be matched one to one.
    kept = [(name, _trimmed(name)) for name in header if not _is_junk(name)]
    columns = [F.col(f"`{name}`").alias(trimmed) for name, trimmed in kept]
    return raw.select(*columns, *([CORRUPT] if keep_malformed_text else []), *([LOAD_NO] if load_order is not None else []))


def write_csv(df: DataFrame, path: str) -> None:
    """Replace ``path`` by ``df`` as CSV with a header; one file per partition, so the write is parallel."""
    df.write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)
