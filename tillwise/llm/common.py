"""What the corpus operators share: reading, names that cannot clash, portable hashing."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.operators.ordering import scratch_path, shared_folder, stored

__all__ = ["BLANKS", "Scratch", "documents", "free_name", "hash_int", "scratch_path", "shared_folder", "shuffles_cleaned",
           "stored", "text_or_empty"]

# The white space that the contracts name: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores if the table already has such a column (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def hash_int(*parts: Column) -> Column:
    """52 random bits from the parts' text, the same in any SQL engine: the first 13 hex digits of an MD5.

    Nulls count as the text ``null``.
    """
    texts = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 13), 16, 10).cast("bigint")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Inside, a query's shuffle files go as soon as it has ended, not when the driver happens to collect its garbage.

    For an intermediate table that is written and not computed again. The session's own setting comes back afterwards.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """Intermediate tables of one operator: written like ``stored``, deleted when the block ends.

    What is read from them inside the block has to be written elsewhere before it ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
