"""Ranks and running totals over a whole table, without a single-task window.

``Window.orderBy`` with no partitioning moves every row to one task. Here the
table is range-sorted once and written with, for each row, the number of its
sort partition and its place in it; a rank is then the place plus the rows of
all earlier partitions, and those per-partition totals are one small row each.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder the cluster names in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tillwise-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tillwise/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage, survives lost executors, and gives the reader a columnar
    table whose true size Catalyst knows when it picks join strategies.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """The whole table sorted by ``order`` (which must be total), with the sort partition ``part_no`` and the ``place`` in it."""
    numbered = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    return numbered.select(
        *df.columns,
        F.shiftright("_id", PLACE_BITS).cast("int").alias("part_no"),
        F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place"),
    )


def stored_in_order(df: DataFrame, *order: Column, label: str = "ordered") -> DataFrame:
    """``in_order``, stored."""
    return stored(in_order(df, *order), label)


def _earlier_parts(totals: DataFrame, value: str, out: str) -> DataFrame:
    # One row per sort partition, so the single-task window has a few thousand rows at the very most.
    before = Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part_no", F.coalesce(F.sum(value).over(before), F.lit(0)).alias(out))


def with_row_number(ordered: DataFrame, name: str = "row_no") -> DataFrame:
    """1, 2, 3, … over the whole table in stored order."""
    parts = ordered.groupBy("part_no").agg(F.count("*").alias("_n"))
    # One row per sort partition: bounded by the number of partitions, never by the data.
    offsets = F.broadcast(_earlier_parts(parts, "_n", "_before"))
    return ordered.join(offsets, "part_no").withColumn(name, F.col("_before") + F.col("place") + 1).drop("_before")


def with_running_total(ordered: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over the earlier rows of the same key, and ``whole``, its sum over the key.

    ``ordered`` (or any part of it) is stored in an order that starts with
    ``keys``. Inside a sort partition the sum is an ordinary window; range
    sorting keeps those even, also where one key fills many of them. Across
    partitions it needs the totals of keys that continue from one partition to
    the next. At most one key does so at each boundary, so there are fewer than
    two such rows per sort partition, whatever the data: safe to broadcast.
    """
    valued = ordered.withColumn("_value", value.cast("decimal(28,0)"))
    key = Window.partitionBy(*keys)
    earlier_parts = key.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    continued = (
        valued.groupBy(*keys, "part_no")
        .agg(F.sum("_value").alias("_part"))
        .select(
            *keys,
            "part_no",
            F.coalesce(F.sum("_part").over(earlier_parts), F.lit(0)).cast("decimal(38,0)").alias("_offset"),
            F.sum("_part").over(key).cast("decimal(38,0)").alias("_all"),
            F.count("*").over(key).alias("_parts"),
        )
        .where("_parts > 1")
        .drop("_parts")
    )
    part = Window.partitionBy(*keys, "part_no")
    inside = part.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    return (
        valued.withColumns(
            {"_inside": F.coalesce(F.sum("_value").over(inside), zero), "_within": F.sum("_value").over(part)}
        )
        .join(F.broadcast(continued), [*keys, "part_no"], "left")
        .withColumns(
            {
                "before": (F.coalesce("_offset", zero) + F.col("_inside")).cast("decimal(38,0)"),
                "whole": F.coalesce("_all", "_within").cast("decimal(38,0)"),
            }
        )
        .drop("_value", "_inside", "_within", "_offset", "_all")
    )
