"""Sharding by a two-pass external shuffle.

Pass one scatters whole rows over the buckets of their shards by seeded hashes
and writes them, so that a bucket fits in a task's memory. Pass two reads one
bucket at a time, permutes it by Fisher-Yates (``shuffle``, which swaps inside
an array of the bucket's rows) and puts buckets behind one another: a uniformly
random order of the whole that never holds more than a bucket.

The law is ``key``: a row's shard follows from its key and the number of shards
alone, as the shard whose hash with the key is highest. One more shard takes
the rows for which its own hash is highest and no other row moves.

The bucket inside the shard follows from the key and the row's content, so rows
of one key spread over all buckets of their shard. Each shard has as many
buckets as its own bytes ask for. Identical rows that would overfill a bucket
are dealt over the buckets by their row number in the input; which of them goes
where makes no difference, but how many meet the other rows of a bucket, and
with it the order inside that shard, then depends on the input's layout.

Keys may be null (one key like any other) and repeated. Texts may be null or
empty (size 1, CRC 0). Equal texts under different keys scatter like any rows.
An empty table gives an empty result. Columns may have any names; the row
travels as a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from tillwise.llm.common import hash_int, scratch_path, stored, text_or_empty

SHARDS = 8
SEED = 811
# A bucket is one task's array in pass two.
BUCKET_BYTES = 32 << 20
# What a row takes beside its texts.
ROW_BYTES = 64


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Highest random weight: the shard whose hash with the key is largest."""
    weights = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(hash_int(F.lit(seed), F.lit("shard"), s, key).alias("w"), s.alias("s")),
    )
    return F.array_max(weights)["s"]


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's texts and nested values."""
    size = F.lit(0)
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            size += F.coalesce(F.octet_length(F.to_json(value)), F.lit(0))
        elif isinstance(field.dataType, (StringType, BinaryType)):
            size += F.coalesce(F.octet_length(value), F.lit(0))
    return size


def shard(
    df: DataFrame, key: str = "doc_id", size: Column | None = None, shards: int = SHARDS, seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Each row of ``df`` as struct ``row``, with its ``key``, ``shard`` and ``slot`` (0, 1, … inside the shard).

    ``size`` is a row's bytes, from which the number of buckets follows; by default those of its own columns.
    """
    spark = df.sparkSession
    size = row_bytes(df) if size is None else F.coalesce(size, F.lit(0))
    names = [f"c{i}" for i in range(len(df.columns))]
    row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)])
    keyed = df.select(F.col(f"`{key}`").alias("key"), row.alias("row"), (size.cast("bigint") + ROW_BYTES).alias("size"))
    keyed = keyed.withColumn("shard", shard_of(F.col("key"), shards, seed))
    content = F.xxhash64(F.lit(seed), F.lit("bucket"), "key", "row")
    # One number a shard.
    per_shard = {r.shard: max(1, -(-r.size // bucket_bytes)) for r in keyed.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    placed = keyed.withColumn("content", content).withColumn("salt", F.lit(0).cast("bigint"))
    if max(per_shard.values(), default=1) > 1:
        # Each takes a quarter of a bucket or more: at most four rows for each bucket, a bounded broadcast.
        heavy = placed.groupBy("content").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where(
            (F.col("size") > bucket_bytes // 4) & (F.col("n") > 1)
        )
        heavy = stored(heavy.select("content", F.lit(True).alias("heavy")), "identical")
        placed = placed.withColumn("salt", F.monotonically_increasing_id()).join(F.broadcast(heavy), "content", "left")
        placed = placed.withColumn("salt", F.when(F.col("heavy"), F.col("salt")).otherwise(0))
    counts = F.create_map(*[F.lit(x) for pair in per_shard.items() for x in pair]) if per_shard else F.create_map(F.lit(0), F.lit(1))
    scattered = placed.select(
        "key", "row", "shard", F.pmod(F.xxhash64("content", "salt"), counts[F.col("shard")]).cast("int").alias("bucket")
    )
    # Pass one. The written table is the external half: pass two, and any task run again, starts from it.
    path = scratch_path(spark, "scattered")
    scattered.write.parquet(path)
    scattered = spark.read.schema(scattered.schema).parquet(path)
    # One row per bucket; a bucket's first slot is what lies before it in its shard.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket, of known size: Catalyst broadcasts it below its limit.
    starts = stored(
        scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")),
        "bucket-starts",
    )
    # Pass two, one bucket a task. ``shuffle`` draws from the seed and the task's number, which is the bucket's; sorted by
    # key first, the permutation depends on the seed, the rows and nothing else.
    firsts, n_buckets = {}, 0
    for one in sorted(per_shard):
        firsts[one], n_buckets = n_buckets, n_buckets + per_shard[one]
    offsets = F.create_map(*[F.lit(x) for pair in (firsts or {0: 0}).items() for x in pair])
    buckets = (
        scattered.withColumn("number", offsets[F.col("shard")] + F.col("bucket"))
        .repartitionById(n_buckets or 1, F.col("number"))
        .groupBy("number", "shard", "bucket")
        .agg(F.sort_array(F.collect_list(F.struct("key", "row"))).alias("rows"))
        .sortWithinPartitions("shard", "bucket")
        .withColumn("rows", F.shuffle("rows", seed))
        .join(starts, ["shard", "bucket"])
    )
    return buckets.select("shard", "start", F.posexplode("rows").alias("place", "one")).select(
        F.col("one.key").alias("key"), F.col("one.row").alias("row"), "shard", (F.col("start") + F.col("place")).alias("slot")
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = SHARDS, **more) -> None:
    """The whole rows as Parquet, a folder per shard, each in shuffled order."""
    size = F.octet_length(text_or_empty(f"`{text}`")) + F.lit(1)
    dealt = shard(df, key, size, shards, **more)
    names = [f"c{i}" for i in range(len(df.columns))]
    (
        dealt.select(
            *[F.col(f"row.{n}").alias(c) for c, n in zip(df.columns, names, strict=True)],
            F.col("slot").alias("_slot"), F.col("shard").alias("_shard"),
        )
        .repartitionByRange("_shard", "_slot")
        .sortWithinPartitions("_shard", "_slot")
        .write.partitionBy("_shard").parquet(path)
    )
