"""Left equi-joins of a large fact table to a keyed table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.operators.ordering import stored

# A key is hot when it holds more than 1/HOT_SHARE of all fact rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
# Counters of the frequent-items sketch: its counts are off by at most a few ten-thousandths of the rows.
TRACKED = 16_384
# Hot keys found before, by session, table and key: a handful of rows each.
_KNOWN: dict[tuple, list[tuple]] = {}


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimised plan; None where it cannot be asked (Spark Connect)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - the estimate only selects between two correct plans
        return None


def bytes_of(text: str) -> int:
    """Bytes of a size setting such as ``10485760``, ``10485760b`` or ``10MB``."""
    text = text.strip().lower().removesuffix("b")
    factor = {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}.get(text[-1:], 1)
    return int(text if factor == 1 else text[:-1]) * factor


def broadcast_limit(df: DataFrame) -> int:
    return bytes_of(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760"))


def lookup_join(
    facts: DataFrame,
    keyed: DataFrame,
    key: str | list[str],
    scan: DataFrame | None = None,
    seed: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``facts LEFT JOIN keyed USING (key)``, whatever the size of ``keyed`` and however hot a key is.

    A small ``keyed`` (by Spark's own size check) is left to Catalyst, which
    broadcasts it: the facts are not shuffled and skew does not matter. A large
    one would be shuffled by key, and one task would receive every row of a hot
    key; there the hot keys are spread over as many salts as their share of the
    facts calls for, and only *their* lookup rows are repeated. All other rows
    keep salt 0. Both plans return the same rows.

    ``scan`` is a table with the fact keys that is cheap to read twice (the
    facts themselves, or what they were projected from). Without one the facts
    are taken for a computed, reduced result and are written down first.
    ``seed`` names a column that numbers the fact rows as the scan read them.
    ``limit`` replaces Spark's own broadcast limit as the size from which on hot keys are salted.
    """
    keys = [key] if isinstance(key, str) else list(key)
    size = estimated_bytes(keyed)
    if size is not None and size <= (broadcast_limit(facts) if limit is None else limit):
        return facts.join(keyed, keys, "left")
    if scan is None:
        facts = scan = stored(facts, "facts")
    return _salted_left_join(facts, keyed, keys, hot_keys(scan, keys), seed)


def _salted_left_join(
    facts: DataFrame, keyed: DataFrame, keys: list[str], hot: DataFrame, seed: str | None = None
) -> DataFrame:
    hot = F.broadcast(hot)  # fewer than HOT_SHARE rows, see hot_keys
    seeded = facts.withColumn("_row", F.col(seed) if seed else _row_number(facts))
    salted = (
        seeded.join(hot, keys, "left")
        .withColumn(
            "_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_row"), "_salts")).cast("int")
        )
        .drop("_salts", "_row")
    )
    repeated = (
        keyed.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted.join(repeated, [*keys, "_salt"], "left").drop("_salt")


def _row_number(facts: DataFrame) -> Column:
    """Something to salt a row by that a retried task works out again.

    Straight from a scan that is the row's position in its split, so copies of
    one row are told apart. Behind a shuffle rows may come in another order the
    next time, so there it is the row's content.
    """
    plan = facts._jdf.queryExecution().executedPlan().toString()
    if re.search(r"(?<!Broadcast)Exchange", plan):
        return F.xxhash64(*facts.columns)
    return F.monotonically_increasing_id()


def hot_keys(scan: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys with more than 1/share of the rows, and the salts that cut each down to about that share.

    One pass over the key columns: a mergeable frequent-items sketch, of which
    each task sends one. Which keys are salted decides how the work is spread,
    never what comes out, so what was found for a table and key is used again by
    later lookups. The shares add up to one, so there are fewer than ``share`` rows.
    """
    spark = scan.sparkSession
    name = (spark.sparkContext.applicationId, scan.select(*keys).semanticHash(), tuple(keys), share)
    if name not in _KNOWN:
        _KNOWN[name] = _frequent(scan, keys, share)
    kinds = {f.name: f.dataType.simpleString() for f in scan.select(*keys).schema.fields}
    # The sketch knows one column; several keys are one text, read back as they were.
    record = F.from_json("_key", ", ".join(f"`{k}` {kinds[k]}" for k in keys))
    rows = spark.createDataFrame(_KNOWN[name], "_key string, _salts int")
    return rows.withColumn("_key", record).select("_key.*", "_salts")


def _frequent(scan: DataFrame, keys: list[str], share: int) -> list[tuple]:
    filled = scan.select(*keys).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    named = filled.select(F.to_json(F.struct(*keys)).alias("_key"))
    top = named.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(_key, {share}, {TRACKED})").alias("top")).first()
    return [(item["item"], -(-item["count"] * share // top.n)) for item in top.top or [] if item["count"] * share > top.n]
