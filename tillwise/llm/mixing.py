"""Mixing sources to target weights by Poisson replication.

Each source has a rate: its target share of the mixture over its share of the
corpus, so the mean number of copies of a document of that source. A document's
number of copies is drawn from the Poisson distribution with that mean, by
inverting its distribution function at a uniform number hashed from seed and
key (of a row without a key, from its text); a fraction is thus met on average by every document, without rounding, and
any task works out the same number again. Copies are then dealt to partitions
and ordered by another hash: a global shuffle.

Sizes are UTF-8 bytes plus one. A null source is a source of its own. A null
text has size one. Without explicit targets a source's share is its size to the
power ``temperature``. A source without a target, where targets are given, has
rate 0. Rows that repeat a key, or without one a text, draw the same number. An empty table gives an empty
result. All columns of the input are handed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import free_name, hash_int, stored, text_or_empty

TEMPERATURE = 0.7
SEED = 20_240
# A rate above this is drawn in parts, so that exp(-rate) keeps its precision and the search stays short.
PART = 16.0
# Beyond 16 + 64 the distribution function of a part differs from 1 by less than 2^-52.
SEARCH = 80


def source_rates(
    df: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE,
    source: str = "source", text: str = "text",
) -> DataFrame:
    """One row per source: ``source``, ``n_docs``, ``size``, ``rate`` (mean copies that keep the whole as large as it is)."""
    sizes = df.groupBy(F.col(f"`{source}`").alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum(F.octet_length(text_or_empty(f"`{text}`")) + F.lit(1)).alias("size")
    )
    if targets is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, share in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(weight)
    sizes = stored(sizes.withColumn("weight", weight), "source-sizes")
    totals = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # One row of totals: as a scalar subquery it needs no join.
    rate = (F.col("weight") / totals.select("all_weight").scalar()) * (
        totals.select("all_size").scalar().cast("double") / F.col("size")
    )
    # Six digits, so that the order in which a total was added up cannot show.
    return sizes.select("source", "n_docs", "size", F.coalesce(F.round(rate, 6), F.lit(0.0)).alias("rate"))


def poisson(rate: Column, *key: Column, seed: int = SEED) -> Column:
    """A Poisson number with mean ``rate``, the same for the same key and seed."""
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")

    def draw(part: Column) -> Column:
        u = hash_int(F.lit(seed), F.lit("poisson"), part, *key) / F.lit(float(1 << 52))
        mean = rate / parts
        first = F.struct(
            F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).alias("n")
        )
        # p is the probability of k, below that of k or less; n counts how many k have it at most u.
        step = lambda s, k: F.struct(
            k.alias("k"),
            (s["p"] * mean / k).alias("p"),
            (s["below"] + s["p"] * mean / k).alias("below"),
            (s["n"] + F.when(s["below"] <= u, 1).otherwise(0)).alias("n"),
        )
        # Most draws end at once; only the others walk the table, as far as their rate makes likely.
        reach = F.least(F.lit(SEARCH), F.ceil(mean * 3).cast("int") + 24)
        walked = F.aggregate(F.sequence(F.lit(1), reach), first, step)["n"]
        return F.when(u < F.exp(-mean), 0).otherwise(walked)

    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), draw), F.lit(0), lambda a, b: a + b)


def mix(
    df: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED,
    key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """``df`` with each row as often as drawn, in random order, and ``copy_no`` (from 0), ``n_copies``, ``rate`` beside it."""
    copy_no, n_copies, rate, joined = (free_name(df, n) for n in ("copy_no", "n_copies", "rate", "_source"))
    rates = source_rates(df, targets, temperature, source, text).select(
        F.col("source").alias(joined), F.col("rate").alias(rate)
    )
    # A row per source, written and so of known size: Catalyst broadcasts it below its limit. Beyond it, the join
    # shuffles, and a source with a third of the rows is split by the adaptive skew join.
    rated = df.join(stored(rates, "source-rates"), F.col(f"`{source}`").eqNullSafe(F.col(joined)), "left").drop(joined)
    # Rows without a key are told apart by their texts, or all of them would be drawn, or not, together.
    named = F.coalesce(F.col(f"`{key}`").cast("string"), F.concat(F.lit("text:"), F.md5(text_or_empty(f"`{text}`"))))
    counted = rated.withColumn(n_copies, poisson(F.coalesce(F.col(rate), F.lit(0.0)), named, seed=seed))
    copies = counted.where(F.col(n_copies) > 0).withColumn(
        copy_no, F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1))
    )
    # The text counts too: rows that repeat a key spread over all partitions.
    order = hash_int(F.lit(seed), F.lit("order"), named, F.xxhash64(F.col(f"`{text}`")), F.col(copy_no))
    place = free_name(copies, "_place")
    return (
        copies.withColumn(place, order)
        .repartition(F.col(place))
        .sortWithinPartitions(F.xxhash64(F.col(place)))
        .drop(place)
    )
