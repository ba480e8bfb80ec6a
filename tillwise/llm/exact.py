"""Exact dedup with heavy hitters split off.

Texts are equal when their digests are: SHA-256 of the text without white
space. Shuffling by digest sends every copy of a text to one task, so the
frequent digests go another way. Misra-Gries counting (``freqItems``, at most
``1 / support`` counters in each task) names every digest with more than
``support`` of the rows, and perhaps some others. Those candidates, at most
``1 / support``, are broadcast; their rows are counted and their best row is
found by an aggregation that combines in each task first, so that a count is
exact and a candidate that is not frequent does no harm. The winners go back as
a broadcast and remove copies where they are read. All other digests are too
rare to fill a task and take the ordinary shuffle, combined in each task first.

Of equal texts the row with the most code points in its original text stays,
then the one with the smallest key (nulls last), then the one whose original text
has the smallest MD5. A null text is an empty text; all blank texts are equal. A
row repeated whole counts in ``group_size``, and one of the repetitions of the
row that stays is marked kept: exactly one row of each group is. An empty table
gives an empty result. Other columns, whatever their names, stay
out of the decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import BLANKS, stored, text_or_empty

# A digest with more than this share of all rows is certain to be found. A thousandth of the rows is no burden for one
# task, and a thousand rows of 100 bytes are no burden to broadcast.
SUPPORT = 0.001


def digest(text: str = "text") -> Column:
    return F.sha2(F.translate(text_or_empty(text), BLANKS, ""), 256)


def heavy_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Column ``digest``: candidates for the frequent ones, at most ``1 / support`` by construction."""
    return digests.stat.freqItems(["digest"], support).select(
        F.explode("digest_freqItems").alias("digest")
    ).where("digest IS NOT NULL")


def _rank() -> Column:
    """What the row that stays has least of."""
    return F.struct((-F.col("length")).alias("l"), F.col("key").isNull().alias("n"), F.col("key").alias("k"), F.col("raw").alias("raw"))


def _raw(text: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text)))


def copies(df: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``df``: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    # One pass over the texts; what follows reads a hundred bytes a row. Rows get a number in the written table, which
    # tells repetitions of one row apart.
    digests = stored(
        df.select(F.col(f"`{key}`").alias("key"), digest(text).alias("digest"),
                  F.length(text_or_empty(text)).alias("length"), _raw(text).alias("raw"))
        .withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    best = F.min(F.struct(_rank().alias("rank"), F.col("row")))
    winners = _winners(digests, support, best)
    hot = digests.join(F.broadcast(winners), "digest")
    rare = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    cold = rare.join(rare.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")), "digest")
    columns = ["key", "best", "group_size", "digest", "row"]
    return hot.select(*columns).unionAll(cold.select(*columns)).select(
        F.col("key").alias(key),
        F.col("best.rank.k").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _winners(digests: DataFrame, support: float, best: Column) -> DataFrame:
    """``digest``, ``best``, ``group_size`` of each candidate: at most ``1 / support`` rows, exact."""
    candidates = heavy_digests(digests.select("digest"), support)
    return stored(
        digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")),
        "heavy-digests",
    )


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """``df`` with one row of each group of equal texts, columns as they were."""
    names = [f"c{i}" for i in range(len(df.columns))]
    row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)])
    rows = df.select(
        row.alias("row"), F.col(f"`{key}`").alias("key"), digest(text).alias("digest"),
        F.length(text_or_empty(text)).alias("length"), _raw(text).alias("raw"),
    )
    winners = _winners(stored(rows.drop("row"), "digests"), support, F.min(_rank()))
    marked = rows.join(F.broadcast(winners), "digest", "left").where(
        "best IS NULL OR best.k <=> key AND -best.l = length AND best.raw = raw"
    )
    # What is left of a frequent digest: the row that stays, and whole repetitions of it, combined in each task.
    hot = marked.where("best IS NOT NULL").groupBy("digest").agg(F.first("row").alias("row"))
    order = Window.partitionBy("digest").orderBy(F.desc("length"), F.col("key").asc_nulls_last(), "raw")
    cold = (
        marked.where("best IS NULL")
        .withColumn("place", F.row_number().over(order))
        .where("place = 1")
        .select("digest", "row")
    )
    return hot.unionAll(cold).select(
        *[F.col(f"row.{n}").alias(c) for c, n in zip(df.columns, names, strict=True)]
    )
