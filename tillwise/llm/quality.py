"""Quality rules as a bitmask ledger.

``ledger`` measures each text once and evaluates every rule once; a rule that
fails sets its bit. What a document's fate is, is then a matter of a policy: a
mask of the rules that count. Policies carry a version, so an old decision can
be repeated from the stored ledger without reading a text again, and
``ablations`` tells from the bits alone what each rule costs.

Texts: a null text has no words. Measurements are exact for texts of any
length. Repeated rows each get a row. Extra columns stay out of the ledger;
``filter_documents`` hands them through untouched whatever their names.
An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` never changes once ledgers with it are stored."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("capitals", 4, "2 * n_capitals > word_chars"),
    Rule("short_words", 5, "word_chars < 2 * n_words"),
    Rule("long_words", 6, "word_chars > 20 * n_words"),
)

BASE = ("few_words", "repeated_windows")
# Each version lists the rules that reject; a version is never edited, a new one is added.
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "duplicate_lines", "capitals"),
    3: (*BASE, "symbols", "duplicate_lines", "capitals", "short_words", "long_words"),
}
CURRENT = 3


def mask(rules) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in set(rules))


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the key, the measurements, ``failed`` (bit r is set if rule r fails)."""
    whole = text_or_empty(text)
    split = (
        df.select(F.col(key).alias("_key"), whole.alias("_text"))
        .withColumn("_words", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        .select(
            "_key",
            "_words",
            F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
            F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
            # Most texts have no symbol at all; looking is cheaper than counting.
            F.when(
                F.col("_text").rlike("[#*$%&|<>]"),
                F.length("_text") - F.length(F.translate("_text", SYMBOLS, "")),
            ).otherwise(F.lit(0)).cast("bigint").alias("n_symbols"),
            (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("bigint").alias("n_capitals"),
        )
    )
    n = F.size("_words")
    # A window's name: its hash with the low bits replaced by its place, so that sorting plain longs brings equal
    # windows together. As few bits as the text's length needs; equal words are checked again below.
    place_bits = F.lit(32) - F.floor(F.lit(31) - F.log2(n + F.lit(1))).cast("int")
    split = split.withColumn("_bits", place_bits)
    windows = split.select(
        "*",
        n.cast("bigint").alias("n_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(
            n >= WINDOW,
            F.transform(
                F.slice("_words", F.lit(1), n - (WINDOW - 1)),
                lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, WINDOW)]),
            ),
        ).alias("_windows"),
    ).drop("_lines")
    repeats = windows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(
                F.transform(
                    "_windows",
                    lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("bigint")),
                )
            ),
        ),
    ).drop("_windows")
    low = (F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bits")) - 1).cast("bigint")
    place = lambda x: x.bitwiseAND(low).cast("int")
    name = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    same = lambda a, b: (name(a) == name(b)) & (
        F.slice("_words", place(a) + 1, WINDOW) == F.slice("_words", place(b) + 1, WINDOW)
    )
    measured = (
        repeats.withColumn(
            "_places",
            F.sort_array(
                F.transform(
                    F.filter(
                        "_sorted",
                        lambda x, r: same(x, F.get("_sorted", r + 1)) | same(x, F.get("_sorted", r - 1)),
                    ),
                    place,
                )
            ),
        )
        .select(
            F.col("_key").alias(key),
            "n_words",
            "n_lines",
            "word_chars",
            "n_symbols",
            "n_capitals",
            "n_dup_lines",
            # Each repeated window covers five words, less where the next one starts earlier.
            F.coalesce(
                F.aggregate(
                    F.transform(
                        "_places",
                        lambda p, r: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", r + 1) - p, F.lit(WINDOW))),
                    ),
                    F.lit(0).cast("bigint"),
                    lambda total, more: total + more,
                ),
                F.lit(0).cast("bigint"),
            ).alias("n_repeat_words"),
        )
    )
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("bigint"))


def apply_policy(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy, from the bits alone."""
    hit = lambda rules: F.col("failed").bitwiseAND(F.lit(mask(rules)).cast("bigint")) != 0
    return book.withColumns({"base_failed": hit(BASE), "kept": ~hit((*BASE, *POLICIES[version]))})


def ablations(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that fail nothing else (would return without it).

    One pass and one small row per task: equal bit patterns are counted first, of which there are at most 2^rules.
    """
    whole = mask(POLICIES[version])
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("bigint")).alias("bits")).agg(
        F.count("*").alias("n")
    )
    used = [r for r in RULES if r.name in POLICIES[version]]
    counted = patterns.agg(
        *[F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << r.bit).cast("bigint")) != 0, F.col("n"))),
                     F.lit(0)).alias(f"f_{r.name}") for r in used],
        *[F.coalesce(F.sum(F.when(F.col("bits") == (1 << r.bit), F.col("n"))), F.lit(0)).alias(f"o_{r.name}")
          for r in used],
    )
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(version).alias("version"),
                        F.lit(r.name).alias("rule"),
                        F.col(f"f_{r.name}").alias("n_failed"),
                        F.col(f"o_{r.name}").alias("n_only"),
                    )
                    for r in used
                ]
            )
        )
    )


def filter_documents(df: DataFrame, version: int = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``df`` that a policy keeps, all columns as they were. No shuffle: the ledger is made in the row."""
    names = [f"c{i}" for i in range(len(df.columns))]
    packed = df.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)]).alias("row"),
                       F.col(f"`{text}`").alias("text"))
    judged = apply_policy(ledger(packed, "row", "text"), version)
    # Not a plain filter: that would be pushed below the measurements, and every rule would measure the text again.
    return judged.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select(
        *[F.col(f"row.{n}").alias(c) for c, n in zip(df.columns, names, strict=True)]
    )
