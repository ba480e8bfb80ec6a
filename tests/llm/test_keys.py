"""Rows without a key, with repeated keys and with repeated content, by value."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillwise.llm import exact, mixing, sharding, substrings

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def keyless():
    """A third of the rows has no key, some keys repeat, and some rows repeat whole."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        text = rng.choice(["a b", "ab", "a  b", "ab ", f"text {i % 50}", f"t ext{i % 50}", None, " "])
        rows.append((None if i % 3 == 0 else i % 200, text, rng.choice("abc")))
    return rows


def squeezed(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_exactly_one_row_of_a_group_is_kept(spark, keyless, support):
    df = spark.createDataFrame(keyless, SCHEMA).repartition(5)
    got = exact.copies(df, support=support).collect()
    groups = defaultdict(list)
    for key, text, _ in keyless:
        groups[hashlib.sha256(squeezed(text).encode()).hexdigest()].append((key, text or ""))
    best = {d: min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0] for d, g in groups.items()}
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(
        (key, best[d], len(g), d) for d, g in groups.items() for key, _ in g
    )
    kept = [r for r in got if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter(groups.keys()) and all(r.doc_id == r.keep_id for r in kept)
    left = exact.drop_copies(df, support=support).collect()
    assert Counter((r.doc_id, squeezed(r.text)) for r in left) == Counter((best[d], squeezed(g[0][1])) for d, g in groups.items())


def plain_poisson(name, rate, seed=mixing.SEED):
    n, parts = 0, max(1, math.ceil(rate / mixing.PART))
    for part in range(1, parts + 1):
        digest = hashlib.md5(f"{seed}|poisson|{part}|{name}".encode()).hexdigest()
        u, mean = int(digest[:13], 16) / 2**52, rate / parts
        p = below = math.exp(-mean)
        k = 0
        while below <= u and k < mixing.SEARCH:
            k += 1
            p *= mean / k
            below += p
        n += k
    return n


@pytest.mark.parametrize("targets", [None, {"a": 0.6, "b": 0.4}, {"c": 1.0, "nowhere": 1.0}])
def test_mixing_equals_plain_poisson_also_without_keys_and_with_targets(spark, targets):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else i, "w " * rng.randint(0, 30) + str(i), rng.choice("aabc") if i % 7 else None) for i in range(1500)]
    sizes, total = Counter(), 0
    for _, text, source in rows:
        sizes[source] += len(text.encode()) + 1
        total += len(text.encode()) + 1
    weights = {s: targets.get(s, 0.0) if targets else n**mixing.TEMPERATURE for s, n in sizes.items()}
    rates = {s: round(w / sum(weights.values()) * (total / sizes[s]), 6) for s, w in weights.items()}
    expected = Counter()
    for key, text, source in rows:
        name = str(key) if key is not None else "text:" + hashlib.md5(text.encode()).hexdigest()
        for copy in range(plain_poisson(name, rates[source])):
            expected[(key, text, source, copy)] += 1
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, targets).collect()
    assert Counter((r.doc_id, r.text, r.source, r.copy_no) for r in got) == expected
    # Rows without a key are drawn one by one: each source meets its target, with them and without.
    for source, share in (targets or {}).items():
        if source in sizes:
            drawn = sum(len(t.encode()) + 1 for _, t, s, _ in expected.elements() if s == source)
            assert abs(drawn / total - share / sum(weights.values())) < 0.12


def test_copies_of_rows_without_keys_spread(spark):
    df = spark.range(6000).select(
        F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("s").alias("source")
    )
    parts = mixing.mix(df).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in parts) < 3 * sum(r["count"] for r in parts) / len(parts)


def test_slots_do_not_depend_on_the_number_of_partitions(spark, keyless):
    rows = list({(k, t, s) for k, t, s in keyless}) + [(k, f"more {k}", "d") for k in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for partitions in ("5", "8", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            out = sharding.shard(df.repartition(int(partitions)), bucket_bytes=4_000)
            seen.append(sorted(((r.shard, r.slot, r.key, r.row.c1, r.row.c2) for r in out.collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
    per_shard = defaultdict(list)
    for shard, slot, *_ in seen[0]:
        per_shard[shard].append(slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in per_shard.values())


def test_texts_without_keys_lose_only_their_own_bytes(spark):
    """Half the keyless texts hold a passage of a keyed one. 31 bits of a hash would not tell this many texts apart."""
    passage = "".join(f"{i:03d}" for i in range(100, 130))
    rows = [(1, passage, "s")] + [(None, f"{i:09d}" + (passage if i % 2 else "x" * 90), "s") for i in range(2_000)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    lost = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in got)
    assert lost == Counter({(1, 90, 0): 1, (None, 99, 90): 1000, (None, 99, 0): 1000})
    # Equal 31-bit parts: the hash as a whole still differs.
    assert spark.range(3).select(substrings._tag(F.col("id").cast("string")).alias("t")).distinct().count() == 3
