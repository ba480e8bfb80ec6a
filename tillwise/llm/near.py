"""Near-duplicate detection by circulant MinHash.

A document's set is its distinct 2-word shingles (or 5-word, by parameter).
One permutation scatters the shingles over 2^32 places; a second one, shifted
by k places, gives coordinate k of the signature: its least value over the set.
Two fixed permutations thus stand for any number of independent ones. Bands of
coordinates that agree make two documents candidates; candidates are confirmed
on their full sets.

Groups of copies never become pairs of copies:

*   Equal sets form a class at once; only one of each class goes on.
*   In a bucket (documents that agree in a band) only the pairs with one of its
    documents, the head, are confirmed: as many as the bucket has members.
    Confirmed links are joined into components, and a bucket whose members are
    all in one component is done. The others take further heads, ``HEADS`` times,
    which are compared with the members outside their own component only.
*   The members of buckets that still hold several components go through an exact
    prefix filter. Shingles that only one component has cannot link it to another
    one; the rest are ordered by how many of these members have them. Two sets
    that are linked must share a shingle among the first of the smaller set's (a
    ninth of it, for 80 percent) and the first of the larger one's (a fifth), at
    places that leave enough behind them. What a whole group shares comes last in
    that order, so a common template is no common key. Only pairs that share such
    a shingle are confirmed; no pair is left out that could be linked.

32 bands of 5 coordinates miss a pair at similarity 0.8 with probability
3 * 10^-6, and closer pairs less often.

Null and empty texts and texts without a word have an empty set and link with
nothing. A text of fewer words than a shingle is one shingle. A document is a
key with a text: rows that repeat both are one document, and different texts
under one key, or under none, are documents of their own. The smallest document
is thus the one with the smallest pair of key and digest of the text; null keys
count as the largest. Inside, classes go by numbers of eight bytes. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import Scratch, free_name, shuffles_cleaned, stored

BANDS, ROWS = 32, 5
# Further heads of buckets with several components, before the prefix filter. Any number gives the same result.
HEADS = 1
# Links need 100 * intersection >= 80 * union.
PERCENT = 80
SEED = 77
# The first bytes of a document's identity where it has no key: after all keys.
NO_KEY = b"\xff" + bytes(8)
U = np.uint64
U32 = np.uint32
# Text bytes hashed at a time.
BLOCK_BYTES = 2 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _tables(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U)


def shingle_sets(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text. ``data``: UTF-8 bytes of texts lying in a row."""
    n = len(sizes)
    if not len(data):
        return [np.zeros(0, U)] * n
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    text = np.repeat(np.arange(n), sizes)
    opens = word.copy()
    opens[1:] &= ~word[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(opens)
    if not len(first):
        return [np.zeros(0, U)] * n
    # A word's hash: its bytes' random numbers, each weighed by its place in the word.
    at = np.flatnonzero(word)
    of = np.cumsum(opens)[at] - 1
    place = at - first[of]
    power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15 | 1, dtype=U))
    begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    h = _mix(np.add.reduceat(_tables(SEED)[lower[at]] * power[place], begins))
    owner = text[first]
    count = np.bincount(owner, minlength=n)
    ends = np.cumsum(count)
    out = []
    for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
        words = h[a:b]
        if len(words) == 0:
            out.append(words)
            continue
        k = min(width, len(words))
        grams = words[: len(words) - k + 1]
        for i in range(1, k):
            grams = _mix(grams * U(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
        # A short text's only shingle must not equal a real one.
        out.append(np.unique(grams if k == width else _mix(grams + U(k))))
    return out


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: ``min over s of pi(sigma(s) - k)`` for k = 1, 2, …, both permutations of 2^32 places."""
    # sigma: the shingle's scattered place. (The hash is scattered already; its upper half is the place.)
    sigma = (shingles >> U(32)).astype(U32)
    shift = np.arange(1, coordinates + 1, dtype=U32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, dtype=U32)
    for a in range(0, len(sigma), 2048):
        x = sigma[None, a : a + 2048] - shift
        # pi: odd multiplications and shifted exclusive-ors are one to one on 32 bits.
        x *= U32(0x7FEB352D)
        x ^= x >> U32(15)
        x *= U32(0x846CA68B)
        x ^= x >> U32(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def _sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(
            pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64
        )
        cuts = np.unique(np.searchsorted(ends, np.arange(BLOCK_BYTES, max(int(ends[-1]), 1), BLOCK_BYTES)) + 1)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if a < b:
                part = batch.slice(a, b - a)
                yield part, *raw(part.column(column))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and each value's start and size; nulls are empty."""
    text = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], np.diff(offsets)


def sketches(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``key``, ``n`` (set size), ``digest`` (128 bits of the whole set, null if empty), ``bands``. One pass, no shuffle."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part, data, starts, sizes in _sliced(batches, "text"):
            sets = shingle_sets(data, starts, sizes, width)
            digests, bands = [], []
            for s in sets:
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig = signature(s).reshape(BANDS, ROWS) if len(s) else np.zeros((0, ROWS), U32)
                h = np.arange(len(sig), dtype=U)
                for c in range(ROWS):
                    h = _mix(h * U(0x9E3779B97F4A7C15) + sig[:, c])
                bands.append(h.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands))),
                ],
                ["key", "n", "digest", "bands"],
            )

    return _texts(df, key, text).mapInArrow(sketched, "key binary, n bigint, digest binary, bands array<bigint>")


def _identity(key: str, text: str) -> Column:
    """A document's identity: bytes that order like the key (nulls last), then the MD5 of the text."""
    number = F.col(f"`{key}`").cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
    ordered = F.coalesce(F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(number), 16, "0"))), F.lit(NO_KEY))
    return F.concat(ordered, F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))


def _key_of(identity: Column) -> Column:
    number = F.conv(F.hex(F.substring(identity, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(Decimal(1 << 63))
    return F.when(F.substring(identity, 1, 1) == F.lit(b"\x00"), number.cast("bigint"))


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(_identity(key, text).alias("key"), F.col(f"`{text}`").alias("text"))


def confirm(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``a``, ``b``, ``common`` (size of the intersection of their full sets) for each pair.

    ``b``'s text travels once a pair; ``a`` may be in many pairs, which the adaptive join splits. Pairs that follow one
    another with the same ``a`` use its set again.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for part, data, starts, sizes in _sliced(batches, "text_b"):
            sets = shingle_sets(data, starts, sizes, width)
            keys, left = part.column("a").to_pylist(), part.column("text_a")
            common = []
            for i, s in enumerate(sets):
                if keys[i] != last:
                    one = raw(left.slice(i, 1))
                    last, last_set = keys[i], shingle_sets(*one, width)[0]
                if len(last_set) and len(s):
                    at = np.minimum(np.searchsorted(last_set, s), len(last_set) - 1)
                    common.append(int(np.count_nonzero(last_set[at] == s)))
                else:
                    common.append(0)
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(common, pa.int64())], ["a", "b", "common"]
            )

    joined = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(measured, "a bigint, b bigint, common bigint")


def shingles(texts: DataFrame, width: int) -> DataFrame:
    """``id``, ``shingle``: one row for each member of each set."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, starts, sizes in _sliced(batches, "text"):
            ids = part.column("id").to_numpy()
            for i, s in enumerate(shingle_sets(data, starts, sizes, width)):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ids[i])), pa.array(s.view(np.int64))], ["id", "shingle"])

    return texts.select("id", "text").mapInArrow(listed, "id bigint, shingle bigint")


def linked(n_a: Column, n_b: Column, common: Column, percent: int = PERCENT) -> Column:
    return 100 * common >= percent * (n_a + n_b - common)


def _possible(n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether the sizes permit a link."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id``, ``component`` (the smallest number reachable) for every number in ``edges`` (``a``, ``b``).

    Every node takes the smallest label around it, then its label's label, until nothing changes: the number of rounds
    grows with the logarithm of the longest chain. The labels at the nodes stay in written tables.
    """
    both = scratch.table(
        edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "edges",
    )
    labels = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")), "labels")
    while True:
        around = both.join(labels.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(
            F.min("cb").alias("cb")
        )
        pulled = labels.join(around, "a").select("a", "c", F.least("c", "cb").alias("d"))
        # A label's own label: one lookup by the label, of which a large component has one that everybody asks for.
        jump = labels.select(F.col("a").alias("d"), F.col("c").alias("up"))
        stepped = scratch.table(
            pulled.join(jump, "d", "left").select("a", F.least("d", F.coalesce("up", "d")).alias("d"), "c"), "labels"
        )
        labels = stepped.select("a", F.col("d").alias("c"))
        if stepped.where("c <> d").isEmpty():
            return labels.toDF("id", "component")


def merged(found: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``found`` (``id``, ``component``) after more links: only the components that they join are worked on."""
    of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = components(
        ends.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")), scratch
    ).toDF("component", "to")
    # Numbers that had no link before are components of their own.
    known = found.join(joined, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    new = joined.toDF("id", "component").join(found, "id", "left_anti")
    return scratch.table(known.unionAll(new), "components")


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_shingles``, ``class_id`` (smallest key with the same set), ``component_id``, ``kept``."""
    return judged(df, key, text, width, percent).select(
        _key_of(F.col("key")).alias(key),
        F.col("n").alias("n_shingles"),
        _key_of(F.col("class")).alias("class_id"),
        _key_of(F.col("component")).alias("component_id"),
        (F.col("component") == F.col("key")).alias("kept"),
    )


def judged(df: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``key``, ``n``, ``class``, ``component`` of each row; all but ``n`` are identities, and ``component`` is who stays."""
    spark = df.sparkSession
    whole = stored(sketches(df, key, text, width), "sketches")
    with Scratch(spark) as scratch, shuffles_cleaned(spark):
        # One row a class; its number is whatever the written table says.
        reps = scratch.table(
            whole.where("digest IS NOT NULL").groupBy("digest")
            .agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"))
            .withColumn("id", F.monotonically_increasing_id()),
            "classes",
        )
        found = _components_of(_texts(df, key, text), reps, width, percent, scratch)
        placed = reps.select("id", "digest", "key").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        stays = placed.groupBy("component").agg(F.min("key").alias("stays"))
        named = stored(
            placed.join(stays, "component").select("digest", F.col("key").alias("class"), F.col("stays").alias("component")), "named"
        )
    return whole.select("key", "n", "digest").join(named, "digest", "left").select(
        "key", "n", F.coalesce("class", "key").alias("class"), F.coalesce("component", "key").alias("component")
    )


def _components_of(texts: DataFrame, reps: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """``id``, ``component`` of every class that has a link."""
    members = reps.select("id", "n", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("size")).where("size > 1")
    in_buckets = scratch.table(
        members.join(heads, "bucket").select("bucket", "id", "n", F.col("head.id").alias("head"), F.col("head.n").alias("head_n")),
        "buckets",
    )
    needed = reps.select("key", "id").join(in_buckets.select("id").distinct(), "id")
    kept_texts = scratch.table(
        texts.join(needed, "key").groupBy("id").agg(F.max("text").alias("text")), "candidates"
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (``a``, ``b``, ``n_a``, ``n_b``) that are links."""
        sizes = scratch.table(pairs.distinct(), "pairs")
        overlaps = confirm(sizes.select("a", "b"), kept_texts, width)
        return scratch.table(
            sizes.join(overlaps, ["a", "b"]).where(linked(F.col("n_a"), F.col("n_b"), F.col("common"), percent)).select("a", "b"),
            "links",
        )

    star = in_buckets.where("id <> head").where(_possible(F.col("n"), F.col("head_n"), percent))
    found = components(
        confirmed(star.select(F.col("head").alias("a"), F.col("id").alias("b"), F.col("head_n").alias("n_a"), F.col("n").alias("n_b"))),
        scratch,
    )
    open_ = in_buckets.select("bucket", "id", "n")
    for turn in range(HEADS):
        placed = open_.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = placed.groupBy("bucket").agg(
            F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id", "n", "component")).alias("head"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        ).where("low < high").select("bucket", "head")
        open_ = scratch.table(placed.join(mixed, "bucket"), "open")
        if open_.isEmpty():
            return found
        others = open_.where("component <> head.component").where(_possible(F.col("n"), F.col("head.n"), percent))
        pairs = others.select(F.col("head.id").alias("a"), F.col("id").alias("b"), F.col("head.n").alias("n_a"), F.col("n").alias("n_b"))
        found = merged(found, confirmed(pairs), scratch)
        open_ = open_.select("bucket", "id", "n")
    last = scratch.table(_by_prefix(open_, found, kept_texts, width, percent, scratch), "by-prefix")
    return found if last.isEmpty() else merged(found, confirmed(last), scratch)


def _by_prefix(open_: DataFrame, found: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Every pair of different components of a bucket that may be linked: ``a``, ``b``, ``n_a``, ``n_b``."""
    placed = open_.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    members = scratch.table(placed.join(mixed.select("bucket"), "bucket", "left_semi").select("id", "n", "component").distinct(), "open-members")
    held = scratch.table(shingles(texts.join(members.select("id"), "id", "left_semi"), width).join(members, "id"), "shingles")
    # Shingles of one component cannot link it with another; the others, rarest first.
    shared = held.groupBy("shingle").agg(
        F.count("*").alias("times"), F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low < high").select("shingle", "times")
    # A document's own shingles: no more than it has words.
    mine = Window.partitionBy("id")
    ranked = held.join(shared, "shingle").withColumn(
        "place", F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("times", "shingle"))
    )
    # Of two linked sets the larger one shares at least ``percent`` of its own shingles, the smaller one that much of both.
    least = lambda n, of: -F.floor(-(n * percent) / F.lit(of))
    longer = scratch.table(
        ranked.where(F.col("place") <= F.col("n") - least(F.col("n"), 100) + 1).select("shingle", "id", "n", "component", "place"),
        "prefixes",
    )
    shorter = longer.where(F.col("place") <= F.col("n") - least(2 * F.col("n"), 100 + percent) + 1)
    x, y = shorter.alias("x"), longer.alias("y")
    n_x, n_y = F.col("x.n"), F.col("y.n")
    behind = F.least(n_x - F.col("x.place"), n_y - F.col("y.place")) + 1
    pairs = x.join(
        y,
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.component") != F.col("y.component"))
        & ((n_x < n_y) | (n_x == n_y) & (F.col("x.id") < F.col("y.id")))
        & _possible(n_x, n_y, percent)
        & (behind * (100 + percent) >= percent * (n_x + n_y)),
    )
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), n_x.alias("n_a"), n_y.alias("n_b")).distinct()


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``df`` without the documents whose component has a smaller one, columns as they were."""
    others = judged(df, key, text, width, percent).where("component <> key").select("key").distinct()
    gone = free_name(df, "_gone")
    dropped = stored(others, "near-duplicates").toDF(gone)
    return df.join(dropped, _identity(key, text) == F.col(gone), "left_anti")
