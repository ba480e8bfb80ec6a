"""Resampling a corpus towards a target distribution by hashed n-gram importance.

Words are runs of letters, digits and everything beyond ASCII, A to Z in lower
case. A document's features are its runs of one to three words, repeats
counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo
``BUCKETS``. Each bucket gains what the target's share of it exceeds the
corpus's share, a document weighs the sum of its features' gains, and adding
Gumbel noise hashed from its key turns "the highest scores" into a draw without
replacement in proportion to the exponentials of the weights.

The checksums come from length-bucketed matrices: the distinct features of a
block of words are laid out, those of equal length together, as the rows of a
two-dimensional ``uint8`` array, and one step updates the checksums of all rows
by one column. The results are scattered back to every occurrence. Features
longer than ``LONGEST`` bytes, of which there are too few to fill a matrix, are
hashed one by one; the numbers are the same.

The text is read once: the first pass writes every document's bucket numbers
(two bytes a feature), from which both the counts of the corpus and, once the
gains are known, the weights are summed. Counts and gains have ``BUCKETS`` rows
at most, whatever the data. The draw is one range sort over all documents.

A null text has no words. A document without words weighs 0 and may only be
drawn if ``least_words`` is 0. A null key hashes as the text ``null`` and comes
last among ties. Rows that repeat are documents of their own; rows that agree in
score and key are told apart by their number of features, and no further. An
empty table gives an empty result, an empty target one with T = 0. Columns
other than key and text are not read. A long text is cut into blocks of words
that overlap, so memory beside the text follows from the block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import stored
from tillwise.operators.ordering import stored_in_order, with_row_number

BUCKETS = 10_000
WIDTH = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
LONGEST = 256
# Words hashed at a time.
BLOCK_WORDS = 1 << 18
# Text bytes taken apart at a time; a longer text is one part of its own.
PART_BYTES = 4 << 20
# Rows of a matrix.
MATRIX_BYTES = 8 << 20


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a ``uint8`` matrix, column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, dtype=np.uint32)
    for column in matrix.T:
        crc = CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return ~crc


def crc_slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start : start + size]`` for every pair, grouped by size."""
    out = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(sizes, kind="stable")
    grouped = sizes[order]
    edges = np.flatnonzero(np.diff(grouped, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        size, rows = int(grouped[a]), order[a:b]
        if size > LONGEST:
            for i in rows.tolist():
                out[i] = zlib.crc32(data[starts[i] : starts[i] + size].tobytes())
            continue
        step = max(1, MATRIX_BYTES // size)
        for c in range(0, len(rows), step):
            part = rows[c : c + step]
            out[part] = crc_rows(np.lib.stride_tricks.sliding_window_view(data, size)[starts[part]])
    return out


def _words(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' words, each followed by a blank, in a row; each word's start in it; each text's number of words."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = (lower >= 128) | ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122))
    opens = inside.copy()
    text_starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    opens[1:] &= ~inside[:-1]
    # A text that begins with a word begins one, whatever the text before it ended with.
    opens[text_starts] = inside[text_starts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[text_starts[1:] - 1] = inside[text_starts[1:] - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    count = np.searchsorted(first, np.cumsum(sizes)) - np.searchsorted(first, np.cumsum(sizes) - sizes)
    starts = np.concatenate([[0], np.cumsum(last - first + 2)])
    joined = np.full(int(starts[-1]), 32, dtype=np.uint8)
    at = np.flatnonzero(inside)
    joined[np.arange(len(at)) + np.repeat(np.arange(len(first)), last - first + 1)] = lower[at]
    return joined, starts, count


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each distinct code, exactly; numbers follow the order of appearance."""
    encoded = pa.array(codes).dictionary_encode()
    number = encoded.indices.to_numpy()
    first = np.full(len(encoded.dictionary), -1, dtype=np.int64)
    first[number[::-1]] = np.arange(len(codes))[::-1]
    return first, number.astype(np.int64)


def buckets_of(data: np.ndarray, sizes: np.ndarray, buckets: int = BUCKETS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of all features of texts lying in a row, the texts' numbers of features, and of words.

    The features of a text lie together: first those of its first words of every block, by width.
    """
    joined, starts, count = _words(data, sizes)
    ends = np.cumsum(count)
    owner = np.repeat(np.arange(len(sizes)), count)
    found, texts = [], []
    for a in range(0, len(owner), BLOCK_WORDS):
        b = min(a + BLOCK_WORDS, len(owner))
        reach = min(b + width - 1, len(owner))
        # Words by number, exactly: the block's own dictionary.
        offsets = starts[a : reach + 1]
        base = int(offsets[0])
        words = pa.Array.from_buffers(
            pa.large_binary(), reach - a,
            [None, pa.py_buffer(np.ascontiguousarray(offsets - base)), pa.py_buffer(joined[base : int(offsets[-1])])],
        )
        word = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        kinds = int(word.max()) + 1
        code = np.zeros(reach - a, dtype=np.int64)
        for n in range(1, width + 1):
            # The run of n words from i, as a number: that of the first n - 1 with the n-th word's.
            code = code[: reach - a - n + 1] * kinds + word[n - 1 :] if n > 1 else word
            place = np.arange(min(b - a, len(code)))
            place = place[a + place + n <= ends[owner[a + place]]]
            if not len(place):
                break
            first, number = _distinct(code[place])
            at = a + place[first]
            crc = crc_slices(joined, starts[at], starts[at + n] - 1 - starts[at])
            found.append((crc % buckets).astype(np.uint16)[number])
            texts.append(owner[a + place])
            # Renumbered, so that the next product stays small. Runs that end beyond their text keep any number.
            code = pa.array(code).dictionary_encode().indices.to_numpy().astype(np.int64)
    if not found:
        return np.zeros(0, np.uint16), np.zeros(len(sizes), np.int64), count
    of, all_found = np.concatenate(texts), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    return all_found[order], np.bincount(of, minlength=len(sizes)), count


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        text = pc.fill_null(pc.cast(batch.column("text"), pa.large_binary()), b"")
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART_BYTES, side="right")) - 1)
            data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[a] : offsets[b]]
            yield batch.slice(a, b - a), data, np.diff(offsets[a : b + 1])
            a = b


def hashed(df: DataFrame, *keep: Column, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``keep`` and, for each row, ``n_features``, ``n_words`` and ``buckets`` (two bytes for each feature). No shuffle."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("bucket numbers have two bytes")
    table = df.select(*keep, F.col(f"`{text}`").alias("text"))
    kept = [c for c in table.columns if c != "text"]

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, sizes in _parts(batches):
            found, n_features, n_words = buckets_of(data, sizes, buckets)
            ends = np.concatenate([[0], np.cumsum(2 * n_features)]).astype(np.int64)
            packed = pa.Array.from_buffers(
                pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(found))]
            )
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in kept], pa.array(n_features, pa.int64()), pa.array(n_words, pa.int64()),
                 packed.cast(pa.binary())],
                [*kept, "n_features", "n_words", "buckets"],
            )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields if f.name != "text"]
    return table.mapInArrow(hash_texts, ", ".join([*kinds, "n_features bigint", "n_words bigint", "buckets binary"]))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and how many each row has."""
    packed = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    offsets = np.frombuffer(packed.buffers()[1], dtype=np.int64)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(data).view(np.uint16), np.diff(offsets) // 2


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``n``: how often each bucket occurs. Each task sends its sums, at most ``buckets`` rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("buckets"))[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["bucket", "n"])

    partial = features.select("buckets").mapInArrow(counted, "bucket int, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """``floor(1000 * ln(((t + 1) * (S + buckets)) / ((s + 1) * (T + buckets))))`` for each bucket."""
    all_s, all_t = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array(
        [
            math.floor(1000 * math.log((target.get(b, 0) + 1) * all_s / ((corpus.get(b, 0) + 1) * all_t)))
            for b in range(buckets)
        ],
        dtype=np.int64,
    )


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``key``, ``n_features``, ``n_words``, ``weight`` (sum of the gains of a row's features)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = _flat(batch.column("buckets"))
            sums = np.concatenate([[0], np.cumsum(gain[found])])
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n_features"), batch.column("n_words"), pa.array(sums[ends] - sums[ends - n])],
                ["key", "n_features", "n_words", "weight"],
            )

    kind = features.schema["key"].dataType.simpleString()
    return features.select("key", "n_features", "n_words", "buckets").mapInArrow(
        weigh, f"key {kind}, n_features bigint, n_words bigint, weight bigint"
    )


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Noise in thousandths, hashed from seed and key: ``floor(-1000 * ln(-ln(u)))``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_features``, ``weight``, ``score``, ``rank`` (null unless drawn).

    Of the rows with at least ``least_words`` words, ``percent`` of a hundred are drawn.
    """
    features = stored(hashed(df, F.col(f"`{key}`").alias("key"), text=text, buckets=buckets), "features")
    wanted = hashed(target, text=target_text, buckets=buckets)
    # One row a bucket at most.
    corpus = {r.bucket: r.n for r in bucket_counts(features, buckets).collect()}
    gain = gains(corpus, {r.bucket: r.n for r in bucket_counts(wanted, buckets).collect()}, buckets)
    scored = weighed(features, gain).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed))
    fit = F.col("n_words") >= least_words
    # The fit ones first, best first: a row's number among all is then its rank. The sort spreads any number of ties.
    ordered = stored_in_order(
        scored.withColumn("fit", fit), F.desc("fit"), F.desc("score"), F.col("key").asc_nulls_last(), F.col("n_features"),
        F.col("weight"), label="scores",
    )
    drawn = ordered.agg(F.floor(F.count_if("fit") * percent / 100)).first()[0]
    place = F.col("row_no").cast("bigint")
    return with_row_number(ordered).select(
        F.col("key").alias(key), "n_features", "weight", "score", F.when(F.col("fit") & (place <= drawn), place).alias("rank")
    )
