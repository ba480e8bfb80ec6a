"""Removing repeated 50-byte strings with a collection Burrows-Wheeler transform.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller key. Building one suffix array over a corpus would pass everything
through one place, so strings first meet by content:

1.  Each 50-byte window is assigned to its minimizer, the 12-byte string in it
    with the least hash. Neighbouring windows mostly share one, so a text falls
    into segments of 50 to 88 bytes (a segment: all windows in a row with one
    minimizer). Equal windows have equal minimizers, so segments are dealt out
    by minimizer, packed into compressed blocks. Before, equal segments of a
    block's texts are merged: only the copies in the smallest document can
    matter to others, all others are covered at once. A passage or text that a
    third of the corpus repeats thus leaves a task only once.
2.  A bucket's segments are merged once more. Those left that share enough
    context around their minimizer with another are built into one collection
    transform, column by column: each round inserts one symbol of every
    segment, from its end to its start. A suffix's place follows from its
    symbol and the place of the suffix one shorter; neighbours' common
    prefixes are updated where a suffix comes in between. Runs of suffixes
    with common prefixes of 50 or more are equal windows; windows of documents
    other than the run's smallest are covered.
3.  Covered stretches go back to their document by key, many documents' in one
    compressed block, and the text is cut.

The transform's columns are kept in memory, a bucket at a time, not in files:
buckets are sized to fit, and executors' own disks are not shared.

Keys: any order Spark gives them; the query's are integers. A null key counts
as larger than any other. Rows with equal keys do not cover each other; a row is
known by its key and 64 bits of its text's hash. Null
and empty texts and texts under 50 bytes lose nothing. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import shuffles_cleaned, stored

LENGTH = 50
GRAM = 12
SPAN = LENGTH - GRAM + 1  # places of the minimizer in a window
WIDTH = LENGTH + SPAN - 1  # bytes of the longest segment
# Context beside the minimizer of which one side at least is whole in both of two segments with an equal window.
CONTEXT = (LENGTH - GRAM) // 2
# Text bytes merged into one set of blocks in a task.
BLOCK_BYTES = 6 << 20
# Text bytes that a bucket stands for. Its segments take about 3.5 times that before merging.
BUCKET_BYTES = 8 << 20
# Text bytes whose spans meet in a task: at most a few times 28 bytes for each 50 of them.
PART_BYTES = 64 << 20
NO_KEY = np.iinfo(np.int64).max
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 12 bytes from each place on."""
    p = U(0x9E3779B97F4A7C15)
    h1 = data.astype(U) + U(1)
    h2 = h1[:-1] * p + h1[1:]
    p2 = np.array([p]) * p
    h4 = h2[:-2] * p2 + h2[2:]
    p4 = p2 * p2
    h8 = h4[:-4] * p4 + h4[4:]
    return _mix(h8[:-4] * p4 + h4[8:])


def _minimizers(data: np.ndarray) -> np.ndarray:
    """For the window from each place on, the place of its minimizer (the first of equal ones)."""
    n = len(data) - LENGTH + 1
    # The place in the low bits makes ties fall to the first.
    key = _gram_hashes(data)
    key = (key & U(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=U)
    low = key
    width = 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[SPAN - width : SPAN - width + n])
    return (low & U(0xFFFFFFFF)).astype(np.int64)


def segments(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts lying in a row in ``data``: each segment's text number, start in the text, number of windows, and the
    minimizer's place in the segment."""
    texts, begins, windows, at = [], [], [], []
    # Runs of texts of about 256 KB at a time keep the arrays in the processor's cache.
    i, n = 0, len(sizes)
    while i < n:
        j, total = i, 0
        while j < n and (total == 0 or total + sizes[j] <= 1 << 18):
            total += sizes[j]
            j += 1
        a, b = starts[i], starts[j - 1] + sizes[j - 1]
        if b - a >= LENGTH:
            place = _minimizers(data[a:b])
            # Windows that lie in one text.
            text = np.repeat(np.arange(i, j), sizes[i:j])[: len(place)]
            inside = np.arange(a, a + len(place)) + LENGTH <= (starts + sizes)[text]
            new = np.ones(len(place), dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
            new &= inside
            first = np.flatnonzero(new)
            # A segment ends before the next one or at its text's last window.
            last = np.append(first[1:], len(place)) - 1
            last = np.minimum(last, (starts + sizes)[text[first]] - LENGTH - a)
            texts.append(text[first])
            begins.append(first + a - starts[text[first]])
            windows.append(last - first + 1)
            at.append(place[first] - first)
        i = j
    if not texts:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in (texts, begins, windows, at))


def rows_of(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A matrix of ``WIDTH`` bytes: the bytes from each place on, zeros behind ``size``."""
    padded = np.concatenate([data, np.zeros(WIDTH, dtype=np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    out[np.arange(WIDTH) >= size[:, None]] = 0
    return out


def _row_hash(rows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view(U).reshape(len(rows), rows.shape[1] // 8)
    h = np.zeros(len(rows), dtype=U)
    for c in range(words.shape[1]):
        h = (h ^ words[:, c]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
    return _mix(h)


def merge_equal(rows: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the segments with equal ones together, smallest key first; and which of them open a group.

    Grouped by a 64-bit hash; a segment that differs from its group's first opens a group of its own.
    """
    h = _row_hash(rows) ^ _mix(size.astype(U))
    order = np.lexsort((key, h))
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = h[order][1:] != h[order][:-1]
    lead = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
    differs = np.flatnonzero(lead != order)
    differs = differs[
        (size[order[differs]] != size[lead[differs]]) | (rows[order[differs]] != rows[lead[differs]]).any(1)
    ]
    if len(differs):
        # Two contents under one hash: sort those groups by their bytes.
        apart = np.isin(h, h[order[differs]])
        exact = np.array([rows[i].tobytes() for i in range(len(rows))], dtype=object)
        ids = {b: n for n, b in enumerate(dict.fromkeys(exact[apart].tolist()))}
        sub = np.array([ids[b] if a else 0 for b, a in zip(exact.tolist(), apart.tolist(), strict=True)])
        order = np.lexsort((key, size, sub, h))
        opens = np.ones(len(order), dtype=bool)
        same = (h[order][1:] == h[order][:-1]) & (sub[order][1:] == sub[order][:-1]) & (size[order][1:] == size[order][:-1])
        opens[1:] = ~same
    return order, opens


def common_prefix(rows: np.ndarray, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, cap: int) -> np.ndarray:
    """Whether row a from byte i on and row b from byte j on agree in ``cap`` bytes."""
    flat = np.concatenate([rows.ravel(), np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.as_strided(flat.view(np.uint8), (rows.size + 1, 8), (1, 1))
    x, y = a * WIDTH + i, b * WIDTH + j
    same = np.arange(len(a))
    for c in (*range(0, cap - 7, 8), cap - 8):
        left = np.ascontiguousarray(words[x[same] + c]).view(U).ravel()
        right = np.ascontiguousarray(words[y[same] + c]).view(U).ravel()
        same = same[left == right]
    out = np.zeros(len(a), dtype=bool)
    out[same] = True
    return out


def collection_bwt(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows' suffixes in the order of the collection's transform: row, start, and whether each has a common prefix
    of 50 with the one before it.

    Round r inserts, for every row of r or more bytes, the suffix of r bytes. The transform holds, for each suffix so
    far, the symbol before it (0: none, the row is used up). A suffix c + S comes behind all suffixes that start with a
    smaller symbol, and among those with c it has the rank that S has among the suffixes preceded by c.
    """
    m = len(rows)

    def column(r: int, who: np.ndarray) -> np.ndarray:
        at = size[who] - 1 - r
        return np.where(at >= 0, rows[who, np.maximum(at, 0)].astype(np.uint16) + 1, 0)

    # Round 0: the empty suffixes, in the order of the rows.
    everyone = np.arange(m)
    symbol = column(0, everyone).astype(np.uint16)
    row = everyone.astype(np.int32)
    fresh = np.arange(m)
    for r in range(1, int(size.max()) + 1):
        if r == LENGTH:
            # Shorter suffixes cannot share 50 bytes: length 0 stands for all of them.
            length, shared = np.zeros(len(symbol), dtype=np.uint8), np.zeros(len(symbol), dtype=bool)
        # Only suffixes inserted last can be extended; where they go follows from the transform.
        going = fresh[symbol[fresh] > 0]
        order = np.argsort(symbol, kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        zeros = int(np.count_nonzero(symbol == 0))
        # The sorted transform is the order of all non-empty suffixes; the m empty ones come before them.
        target = rank[going].astype(np.int64) - zeros + m
        who = row[going]
        by_place = np.argsort(target)
        target, who = target[by_place], who[by_place]
        total = len(symbol) + len(who)
        stayed = np.ones(total, dtype=bool)
        stayed[target] = False
        stayed = np.flatnonzero(stayed)
        weave = lambda old, new: _weave(old, new, stayed, target)  # noqa: E731, B023
        symbol, row, fresh = weave(symbol, column(r, who).astype(np.uint16)), weave(row, who), target
        if r >= LENGTH:
            length, shared = weave(length, np.uint8(r)), weave(shared, False)
            # A new suffix changes the common prefix with its neighbours on both sides.
            touched = np.zeros(total + 1, dtype=bool)
            touched[target] = touched[target + 1] = True
            touched = np.flatnonzero(touched[:total])
            shared[touched] = False
            touched = touched[(touched > 0) & (length[touched] > 0) & (length[touched - 1] > 0)]
            a, b = row[touched], row[touched - 1]
            shared[touched] = common_prefix(rows, a, size[a] - length[touched], b, size[b] - length[touched - 1], LENGTH)
    # A shorter suffix never stands between two windows that share 50 bytes: it would sort before both.
    place = np.flatnonzero(length)
    row = row[place].astype(np.int64)
    return row, size[row] - length[place], shared[place]


def _weave(old: np.ndarray, new, stayed: np.ndarray, target: np.ndarray) -> np.ndarray:
    out = np.empty(len(stayed) + len(target), dtype=old.dtype)
    out[stayed] = old
    out[target] = new
    return out


def covered_windows(rows: np.ndarray, size: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of different segments: row and place of each window that also lies in a segment with a smaller key."""
    pick = np.flatnonzero(_maybe_shared(rows, size, at))
    if not len(pick):
        return pick, pick
    rows, size, key = rows[pick], size[pick], key[pick]
    row, start, shared = collection_bwt(rows, size)
    first = np.flatnonzero(~shared)
    least = np.minimum.reduceat(key[row], first)
    hit = np.flatnonzero(key[row] > np.repeat(least, np.diff(np.append(first, len(row)))))
    return pick[row[hit]], start[hit]


def _maybe_shared(rows: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Segments that share the minimizer and the context on one side of it with another segment.

    An equal window has the minimizer in it, and beside it ``LENGTH - GRAM`` more bytes: half of them on one side.
    """
    flat = np.concatenate([np.zeros(WIDTH, dtype=np.uint8), rows.ravel(), np.zeros(WIDTH, dtype=np.uint8)])
    base = np.arange(len(rows)) * WIDTH + WIDTH + at
    out = np.zeros(len(rows), dtype=bool)
    width = GRAM + CONTEXT
    view = np.lib.stride_tricks.sliding_window_view(flat, width)
    for begin, there in ((base - CONTEXT, at >= CONTEXT), (base, at + width <= size)):
        who = np.flatnonzero(there)
        part = np.zeros((len(who), 32), dtype=np.uint8)
        part[:, :width] = view[begin[who]]
        h = _row_hash(part)
        order = np.argsort(h)
        twin = h[order][1:] == h[order][:-1]
        out[who[order[1:][twin]]] = True
        out[who[order[:-1][twin]]] = True
    return out


def merged_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, joined where they touch."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    opens = np.ones(len(begin), dtype=bool)
    opens[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(opens)
    return begin[first], end[np.append(first[1:], len(end)) - 1]


def by_document(key, tag, begin, end) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of many documents, in order of documents, joined where they touch."""
    order = np.lexsort((tag, key))
    key, tag = key[order], tag[order]
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
    # Places beyond any text's end keep the documents apart.
    shift = (np.cumsum(opens) - 1) << 33
    x, y = merged_spans(begin[order].astype(np.int64) + shift, end[order].astype(np.int64) + shift)
    of = np.flatnonzero(opens)[x >> 33]
    return key[of], tag[of], x - shift[of], y - shift[of]


def _squeeze(arrays, level: int) -> bytes:
    out = io.BytesIO()
    for x in arrays:
        np.save(out, x)
    return zstandard.ZstdCompressor(level=level).compress(out.getvalue())


def _unsqueeze(block: bytes, n: int) -> list[np.ndarray]:
    raw = io.BytesIO(zstandard.ZstdDecompressor().decompress(block))
    return [np.load(raw) for _ in range(n)]


def _pack_spans(key, tag, begin, end, n_parts: int) -> tuple[np.ndarray, list[bytes]]:
    """Spans dealt out by their document, a compressed block for each part that has some."""
    if not len(key):
        return np.zeros(0, dtype=np.int32), []
    key, tag, begin, end = by_document(key, tag, begin, end)
    part = (_mix(key.astype(U) ^ _mix(tag.astype(U))) % U(n_parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1], [True]]))
    blocks = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        o = order[a:b]
        blocks.append(_squeeze((np.diff(key[o], prepend=0), tag[o], begin[o], end[o] - begin[o]), 3))
    return part[order][cuts[:-1]], blocks


def _unpack_spans(column: pa.ChunkedArray) -> list[np.ndarray]:
    """key, tag, begin, end of all blocks"""
    parts = [_unsqueeze(b.as_py(), 4) for b in column if b.is_valid]
    key, tag, begin, size = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([p[i] for p in parts] for i in range(4)))
    if parts:
        key = np.concatenate([np.cumsum(p[0]) for p in parts])
    return [key, tag, begin, begin + size]


SPAN_ROWS = "bucket int, block binary, spans binary"


def _pack(rows, size, at, text, key, tag, begin) -> bytes:
    """Segments in order of their texts, each once for each occurrence in its smallest document, compressed."""
    opens = np.ones(len(text), dtype=bool)
    opens[1:] = text[1:] != text[:-1]
    return _squeeze(
        (
            rows, size.astype(np.uint8), at.astype(np.uint8), opens, np.diff(key[opens], prepend=0),
            tag[opens], begin,
        ),
        6,
    )


def _unpack(block: bytes) -> list[np.ndarray]:
    """rows, size, at, key, tag, begin"""
    rows, size, at, opens, key, tag, begin = _unsqueeze(block, 7)
    of = np.cumsum(opens) - 1
    return [rows, size.astype(np.int64), at.astype(np.int64), np.cumsum(key)[of], tag[of], begin]


def _blocks(n_buckets: int):
    """Texts to blocks of segments by bucket, and the spans known already."""

    def work(data, starts, sizes, key, tag) -> Iterator[pa.RecordBatch]:
        text, begin, windows, at = segments(data, starts, sizes)
        if not len(text):
            return
        size = windows + LENGTH - 1
        rows = rows_of(data, starts[text] + begin, size)
        seg_key, seg_tag = key[text], tag[text]
        order, opens = merge_equal(rows, size, seg_key)
        group = np.cumsum(opens) - 1
        lead = order[opens]
        # Occurrences beyond the smallest document are covered whole.
        late = seg_key[order] > seg_key[lead][group]
        gone = order[late]
        if len(gone):
            known, spans = _pack_spans(seg_key[gone], seg_tag[gone], begin[gone], begin[gone] + size[gone], n_buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(known), pa.nulls(len(known), pa.binary()), pa.array(spans, pa.binary())],
                ["bucket", "block", "spans"],
            )
        stay = np.sort(order[~late])
        gram = np.zeros((len(stay), 16), dtype=np.uint8)
        for i in range(GRAM):
            gram[:, i] = rows[stay, at[stay] + i]
        bucket = (_row_hash(gram) >> U(33)).astype(np.int64) % n_buckets
        by = np.argsort(bucket, kind="stable")
        stay, bucket = stay[by], bucket[by]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        numbers, blocks = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s = stay[a:b]
            numbers.append(int(bucket[a]))
            blocks.append(_pack(rows[s], size[s], at[s], text[s], seg_key[s], seg_tag[s], begin[s].astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(numbers, dtype=np.int32)), pa.array(blocks, pa.binary()),
                pa.nulls(len(numbers), pa.binary()),
            ],
            ["bucket", "block", "spans"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # Slices of about BLOCK_BYTES: what a task holds does not depend on how long the texts of a batch are.
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.unique(np.searchsorted(ends, np.arange(BLOCK_BYTES, ends[-1], BLOCK_BYTES)) + 1)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a < b:
                    part = batch.slice(a, b - a)
                    text = pc.cast(part.column("text"), pa.large_binary())
                    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
                    data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
                    offsets = offsets - offsets[0]
                    yield from work(
                        data, offsets[:-1], np.diff(offsets), part.column("key").to_numpy(), part.column("tag").to_numpy()
                    )

    return run


def _solve(n_parts: int):
    """All blocks of a bucket to spans, which go on with the spans known already, dealt out by document."""

    def solve(table: pa.Table) -> pa.Table:
        spans = [_unpack_spans(table.column("spans")), *_found([_unpack(b.as_py()) for b in table.column("block") if b.is_valid])]
        parts, blocks = _pack_spans(*(np.concatenate(x) for x in zip(*spans, strict=True)), n_parts)
        return pa.table({"part": pa.array(parts), "spans": pa.array(blocks, pa.binary())})

    return solve


def _found(parts: list[list[np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
    """key, tag, begin, end of what a bucket's segments show to be covered."""
    if not parts:
        return []
    rows, size, at, key, tag, begin = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()  # twice as much memory otherwise
    order, opens = merge_equal(rows, size, key)
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(opens) - 1
    lead = order[opens]
    late = key > key[lead][group]
    # Segments that another block has from a smaller document are covered; the others go into the transform once.
    row, place = covered_windows(rows[lead], size[lead], at[lead], key[lead])
    found = [(key[late], tag[late], begin[late], begin[late] + size[late])]
    if len(row):
        # Every occurrence of the segment in its smallest document has the same windows covered.
        by_group = np.argsort(group[~late], kind="stable")
        owners = np.flatnonzero(~late)[by_group]
        count = np.bincount(group[owners], minlength=len(lead))
        first = np.cumsum(count) - count
        times = count[row]
        which = np.repeat(first[row], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        o = owners[which]
        start = begin[o] + np.repeat(place, times)
        found.append((key[o], tag[o], start, start + LENGTH))
    return found


def _gather(table: pa.Table) -> pa.Table:
    """A row for each document: its spans as pairs of numbers."""
    key, tag, begin, end = by_document(*_unpack_spans(table.column("spans")))
    opens = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])]))
    spans = pa.ListArray.from_arrays(
        pa.array(2 * np.append(opens, len(key)).astype(np.int32)), pa.array(np.stack([begin, end], 1).ravel())
    )
    return pa.table({"key": pa.array(key[opens]), "tag": pa.array(tag[opens]), "spans": spans})


def _tag(text: Column) -> Column:
    return F.xxhash64(text)


def covered_spans(df: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``key`` (null as the largest number), ``tag`` (a hash of the text, to tell rows of one key apart), ``spans``
    (begin, end, begin, …): one row for each document that loses something."""
    rows = df.select(
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(int(NO_KEY))).alias("key"),
        _tag(F.col(f"`{text}`")).alias("tag"),
        F.encode(F.col(f"`{text}`"), "UTF-8").alias("text"),
    ).where(F.octet_length("text") >= LENGTH)
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0  # one number
    n_buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    dealt = rows.mapInArrow(_blocks(n_buckets), SPAN_ROWS)
    # A document's spans come from many buckets: they travel in blocks, not a row each.
    n_parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    # The number of tasks follows from the texts, and each takes its buckets one after the other.
    tasked = dealt.withColumn("task", F.col("bucket") % n_parts).repartitionById(n_parts, F.col("task"))
    solved = tasked.groupBy("task", "bucket").applyInArrow(_solve(n_parts), "part int, spans binary")
    gathered = solved.repartitionById(n_parts, F.col("part")).groupBy("part")
    return gathered.applyInArrow(_gather, "key bigint, tag bigint, spans array<bigint>")


def _cut(with_bytes: bool):
    return lambda batches: _cut_batches(batches, with_bytes)


def _cut_batches(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
        texts, every = batch.column("text"), batch.column("spans")
        for text, spans in zip(texts, every, strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            pairs = np.array([], dtype=np.int64)
            if spans.is_valid:
                pairs = np.asarray(spans.values)
            begin, end = pairs[::2], pairs[1::2]
            left = b"".join(
                data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)
            )
            n_bytes.append(len(data))
            n_removed.append(len(data) - len(left))
            n_spans.append(len(begin))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left if with_bytes else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()),
            ],
            ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = True, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (the bytes left) for each row.

    What is left need not be UTF-8: a cut may fall inside a character.
    """
    # The blocks of segments are larger than the texts: they go before the texts are shuffled.
    with shuffles_cleaned(df.sparkSession):
        spans = stored(covered_spans(df, key, text, bucket_bytes), "spans").toDF("_k", "_t", "spans")
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    joined = rows.join(
        spans,
        (F.coalesce(F.col("key").cast("bigint"), F.lit(int(NO_KEY))) == F.col("_k")) & (_tag(F.col("text")) == F.col("_t")),
        "left",
    ).select("key", F.encode("text", "UTF-8").alias("text"), "spans")
    out = rows.select("key").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "binary")):
        out = out.add(name, kind)
    return joined.mapInArrow(_cut(with_bytes), out).withColumnRenamed("key", key)
