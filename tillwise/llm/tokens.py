"""Token counts by rank-synchronous merging.

A batch's distinct words are held as one ragged array of symbols. In each round
every sequence takes its own lowest rank among its neighbouring pairs and
merges all pairs of that rank at once, then only the pairs beside a merge are
looked up again. Sequences without a pair left drop out; what symbols survive
are counted (a character in no piece counts its UTF-8 bytes). Words are short
and repeat, so a round works on few symbols and counts are remembered.

Merging all pairs of a rank at once equals merging them one by one from the
left, but for one case: a merge may bring up a pair of the same or a lower rank
beside it, which then comes first. Merges behind such a one wait a round.

Null and empty texts have no tokens. Texts of any length are counted whole: a
very long text without spaces falls apart wherever no piece spans two
neighbouring characters. Repeated rows get a row each; other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm import pieces
from tillwise.llm.pieces import Pieces

LIMIT = 4096
# Remembered words of a task, and the longest of them in code points. Words come back often, long ones (texts without
# spaces) hardly ever; beyond this many, memory starts afresh.
REMEMBERED = 400_000
LONGEST = 48
# Code points in one call of the merging loop.
CHUNK = 1 << 21
NONE = np.int64(1) << 40


def _ranks(p: Pieces, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair, NONE where it makes no piece."""
    table, rank, _ = p.merges
    at = table.find((left << 20) | right)
    return np.where(at >= 0, rank[at], NONE)


def count_symbols(p: Pieces, texts: list[str]) -> np.ndarray:
    """How many tokens each word has, for words with their leading spaces."""
    codes, starts = pieces.flat(texts)
    total = np.zeros(len(texts), dtype=np.int64)
    if not len(codes):
        return total
    sym = p.symbols(codes)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    # Symbols in no vocabulary entry come out as bytes; the others count one for now.
    np.add.at(total, owner, np.where((sym >= 0) & (sym < p.size), 1, pieces.utf8_size(codes)))
    # Cut where no piece spans two neighbours; each part is a sequence of its own.
    tied = (owner[1:] == owner[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0)
    tied[tied] = p.bigrams.find((sym[:-1][tied] << 20) | sym[1:][tied]) >= 0
    seq = np.concatenate([[0], np.cumsum(~tied)])
    keep = np.bincount(seq, minlength=seq[-1] + 1)[seq] > 1
    sym, owner, seq, size = sym[keep], owner[keep], seq[keep], np.where(
        (sym[keep] < p.size), 1, pieces.utf8_size(codes[keep])
    )
    table, _, made = p.merges
    rank = np.full(len(sym), NONE)
    if len(sym) > 1:
        rank[:-1] = np.where(seq[1:] == seq[:-1], _ranks(p, sym[:-1], sym[1:]), NONE)
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        sizes = np.diff(np.append(first, len(sym)))
        best = np.minimum.reduceat(rank, first)
        # Finished sequences are moved out when they are many.
        if np.count_nonzero(best < NONE) < 0.8 * len(best):
            alive = np.repeat(best < NONE, sizes)
            sym, owner, seq, size, rank = (x[alive] for x in (sym, owner, seq, size, rank))
            sizes, best = sizes[best < NONE], best[best < NONE]
            if not len(sym):
                break
        lowest = np.repeat(best, sizes)
        at = np.flatnonzero((rank == lowest) & (rank < NONE))
        if not len(at):
            break
        # Overlapping pairs of one rank: the left one wins, so every other one in a run of neighbours.
        run_start = np.concatenate([[True], (at[1:] != at[:-1] + 1)])
        run_no = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
        at = at[run_no % 2 == 0]
        new = made[table.find((sym[at] << 20) | sym[at + 1])]
        if len(at) > len(best):
            # Does a merge bring up a pair that comes before the next one? Its left neighbour may be merged already.
            before = np.maximum(at - 1, 0)
            left = np.where(np.concatenate([[False], at[1:] == at[:-1] + 2]), np.concatenate([[0], new[:-1]]), sym[before])
            after = np.minimum(at + 2, len(sym) - 1)
            early = np.minimum(
                np.where((at > 0) & (seq[before] == seq[at]), _ranks(p, left, new), NONE),
                np.where((at + 2 < len(sym)) & (seq[after] == seq[at]), _ranks(p, new, sym[after]), NONE),
            ) <= lowest[at]
            behind = np.cumsum(early) - early
            lead = np.concatenate([[True], seq[at[1:]] != seq[at[:-1]]])
            base = np.maximum.accumulate(np.where(lead, behind, 0))
            go = behind == base
            at, new = at[go], new[go]
        total -= np.bincount(owner[at], size[at] + size[at + 1] - 1, minlength=len(total)).astype(np.int64)
        sym[at], size[at] = new, 1
        left_over = np.ones(len(sym), dtype=bool)
        left_over[at + 1] = False
        sym, owner, seq, size, rank = (x[left_over] for x in (sym, owner, seq, size, rank))
        at = at - np.arange(len(at))
        touched = np.concatenate([at, at[at > 0] - 1])
        nxt = np.minimum(touched + 1, len(sym) - 1)
        rank[touched] = np.where(
            (touched + 1 < len(sym)) & (seq[nxt] == seq[touched]), _ranks(p, sym[touched], sym[nxt]), NONE
        )
    return total


@lru_cache(maxsize=2)
def counter(path: str):
    """A function from texts to token counts that remembers words between calls and tasks of a worker process."""
    p = pieces.load(path)
    known: dict[str, int] = {}

    def counted(new: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        start = 0
        while start < len(new):
            stop, n = start, 0
            while stop < len(new) and (n == 0 or n + len(new[stop]) <= CHUNK):
                n += len(new[stop])
                stop += 1
            out.update(zip(new[start:stop], count_symbols(p, new[start:stop]).tolist(), strict=True))
            start = stop
        return out

    def count(texts: list[str | None]) -> list[int]:
        split = [pieces.words(t) if t else [] for t in texts]
        every = set().union(*split)
        long = counted([w for w in every if len(w) > LONGEST])
        every -= long.keys()
        missing = list(every - known.keys())
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = list(every)
        known.update(counted(missing))
        return [sum(known[w] if len(w) <= LONGEST else long[w] for w in ws) for ws in split]

    return count


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens``, ``over_limit`` for each row. No shuffle; the model's path is the same on all executors."""
    path = model or pieces.tokenizer_path()
    schema = df.select(F.col(f"`{key}`").alias("key")).schema.add("n_bytes", "long").add("n_tokens", "long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = np.array(count(batch.column("text").to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n_bytes"), pa.array(n)], ["key", "n_bytes", "n_tokens"]
            )

    texts = df.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.col(f"`{text}`").alias("text"),
    )
    return texts.mapInArrow(counted, schema).select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
