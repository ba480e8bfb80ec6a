"""The conversation trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tillwise.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (*t[:2], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()))
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        built[conv] = tuple(t[2:] for t in own.get(conv - conv % 100, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(list)
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = sum(saved[c] for c in children[path]) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(built[c]) == len(path))
        out.append((
            min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children[path]),
            leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def run(df, shard_turns=trie.SHARD_TURNS):
    return sorted(map(tuple, trie.prefix_trie(trie.rebuilt(trie.conversations(df)), shard_turns).collect()), key=repr)


@pytest.mark.parametrize("shard_turns", [3, 40, 10_000])
def test_equals_plain_python_for_any_shards(spark, shard_turns):
    rng = random.Random(4)
    rows = [(1, 0, "u", "a"), (1, None, "u", "b"), (1, None, None, None), (2, 0, "u", "a"), (2, 0, "u", "a"),
            (100, 1, "s", "x" * 100), (101, 0, "q", ""), (None, 0, "u", "no conversation"), (8, 0, "日", "🤯" * 9)]
    rows += [(c, t, "u", f"{t}") for c in range(200, 290) for t in range(c % 9)]  # one chain, many ends
    rows += [(c, t, "u", "same") for c in range(300, 400) for t in range(4)]  # copies of one conversation
    rows += [(c, t, rng.choice("ab"), rng.choice("xyz")) for c in range(400, 480) for t in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert run(df, shard_turns) == plain(rows)


def test_clashing_columns_long_conversations_and_empty_tables(spark):
    rows = [(600, t, "u", str(t % 7)) for t in range(3_000)] + [(601, t, "u", str(t % 7)) for t in range(3_000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], f"{SCHEMA}, keys int, key string")
    assert run(df) == plain(rows)
    assert run(df.limit(0)) == []
    # Conversations that turn out empty: their hundred is missing and they are shorter than what it should give.
    short = [(c, 0, "u", "gone") for c in range(701, 760)]
    assert run(spark.createDataFrame(short, SCHEMA)) == plain(short)


def test_search_tree_stays_shallow_on_sorted_input():
    tree = trie.Tree()
    for i in trie._middle_first(1023):
        tree.insert([i], 1, i, "")

    def height(at):
        return 1 + max(height(tree.low[at]), height(tree.high[at])) if at else 0

    assert height(tree.down[0]) == 10
