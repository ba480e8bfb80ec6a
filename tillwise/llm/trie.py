"""The prefix trie of conversations: which turns they share, and what storing shared prefixes once would save.

Every conversation is the sequence of its turns; every distinct sequence of
first turns is a node. The work goes in four steps:

1.  Turns become keys of fixed size (MD5 of role and text, number of code
    points), so no text is shuffled, and a conversation one binary value whose
    byte order is the order of its turns. Equal sequences are brought together
    first: one row each, with the number of conversations and the digest of
    their ids, which is streamed over sorted ids. A sequence that a third of all
    conversations share is one row from here on.
2.  The distinct sequences are range-sorted into shards of about
    ``SHARD_TURNS`` turns. However common a first turn is, its conversations
    spread over as many shards as they need.
3.  Each shard numbers its turn keys by a dictionary of its own and inserts its
    sequences into a ternary search tree, the middle one first, then the middle
    ones of both halves, so that the tree is balanced although the input is
    sorted. An iterative traversal passes members, leaves and savings up.
4.  Only nodes on the paths of a shard's first and last sequence can lie in other
    shards too: at most two paths a shard. They leave the shard without the
    shares of one another; their sums are merged over the shards and passed up
    once more, in one small task: two sequences for each shard, whatever the
    data. Nodes below them learn their parent's name from that.

Turns are ordered by ``turn``, null first; turns with one number by the MD5 of
role and text. A null role or text is empty. Rows without a conversation id
belong to no conversation and are left out. Repeated rows are turns of their
own. A conversation without turns ends at the root. An empty table gives an
empty result, without a root. Other columns are not read. One conversation is
one value (20 bytes a turn), and a shard holds whole conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import stored

# A turn's key: 16 bytes of MD5 and 4 of its number of code points.
KEY_BYTES = 20
SHARD_TURNS = 200_000
# The most turns that a conversation takes over from another one.
GIVEN = 5
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.md5(b"").digest()

NODE = (
    "node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, length bigint"
)


def turn_key(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    # With the role's length in front no two pairs read the same.
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.unhex(F.md5(whole)), F.unhex(F.lpad(F.hex(F.length(text).cast("bigint")), 8, "0")))


def conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``keys``: the turn keys of each conversation in order."""
    rows = df.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), turn_key(F.col(f"`{role}`"), F.col(f"`{text}`")).alias("key")).alias("one"),
    )
    # sort_array puts nulls first.
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one"))["key"].alias("keys"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with its first ``h`` turns taken from that of the hundred it belongs to; ``h`` by checksum."""
    hundred = F.col("conv_id") - F.col("conv_id") % 100
    # At most a hundred conversations on either side of zero ask for one of these.
    given = convs.where(F.col("conv_id") == hundred).select(
        F.col("conv_id").alias("hundred"), F.slice("keys", 1, GIVEN).alias("given")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (GIVEN + 1)).cast("int")
    own = F.expr("slice(keys, h + 1, greatest(size(keys) - h, 0))")
    return (
        convs.withColumns({"hundred": hundred, "h": h})
        .join(given, "hundred", "left")
        .select("conv_id", F.concat(F.coalesce(F.expr("slice(given, 1, h)"), F.array().cast("array<binary>")), own).alias("keys"))
    )


def sequences(convs: DataFrame) -> DataFrame:
    """One row per distinct sequence: ``seq``, ``n`` (conversations), ``conv_id`` (the smallest), ``ends`` (digest of all ids)."""
    # An id and 16 bytes travel for a conversation. Ids are sorted by Spark and streamed: nothing is gathered.
    # (The bytes of an array's elements in a row; concat_ws would read them as text.)
    joined = F.aggregate("keys", F.lit(b""), lambda a, b: F.concat(a, b))
    rows = stored(convs.select("conv_id", joined.alias("seq")).withColumn("id", F.md5("seq")), "sequences")
    bodies = rows.groupBy("id").agg(F.first("seq").alias("seq"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, smallest, digest = None, 0, None, None
        out: list[tuple] = []
        for batch in batches:
            ids = batch.column("id").dictionary_encode()
            number = ids.indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            conv = batch.column("conv_id")
            for a, b in pairwise(edges if len(number) else []):
                one = ids.dictionary[int(number[a])].as_py()
                text = ",".join(map(str, conv.slice(a, b - a).to_pylist()))
                if one == last:
                    digest.update(b"," + text.encode())
                else:
                    if last is not None:
                        out.append((last, n, smallest, digest.hexdigest()))
                    last, n, smallest, digest = one, 0, conv[a].as_py(), hashlib.sha256(text.encode())
                n += b - a
            if len(out) > 10_000:
                yield _batch(out, ["id", "n", "conv_id", "ends"])
                out = []
        if last is not None:
            out.append((last, n, smallest, digest.hexdigest()))
        if out:
            yield _batch(out, ["id", "n", "conv_id", "ends"])

    ends = (
        rows.select("id", "conv_id").repartition("id").sortWithinPartitions("id", "conv_id")
        .mapInArrow(digested, "id string, n bigint, conv_id bigint, ends string")
    )
    return bodies.join(ends, "id").select("seq", "n", "conv_id", "ends")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names)


class Tree:
    """A ternary search tree over sequences of whole numbers. Node 0 is the root, the empty sequence."""

    def __init__(self) -> None:
        self.symbol, self.low, self.high = [-1], [0], [0]
        # Top of the search tree over a node's children; the node's parent in the trie.
        self.down, self.parent, self.depth = [0], [-1], [0]
        self.n, self.conv, self.end = [0], [None], [None]

    def child(self, node: int, symbol: int) -> int:
        """The child of ``node`` for ``symbol``, made if need be."""
        at, links, place = self.down[node], self.down, node
        while at:
            mine = self.symbol[at]
            if symbol == mine:
                return at
            links, place = (self.low, at) if symbol < mine else (self.high, at)
            at = links[at]
        new = len(self.symbol)
        links[place] = new
        self.symbol.append(symbol)
        for links in (self.low, self.high, self.down):
            links.append(0)
        self.parent.append(node)
        self.depth.append(self.depth[node] + 1)
        self.n.append(0)
        self.conv.append(None)
        self.end.append(None)
        return new

    def insert(self, symbols: list[int], n: int, conv: int, end: str) -> int:
        node = 0
        self._count(node, n, conv)
        for symbol in symbols:
            node = self.child(node, symbol)
            self._count(node, n, conv)
        self.end[node] = end
        return node

    def _count(self, node: int, n: int, conv: int) -> None:
        self.n[node] += n
        if self.conv[node] is None or conv < self.conv[node]:
            self.conv[node] = conv

    def path(self, node: int) -> Iterator[int]:
        while node >= 0:
            yield node
            node = self.parent[node]


def _middle_first(n: int) -> Iterator[int]:
    """0 to n - 1: the middle, then the middles of both halves, and so on."""
    spans = [(0, n)]
    for a, b in spans:
        if a < b:
            middle = (a + b) // 2
            yield middle
            spans.extend(((a, middle), (middle + 1, b)))


def shard_nodes(rows: list[tuple[bytes, int, int, str]]) -> list[tuple]:
    """The nodes (as ``NODE``) of a shard's sequences, sorted: ``seq``, ``n``, ``conv_id``, ``ends``.

    Nodes that other shards may have too carry a ``node`` name, and their sums lack what comes through such children.
    """
    flat = np.frombuffer(b"".join(r[0] for r in rows), dtype=f"V{KEY_BYTES}")
    names = pa.array(flat.tolist(), pa.binary(KEY_BYTES)).dictionary_encode()
    code = names.indices.to_pylist()
    ends = np.cumsum([len(r[0]) // KEY_BYTES for r in rows]).tolist()
    tree = Tree()
    last_of = {}
    for i in _middle_first(len(rows)):
        seq, n, conv, end = rows[i]
        node = tree.insert(code[ends[i] - len(seq) // KEY_BYTES : ends[i]], n, conv, end)
        if i in (0, len(rows) - 1):
            last_of[i] = node
    keys = names.dictionary.to_pylist()
    open_ = {x for node in last_of.values() for x in tree.path(node)}
    named = {0: ROOT}
    for x in sorted(open_ - {0}, key=tree.depth.__getitem__):
        named[x] = hashlib.md5(named[tree.parent[x]] + keys[tree.symbol[x]]).digest()
    length = [0, *(int.from_bytes(keys[s][16:], "big") for s in tree.symbol[1:])]
    size = len(tree.symbol)
    children, leaves = [0] * size, [0] * size
    saved = [(tree.n[x] - 1) * length[x] for x in range(size)]
    for x in open_:
        saved[x] = 0
    # A node is numbered after its parent, so from the last to the first every node is whole before it is passed up.
    for x in range(size - 1, 0, -1):
        if x in open_:
            continue
        up = tree.parent[x]
        leaves[x] = leaves[x] or 1
        children[up] += 1
        leaves[up] += leaves[x]
        saved[up] += saved[x]
    return [
        (
            named.get(x), named.get(tree.parent[x]) if x else None, tree.depth[x], tree.conv[x],
            tree.conv[tree.parent[x]] if x and tree.parent[x] not in open_ else None,
            tree.n[x], children[x], leaves[x], saved[x], tree.end[x], length[x],
        )
        for x in range(size)
    ]


def merged(rows: list[dict]) -> list[tuple]:
    """Open nodes, already summed over the shards, with their children's shares: deepest first, then by name."""
    by_name = {r["node"]: dict(r) for r in rows}
    for r in sorted(by_name.values(), key=lambda r: -r["depth"]):
        r["n_leaves"] = r["n_leaves"] or 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["length"]
        if up := by_name.get(r["parent"]):
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
    return [
        (
            r["node"], r["parent"], r["depth"], r["conv_id"], by_name[r["parent"]]["conv_id"] if r["depth"] else None,
            r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"], r["length"],
        )
        for r in by_name.values()
    ]


def _schema() -> pa.Schema:
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in NODE.split(", "))])


def _nodes_batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = _schema()
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over ``convs`` (``conv_id``, ``keys``): see the module's text."""
    distinct = stored(sequences(convs), "distinct-sequences")
    # One number. Every sequence counts as a turn at least.
    turns = distinct.agg(F.sum(F.octet_length("seq") / KEY_BYTES + 1)).first()[0] or 0
    shards = int(turns // shard_turns) + 1

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        if rows:
            nodes = shard_nodes(rows)
            for a in range(0, len(nodes), 50_000):
                yield _nodes_batch(nodes[a : a + 50_000])

    nodes = stored(
        distinct.repartitionByRange(shards, "seq").sortWithinPartitions("seq").select("seq", "n", "conv_id", "ends")
        .mapInArrow(built, NODE),
        "nodes",
    )
    summed = nodes.where("node IS NOT NULL").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"), F.first("length").alias("length"),
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if rows:
            yield _nodes_batch(merged(rows))

    # Two paths a shard, whatever the data.
    boundary = stored(summed.coalesce(1).mapInArrow(joined, NODE), "boundary-nodes")
    names = boundary.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
    inner = nodes.where("node IS NULL").join(names, "parent", "left").withColumn(
        "parent_conv_id", F.coalesce("up", "parent_conv_id")
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return inner.select(*columns, "ends_sha256").unionAll(boundary.select(*columns, "ends_sha256")).withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))
    )
