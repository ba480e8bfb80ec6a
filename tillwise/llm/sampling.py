"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

All segmentations of a text into vocabulary pieces are paths through a lattice.
Each path's log-probability is perturbed by its own Gumbel noise; the k paths
with the largest perturbed values are a sample without replacement. They are
found by A* search over sets of paths: a set is "this prefix, then at this node
none of these edges, then anything", its priority the largest perturbed value
inside it. That value is known without listing the set, since the maximum of
Gumbels is a Gumbel at the set's log-mass, cut off at the parent's value; and
log-masses come from one backward pass through the lattice. Popping the best
set yields its best path and splits the rest of it, one set for each node of
the path.

No piece has a space after another character, so a text's lattice is the
lattices of its words in a row. Distinct words of a batch are built once, all
in numpy; a walk moves every word of every text in the batch a step at a time.

``log_inclusion`` is the log of the probability that the path is in the sample
given the (k+1)-th perturbed value: dividing by it makes sums over the sample
unbiased. Random numbers are hashed from seed, row key, sample, word and step:
the same row always gives the same sample.

Pieces weigh ``-sharpness * log(rank + offset)``: in a merge list, rank stands
for frequency. Characters in no piece become their UTF-8 bytes and weigh as the
rarest piece.

Null and empty texts have one segmentation, without tokens. A text with fewer
than k segmentations gives them all, each with ``log_inclusion`` 0. Repeated
rows (equal keys) repeat their samples. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm import pieces
from tillwise.llm.pieces import Pieces

SAMPLES = 2
SEED = 5
SHARPNESS = 0.5
OFFSET = 16.0
# Nodes of remembered lattices in a worker process; about 100 bytes each with their edges.
NODES = 1_500_000
# Characters of words whose lattices are built at a time: building takes some 200 bytes for each of them.
BUILT = 1 << 17
# See _push.
DEEP = -90.0
# Code points of text worked on at a time in a task.
CHUNK = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64 bits to 64 bits, one to one, well scattered."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64 bits."""
    return ((mix(x) >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


class Lattices:
    """Lattices of all words seen so far. A node is a place before a character; node 0 is the end of every word.

    A node's edges lie together, longest piece first. Memory is bounded: ``admit`` starts afresh when the nodes get many.
    """

    def __init__(self, p: Pieces, sharpness: float):
        self.p, self.sharpness = p, sharpness
        self.clear()

    def clear(self) -> None:
        self.roots: dict[str, int] = {}
        self.n_nodes, self.n_edges = 1, 0
        self.first = np.zeros(1 << 16, np.int32)
        self.target, self.made = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)
        self.chance, self.upto = np.zeros(1 << 18), np.zeros(1 << 18, np.float32)

    def _room(self, names: tuple[str, ...], size: int) -> None:
        for name in names:
            old = getattr(self, name)
            if len(old) < size:
                new = np.zeros(max(size, 3 * len(old) // 2), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def admit(self, words: set[str]) -> None:
        """Build the lattices of the words not seen yet; a batch's words are all there afterwards."""
        missing = [w for w in words if w not in self.roots]
        if self.n_nodes + sum(map(len, missing)) > NODES and self.roots:
            self.clear()
            missing = list(words)
        # By length: how often numpy is called follows from the longest word.
        missing.sort(key=len)
        ends = np.cumsum([len(w) for w in missing], dtype=np.int64)
        cuts = np.searchsorted(ends, np.arange(BUILT, ends[-1] + 1 if missing else 0, BUILT), side="right").tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(missing)], strict=True):
            if lo < hi:
                self._build(missing[lo:hi])

    def _build(self, words: list[str]) -> None:
        p = self.p
        codes, starts = pieces.flat(words)
        n = len(codes)
        away = np.repeat(starts[1:], np.diff(starts)) - np.arange(n)  # characters from a place to its word's end
        # Nodes are numbered by that distance: what a node leads to is then always finished before it.
        order = np.argsort(away, kind="stable")
        node = np.empty(n, dtype=np.int64)
        node[order] = np.arange(n) + self.n_nodes
        sym = p.symbols(codes)
        table, following, ends = p.trie
        place, at, length = np.arange(n), np.zeros(n, dtype=np.int64), 0
        degree = np.zeros(n, dtype=np.int64)
        layers = []
        while len(place):
            found = table.find((at << 20) | sym[place + length])
            hit = np.flatnonzero(found >= 0)
            place, at = place[hit], following[found[hit]]
            length += 1
            done = np.flatnonzero(ends[at] >= 0)
            layers.append((place[done], ends[at[done]], length))
            degree[place[done]] += 1
            more = np.flatnonzero(away[place] > length)
            place, at = place[more], at[more]
        # A character in no piece has one edge, which keeps its code point: -2 - code.
        alone = np.flatnonzero((sym < 0) | (sym >= p.size))
        layers.insert(0, (alone, -2 - codes[alone], 1))
        degree[alone] += 1
        n_edges = int(degree.sum())
        self._room(("first",), self.n_nodes + n + 1)
        self._room(("target", "made", "chance", "upto"), self.n_edges + n_edges)
        first = np.empty(n, dtype=np.int64)
        first[order] = np.cumsum(degree[order]) - degree[order] + self.n_edges
        slot = first + degree
        for place, made, length in layers:
            slot[place] -= 1
            to = place + length
            inside = away[place] > length
            self.target[slot[place]] = np.where(inside, node[np.minimum(to, n - 1)], 0)
            self.made[slot[place]] = made
        a, b = self.n_edges, self.n_edges + n_edges
        rank = np.where(self.made[a:b] >= 0, self.made[a:b], p.size)
        self.chance[a:b] = -self.sharpness * np.log(rank + OFFSET)
        self.first[self.n_nodes : self.n_nodes + n] = first[order]
        self.first[self.n_nodes + n] = b
        # Log-mass of all ways to the end, a distance at a time; only needed here. The end comes first, then these nodes.
        mass = np.zeros(n + 1)
        before = self.n_nodes - 1
        cuts = np.searchsorted(away[order], np.arange(1, int(away.max()) + 2))
        for lo, hi in zip(cuts[:-1] + self.n_nodes, cuts[1:] + self.n_nodes, strict=True):
            e = slice(self.first[lo], self.first[hi])
            total = self.chance[e] + mass[np.maximum(self.target[e] - before, 0)]
            begin = self.first[lo:hi] - self.first[lo]
            sizes = np.diff(np.append(begin, len(total)))
            top = np.maximum.reduceat(total, begin)
            reach = top + np.log(np.add.reduceat(np.exp(total - np.repeat(top, sizes)), begin))
            mass[lo - before : hi - before] = reach
            self.chance[e] = total - np.repeat(reach, sizes)
        run = np.cumsum(np.exp(self.chance[a:b]))
        begin = self.first[self.n_nodes : self.n_nodes + n] - a
        self.upto[a:b] = run - np.repeat(np.where(begin > 0, run[begin - 1], 0.0), np.diff(np.append(begin, n_edges)))
        root_places = starts[:-1]
        self.roots.update(zip(words, node[root_places].tolist(), strict=True))
        self.n_nodes, self.n_edges = self.n_nodes + n, b

    def walk(self, node: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node to its word's end: edges of all walks in a row, and how many each walk has."""
        steps, who = [], np.flatnonzero(node)
        size = np.zeros(len(node), dtype=np.int64)
        node, noise, turn = node[who], noise[who], np.zeros(1, U)
        while len(who):
            turn += U(0x1E3779B97F4A7C15)
            u = uniform(noise + turn)
            edge = self.first[node]
            last = self.first[node + 1] - 1
            on = np.flatnonzero((self.upto[edge] < u) & (edge < last))
            while len(on):
                edge[on] += 1
                on = on[(self.upto[edge[on]] < u[on]) & (edge[on] < last[on])]
            steps.append((who, edge))
            size[who] += 1
            node = self.target[edge]
            on = np.flatnonzero(node)
            who, node, noise = who[on], node[on], noise[on]
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=np.int64)
        for step, (walkers, edge) in enumerate(steps):
            out[start[walkers] + step] = edge
        return out, size


@lru_cache(maxsize=2)
def lattices(path: str, sharpness: float) -> Lattices:
    """One per worker process: words come back in every batch and task."""
    return Lattices(pieces.load(path), sharpness)


def gumbel_below(mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The largest of a set's Gumbels, by its log-mass, given that it is below ``top``."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - mass)


def top_k(book: Lattices, keys: np.ndarray, texts: list[str], k: int = SAMPLES, seed: int = SEED) -> list[dict]:
    """For each sample number: the documents that have one, edges in a row, where each document's start, how many, scores."""
    split = [pieces.words(t) for t in texts]
    book.admit(set().union(*split))
    n = len(texts)
    n_words = np.array([len(ws) for ws in split], dtype=np.int64)
    root = np.fromiter(map(book.roots.__getitem__, chain.from_iterable(split)), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(n), n_words)
    first_word = np.cumsum(n_words) - n_words
    # Overflow is meant: these are hashes.
    base = mix(keys.astype(U) + np.array([seed], U) * U(0xD1342543DE82EF95))
    word_key = base[doc] + (np.arange(len(root)) - first_word[doc]).astype(U) * U(0xE7037ED1A0B428DB)
    # Each document's best set so far: its value, the sample its path leaves, the token where, the edges barred there.
    value = -np.log(-np.log(uniform(base)))
    leaves, at = np.full(n, -1), np.zeros(n, dtype=np.int64)
    barred: list[tuple[int, ...]] = [()] * n
    heaps: list[list[tuple[float, int, int, tuple[int, ...]]]] = [[] for _ in range(n)]
    alive = np.ones(n, dtype=bool)
    samples: list[dict] = []
    for s in range(k):
        turn = np.array([s + 1], U)
        start = root if s == 0 else np.where(alive[doc], root, 0)
        kept: list[np.ndarray] = [root[:0]] * n
        choice = uniform(base + turn * U(0x8EBC6AF09C88C6E3))
        for d in np.flatnonzero(alive & (leaves >= 0)).tolist():
            old = samples[leaves[d]]
            path = old["edges"][old["start"][d] : old["start"][d] + at[d] + 1]
            node = int(np.searchsorted(book.first[: book.n_nodes], np.int32(path[-1]), side="right")) - 1
            others = [e for e in range(book.first[node], book.first[node + 1]) if e not in barred[d]]
            reach = np.cumsum(np.exp(book.chance[others]))
            new = others[min(int(np.searchsorted(reach, choice[d] * reach[-1])), len(others) - 1)]
            kept[d] = np.append(path[:-1], new)
            # Words before the one with that token are kept; that word goes on behind the new edge.
            w = first_word[d] + int(np.count_nonzero(book.target[path[:-1]] == 0))
            start[first_word[d] : w] = 0
            start[w] = book.target[new]
        edges, size = book.walk(start, mix(word_key + turn * U(0xA0761D6478BD642F)))
        head = np.array([len(x) for x in kept], dtype=np.int64)
        total = head + np.bincount(doc, size, minlength=n).astype(np.int64)
        begin = np.cumsum(total) - total
        path = edges
        if head.any():
            path = np.empty(int(total.sum()), dtype=np.int64)
            old = np.flatnonzero(np.repeat(head > 0, head))
            fresh = np.ones(len(path), dtype=bool)
            places = np.repeat(begin, head) + np.arange(len(old)) - np.repeat(np.cumsum(head) - head, head)
            path[places] = np.concatenate(kept)
            fresh[places] = False
            path[fresh] = edges
        chance = book.chance[path]
        some = np.flatnonzero(total)
        log_prob = np.zeros(n)
        if len(some):
            log_prob[some] = np.add.reduceat(chance, begin[some])
        samples.append(
            {"docs": np.flatnonzero(alive), "edges": path, "start": begin, "size": total, "log_prob": log_prob,
             "value": value.copy()}
        )
        split_at = np.maximum(head - 1, 0)
        wanted = k + 1 - s
        _push(heaps, s, path, chance, begin, total, split_at, head, barred, value,
              base + turn * U(0x589965CC75374CC3), book, alive, wanted)
        for d in np.flatnonzero(alive).tolist():
            if heaps[d]:
                best = max(heaps[d])
                heaps[d].remove(best)
                value[d], leaves[d], at[d], barred[d] = best
            else:
                alive[d], value[d] = False, -np.inf
    # Now ``value`` is each document's (k+1)-th perturbed value, the threshold of inclusion; -inf: everything is in.
    for sample in samples:
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            x = sample["log_prob"] - value
            sample["log_inclusion"] = np.where(
                np.isneginf(value), 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(x))))
            )
    return samples


def _push(heaps, s, path, chance, begin, total, split_at, head, barred, value, base, book, alive, wanted) -> None:
    """Add the best sets of what a sample leaves of its set: the same prefix, at one node none of the edges tried there.

    A set's log-mass falls along the path, and noise of 52 bits cannot lift a set by more than 37 or lower one by more
    than 4. So only tokens whose prefix is above ``DEEP`` are looked at, unless too few sets come out of them.
    """
    n = len(total)
    reach = total.copy()
    if len(path):
        run = np.cumsum(chance)
        some = np.minimum(begin, len(path) - 1)
        offset = run[some] - chance[some]
        # The first token below DEEP: prefixes fall, so it is found by bisection in the running sum.
        reach = np.clip(np.searchsorted(-run, -(offset + DEEP)) + 1 - begin, 0, total)
    for d_range in (np.flatnonzero(alive & (total > 0)),):
        _push_some(d_range, reach, heaps, s, path, chance, begin, split_at, head, barred, value, base, book, wanted)
    short = [d for d in range(n) if alive[d] and reach[d] < total[d] and sum(h[0] > DEEP + 37 for h in heaps[d]) < wanted]
    if short:
        for d in short:
            heaps[d] = [h for h in heaps[d] if h[1] != s]
        _push_some(np.array(short), total, heaps, s, path, chance, begin, split_at, head, barred, value, base, book, wanted)


def _push_some(docs, reach, heaps, s, path, chance, begin, split_at, head, barred, value, base, book, wanted) -> None:
    size = reach[docs]
    docs, size = docs[size > 0], size[size > 0]
    if not len(docs):
        return
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(docs)), size)
    token = np.arange(len(of)) - first[of]
    at = begin[docs][of] + token
    step = chance[at]
    run = np.cumsum(step)
    before = run - step
    before -= before[first][of]
    gone = np.exp(step)
    for i, d in enumerate(docs.tolist()):
        if head[d] and split_at[d] < size[i]:
            gone[first[i] + split_at[d]] += np.exp(book.chance[list(barred[d])]).sum()
    rest = np.where(gone < 1 - 1e-12, before + np.log(np.maximum(1.0 - gone, 1e-13)), -np.inf)
    noise = uniform(mix(base[docs][of] + token.astype(U) * U(0x1D8E4E27C47D124F)))
    g = np.full(len(of), -np.inf)
    # Before the split, the former sample's sets stand; a node without another edge has no rest.
    live = np.flatnonzero((rest > -np.inf) & (token >= split_at[docs][of]))
    g[live] = gumbel_below(rest[live], value[docs][of[live]], noise[live])
    for _ in range(wanted):
        best = np.maximum.reduceat(g, first)
        top = np.flatnonzero((g == best[of]) & (g > -np.inf))
        for x in top.tolist():
            d = int(docs[of[x]])
            tried = (int(path[at[x]]),)
            if head[d] and token[x] == split_at[d]:
                tried += barred[d]
            heaps[d].append((float(g[x]), s, int(token[x]), tried))
        g[top] = -np.inf


def edge_ids(book: Lattices, path: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Vocabulary ids of a row of edges, and how many each edge has: None for one each, more where bytes stand for one."""
    made = book.made[path]
    raw = np.flatnonzero(made < 0)
    if not len(raw):
        return made, None
    many = np.ones(len(path), dtype=np.int64)
    chars = [chr(-2 - c).encode("utf-8", "surrogatepass") for c in made[raw].tolist()]
    many[raw] = [len(c) for c in chars]
    ids = np.repeat(made, many)
    ids[ids < 0] = book.p.byte_ids[np.frombuffer(b"".join(chars), dtype=np.uint8)]
    return ids, many


class Decoder:
    """Ids back to text: pieces joined, ``▁`` as space, byte ids as UTF-8, the space put in front taken off."""

    def __init__(self, p: Pieces):
        parts = [b""] * p.size
        for i, t in p.text.items():
            parts[i] = t.replace(pieces.SPACE, " ").encode()
        for b, i in enumerate(p.byte_ids.tolist()):
            parts[i] = bytes([b])
        self.parts = np.array(parts, dtype=object)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.parts[ids].tolist()).decode("utf-8", "replace")[1:]


def _row_keys(column: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(str(x)) for x in column.to_pylist()], dtype=U)


def encode(
    df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, seed: int = SEED,
    sharpness: float = SHARPNESS, model: str | None = None,
) -> DataFrame:
    """Up to ``samples`` rows for each row: ``key``, ``sample`` (from 0, best first), ``ids``, ``log_prob``, ``perturbed``,
    ``log_inclusion``, ``exact`` (decoding gives the text back, ``▁`` as space)."""
    path = model or pieces.tokenizer_path()
    out = (
        df.select(F.col(f"`{key}`").alias("key")).schema.add("sample", "integer").add("ids", T.ArrayType(T.IntegerType()))
        .add("log_prob", "double").add("perturbed", "double").add("log_inclusion", "double").add("exact", "boolean")
    )
    arrow = ["key", "sample", "ids", "log_prob", "perturbed", "log_inclusion", "exact"]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = lattices(path, sharpness)
        decoder = Decoder(book.p)
        for batch in batches:
            lengths = np.array([0 if x is None else x for x in batch.column("n").to_pylist()], dtype=np.int64)
            part = (np.cumsum(lengths) - lengths) // CHUNK
            for number in np.unique(part):
                rows = batch.take(pa.array(np.flatnonzero(part == number)))
                texts = [t or "" for t in rows.column("text").to_pylist()]
                plain = [t.replace(pieces.SPACE, " ") for t in texts]
                found = top_k(book, _row_keys(rows.column("key")), texts, samples, seed)
                for number_, s in enumerate(found):
                    docs = s["docs"]
                    ids, many = edge_ids(book, s["edges"])
                    count = s["size"]
                    if many is not None:
                        owner = np.repeat(np.arange(len(texts)), count)
                        count = np.bincount(owner, many, minlength=len(texts)).astype(np.int64)
                    ends = np.concatenate([[0], np.cumsum(count)])
                    exact = [decoder.decode(ids[ends[d] : ends[d + 1]]) == plain[d] for d in docs.tolist()]
                    # Documents that have run out of segmentations have no tokens here, so the others' ids lie in a row.
                    offsets = np.concatenate([[0], np.cumsum(count[docs])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("key").take(pa.array(docs)),
                            pa.array(np.full(len(docs), number_, dtype=np.int32)),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                            pa.array(s["log_prob"][docs]), pa.array(s["value"][docs]), pa.array(s["log_inclusion"][docs]),
                            pa.array(exact, pa.bool_()),
                        ],
                        arrow,
                    )

    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.length(F.col(f"`{text}`")).alias("n"), F.col(f"`{text}`").alias("text")
    )
    return rows.mapInArrow(sampled, out).withColumnRenamed("key", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """``key`` and the ``text`` of each row's ids; null ids give a null text."""
    path = model or pieces.tokenizer_path()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces.load(path))
        for batch in batches:
            texts = [
                None if x is None else decoder.decode(np.array(x, dtype=np.int64)) for x in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids"))
    out = rows.select("key").schema.add("text", "string")
    return rows.mapInArrow(decoded, out).withColumnRenamed("key", key)
