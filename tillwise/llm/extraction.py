"""The main text of web pages by equivalence-class template deduction.

A page is a row of tokens: block-level tags, told apart by the path of elements
and classes above them, and words. What a site's program wrote around its texts
occurs equally often in every page of the host, so:

1.  For each host and tag the occurrence vector over the host's pages is summed
    up as a fingerprint (each page's count times a number hashed from the page).
    Tags that occur once on every page are the host's skeleton. All other tags
    are then told apart by the skeleton's tag that they follow, and their vectors
    are summed up anew. Tags with the same vector, on at least ``SHARE`` of the
    host's pages, form an equivalence class.
2.  Another pass tests the classes: a valid one has its tags in the same order
    in every occurrence, and valid ones nest, so that none begins inside another
    and ends outside. Invalid classes go. What lies between two tags of valid
    classes is a slot. Words join the class of their slot where every occurrence
    of the slot begins, or ends, with them (up to ``EDGE`` words on either side,
    each only if those before it do), or has them as its whole text.
3.  The template of a host is its nested valid classes with those words, and for
    each slot whether it holds text: menus, that is slots of which at least half
    the words are links, do not. A third pass walks each page along its host's
    template and takes the words that remain in the slots.

Furniture that HTML or its author names as such (``nav``, ``footer``, ``class="ad"``
and so on, see ``markup``) holds no words for any of this. Where a page has an
``article`` or ``main`` element, its text is what lies inside.

Pages that break off before their end give no counts, and a host with fewer than
``LEAST_PAGES`` whole pages has no template: its pages are one slot each. Where
no slot of a host's main text ever varies, its pages are copies of one page,
which says nothing about templates; their words are text.

All passes read the pages; only counts are shuffled, combined in every
task first. One row a host, no longer than a few pages, goes back to them by a
join that Catalyst plans by its size; a host with a third of all pages is split
there by the adaptive skew join and in the counts by the combining.

A null or empty page has the empty text, and so has a page without text. A null
or odd URL has the empty host, which is a host like any other. Repeated rows are
pages of their own. An empty table gives an empty result. Columns beside key,
URL and page are not read. Long pages are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import stored
from tillwise.llm.markup import Reader, is_whole

SHARE = 0.5
LEAST_PAGES = 5
EDGE = 8
# A class of one tag is no evidence of a template.
LEAST_TAGS = 2
MENU = 0.5
# Counts held in a task before they are sent on, and hosts whose templates it remembers.
HELD, HOSTS = 200_000, 500
FIRST = 1  # the slot before the first tag of the template


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 2


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _pages(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    for batch in batches:
        page = batch.column("page")
        columns = [batch.column(c) for c in more]
        for i in range(batch.num_rows):
            yield page[i].as_py() or "", *(c[i] for c in columns)


def roles(events, skeleton: set[int]) -> Iterator[tuple[int, tuple | None]]:
    """The events with every tag beside the skeleton's told apart by the skeleton's tag that it follows, if there is one."""
    after = FIRST
    for tag, block in events:
        if block is not None:
            yield tag, block
        elif tag in skeleton or not skeleton:
            after = tag
            yield tag, None
        else:
            yield _number(f"{after} {tag}"), None


def tag_counts(pages: DataFrame) -> DataFrame:
    """``host``, ``tag``, ``n_pages``, ``vector``, ``place`` over whole pages; tag 0 counts the pages themselves.

    ``pages``: ``host``, ``page`` and ``skeleton`` (null: none yet).
    """
    schema = pa.schema([("host", pa.string()), ("tag", pa.int64()), ("n_pages", pa.int64()), ("vector", pa.int64()), ("place", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Reader(), {}
        for page, host, skeleton in _pages(batches, "host", "skeleton"):
            if not is_whole(page):
                continue
            host, weight = host.as_py(), _number(page)
            seen: dict[int, list[int]] = {0: [1, 0]}
            for place, (tag, block) in enumerate(roles(reader.events(page, texts=False), set(skeleton.as_py() or ()))):
                if block is None:
                    seen.setdefault(tag, [0, place])[0] += 1
            for tag, (n, place) in seen.items():
                one = held.setdefault((host, tag), [0, 0, 0])
                one[0] += 1
                one[1] = (one[1] + n * weight) % (1 << 62)
                one[2] += place
            if len(held) > HELD:
                yield _batch([(*k, *v) for k, v in held.items()], schema)
                held = {}
        if held:
            yield _batch([(*k, *v) for k, v in held.items()], schema)

    partial = pages.select("host", "page", "skeleton").mapInArrow(counted, "host string, tag bigint, n_pages bigint, vector bigint, place bigint")
    return partial.groupBy("host", "tag").agg(
        F.sum("n_pages").alias("n_pages"),
        # Equal vectors have equal parts in every task, so equal sums.
        F.sum(F.col("vector").cast("decimal(20,0)")).alias("vector"),
        F.sum("place").alias("place"),
    )


def skeletons(counts: DataFrame) -> DataFrame:
    """One row per host: ``host``, ``skeleton``, the tags that each of its pages has once."""
    whole = counts.where("tag = 0").where(F.col("n_pages") >= LEAST_PAGES).select("host", "vector")
    # No more tags than the shortest page has.
    return counts.where("tag <> 0").join(whole, ["host", "vector"]).groupBy("host").agg(F.collect_list("tag").alias("skeleton"))


def classes(counts: DataFrame) -> DataFrame:
    """One row per host with candidates: ``host``, ``tags`` (``class``, ``at``, ``tag``; classes by number, tags in order)."""
    whole = counts.where("tag = 0").where(F.col("n_pages") >= LEAST_PAGES).select("host", F.col("n_pages").alias("of"))
    frequent = counts.where("tag <> 0").join(whole, "host").where(F.col("n_pages") >= SHARE * F.col("of"))
    # At most a page's number of tags, twice over, for a host: no window grows with the data.
    kind = Window.partitionBy("host", "vector")
    placed = frequent.withColumns(
        {
            "size": F.count("*").over(kind),
            "at": F.row_number().over(kind.orderBy(F.col("place") / F.col("n_pages"), "tag")) - 1,
            "class": F.min("tag").over(kind),
        }
    ).where(F.col("size") >= LEAST_TAGS)
    return placed.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("class", "at", "tag"))).alias("tags"))


class Walk:
    """A page's walk along the classes of its host: which slot it is in, and which classes break their rules."""

    def __init__(self, tags: list[tuple[int, int, int]]) -> None:
        self.where = {t: (c, at) for c, at, t in tags}
        self.size: dict[int, int] = {}
        for c, at, _ in tags:
            self.size[c] = max(self.size.get(c, 0), at + 1)

    def broken(self, tags: Iterator[int]) -> set[int]:
        """Classes whose tags are out of order, or that another class crosses, in one page."""
        out, open_, due = set(), [], dict.fromkeys(self.size, 0)
        for tag in tags:
            c, at = self.where[tag]
            if at != due[c]:
                out.add(c)
            if at == 0:
                open_.append(c)
            while open_ and open_[-1] != c and c in open_:
                out.add(open_.pop())
            due[c] = at + 1
            if due[c] == self.size[c]:
                due[c] = 0
                if open_ and open_[-1] == c:
                    open_.pop()
        return out | set(open_)


def _slots(events, where) -> Iterator[tuple[int, list[tuple[list[str], int, bool]]]]:
    """Slots of a page with their text blocks."""
    slot, blocks = FIRST, []
    for tag, block in events:
        if block is not None:
            blocks.append(block)
        elif tag in where:
            if blocks:
                yield slot, blocks
            slot, blocks = tag, []
    if blocks:
        yield slot, blocks


def slot_counts(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sums over whole pages: of broken classes (``kind`` 0), slots (1) and the words at their edges (2)."""
    names = ["n", "words", "links", "main", "least", "most"]
    schema = pa.schema([("host", pa.string()), ("kind", pa.int32()), ("slot", pa.int64()), ("edge", pa.int32()), ("word", pa.string()), *[(c, pa.int64()) for c in names]])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, walks = Reader(), {}, {}

        def add(key, words=0, links=0, main=0, text=0):
            one = held.get(key)
            if one is None:
                held[key] = [1, words, links, main, text, text]
            else:
                one[0] += 1
                one[1] += words
                one[2] += links
                one[3] += main
                one[4] = min(one[4], text)
                one[5] = max(one[5], text)

        for page, host, tags, skeleton in _pages(batches, "host", "tags", "skeleton"):
            if not is_whole(page):
                continue
            host = host.as_py()
            if host not in walks:
                if len(walks) > HOSTS:
                    walks.clear()
                walks[host] = Walk([(t["class"], t["at"], t["tag"]) for t in tags.as_py()]), set(skeleton.as_py() or ())
            walk, bones = walks[host]
            events = list(roles(reader.events(page), bones))
            for c in walk.broken(t for t, block in events if block is None and t in walk.where):
                add((host, 0, c, 0, ""))
            for slot, blocks in _slots(events, walk.where):
                words = [w for block in blocks for w in block[0]]
                main = sum(len(b[0]) for b in blocks if b[2])
                add((host, 1, slot, 0, ""), len(words), sum(b[1] for b in blocks), main, _number(" ".join(words)))
                for k in range(min(EDGE, len(words))):
                    add((host, 2, slot, k + 1, words[k]))
                    add((host, 2, slot, -k - 1, words[-k - 1]))
            if len(held) > HELD:
                yield _batch([(*k, *v) for k, v in held.items()], schema)
                held.clear()
        if held:
            yield _batch([(*k, *v) for k, v in held.items()], schema)

    joined = pages.select("host", "page").join(candidates, "host")
    partial = joined.select("page", "host", "tags", "skeleton").mapInArrow(
        counted, "host string, kind int, slot bigint, edge int, word string, " + ", ".join(f"{c} bigint" for c in names)
    )
    return partial.groupBy("host", "kind", "slot", "edge", "word").agg(
        *[F.sum(c).alias(c) for c in names[:4]], F.min("least").alias("least"), F.max("most").alias("most")
    )


def templates(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per host: ``host``, ``skeleton``, ``tags`` (of valid classes), ``slots`` (``slot``, ``menu``, ``fixed``, ``start``, ``end``).

    ``fixed``: the slot's whole text belongs to the template; else its words at the ``start`` and at the ``end``, by number.
    """
    broken = counts.where("kind = 0").groupBy("host").agg(F.collect_list("slot").alias("broken"))
    slots = counts.where("kind = 1").select(
        "host", "slot", "n", "main", (F.col("links") >= MENU * F.col("words")).alias("menu"), (F.col("least") == F.col("most")).alias("same")
    )
    # Every occurrence of the slot has this word at this edge; and all words nearer to the tag are such words too.
    edges = (
        counts.where("kind = 2").select("host", "slot", "edge", F.col("n").alias("with"))
        .join(slots.where(F.col("n") >= LEAST_PAGES).select("host", "slot", "n"), ["host", "slot"])
        .where("with = n")
        .groupBy("host", "slot")
        .agg(F.collect_set("edge").alias("edges"))
    )
    run = lambda sign: F.aggregate(
        F.sequence(F.lit(1), F.lit(EDGE)), F.lit(0),
        lambda n, k: F.when((n == k - 1) & F.array_contains("edges", k * F.lit(sign)), k).otherwise(n),
    )
    described = slots.join(edges, ["host", "slot"], "left").withColumns(
        {"start": F.coalesce(run(1), F.lit(0)), "end": F.coalesce(run(-1), F.lit(0)), "fixed": F.col("same") & (F.col("n") >= LEAST_PAGES)}
    )
    by_host = described.groupBy("host").agg(
        F.collect_list(F.struct("slot", "menu", "fixed", "start", "end")).alias("slots"),
        # Copies of one page: nothing of the main text varies.
        F.coalesce(F.bool_or(~F.col("same") & (F.col("main") > 0)), F.lit(False)).alias("varies"),
        F.bool_or(F.col("main") > 0).alias("has_main"),
        F.bool_or(~F.col("same")).alias("any_varies"),
    )
    return (
        candidates.join(broken, "host", "left").join(by_host, "host", "left")
        .select(
            "host",
            "skeleton",
            F.filter("tags", lambda t: ~F.array_contains(F.coalesce("broken", F.array().cast("array<bigint>")), t["class"])).alias("tags"),
            F.when(F.when(F.col("has_main"), F.col("varies")).otherwise(F.col("any_varies")), F.col("slots")).alias("slots"),
        )
    )


def main_words(events, template: tuple[dict, dict]) -> list[str]:
    """The words of a page that its host's template leaves."""
    tags, slots = template
    found = []
    for slot, blocks in _slots(events, tags):
        menu, fixed, start, end = slots.get(slot, (False, False, 0, 0))
        if not fixed:
            if start or end:
                blocks = _trimmed(blocks, start, end)
            found.append((menu, blocks))
    if any(main for _, blocks in found for _, _, main in blocks):
        return [w for _, blocks in found for words, _, main in blocks if main for w in words]
    return [w for menu, blocks in found if not menu for words, _, _ in blocks for w in words]


def _trimmed(blocks: list[tuple], start: int, end: int) -> list[tuple]:
    """A slot's blocks without its first ``start`` and last ``end`` words."""
    size = sum(len(words) for words, _, _ in blocks)
    first, last = start, max(start, size - end)
    out, at = [], 0
    for words, links, main in blocks:
        part = words[max(0, first - at) : max(0, last - at)]
        at += len(words)
        if part:
            out.append((part, links, main))
    return out


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``df``: ``key``, ``url``, ``text`` (empty if none), ``n_chars``, ``host``, ``n_tags`` (of its template)."""
    pages = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), host_of(F.col(f"`{url}`")).alias("host"),
        F.coalesce(F.col(f"`{page}`"), F.lit("")).alias("page"),
    )
    no_tags = F.lit(None).cast("array<bigint>")
    skeleton = stored(skeletons(stored(tag_counts(pages.withColumn("skeleton", no_tags)), "tag-counts")), "skeletons")
    told_apart = stored(tag_counts(pages.join(skeleton, "host")), "tag-counts")
    candidates = stored(classes(told_apart).join(skeleton, "host"), "classes")
    counts = stored(slot_counts(pages, candidates), "slots")
    found = stored(templates(candidates, counts), "templates")
    out = pages.join(found, "host", "left")
    kind = out.schema["key"].dataType.simpleString()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Reader(), {}
        for batch in batches:
            texts, sizes = [], []
            for html, host, tags, slots, skeleton in _pages([batch], "host", "tags", "slots", "skeleton"):
                host = host.as_py()
                if host not in known:
                    if len(known) > HOSTS:
                        known.clear()
                    known[host] = (
                        {t["tag"] for t in tags.as_py() or []},
                        {s["slot"]: (s["menu"], s["fixed"], s["start"], s["end"]) for s in slots.as_py() or []},
                        set(skeleton.as_py() or ()),
                    )
                *template, bones = known[host]
                texts.append(" ".join(main_words(roles(reader.events(html), bones), template)))
                sizes.append(len(known[host][0]))
            columns = [batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("host"), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "url", "text", "n_chars", "host", "n_tags"])

    return out.select("key", "url", "page", "host", "tags", "slots", "skeleton").mapInArrow(
        extracted, f"key {kind}, url string, text string, n_chars bigint, host string, n_tags bigint"
    ).withColumnRenamed("key", key)
