"""Near-duplicate groups against brute force, also where whole groups share a template."""

from __future__ import annotations

import random
import re

import pytest

from tillwise.llm import near

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_groups(rows, width, percent=80):
    """``(key, size of the set, smallest key reachable)`` for each row; keys are distinct."""
    sets = {k: plain_set(t, width) for k, t in rows}
    keys = sorted(sets)
    top = {k: k for k in keys}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return sorted((k, len(sets[k]), root(k)) for k in keys)


def groups(spark, rows, width):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near.near_duplicates(df, width=width).collect()
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)


def from_template(rng, n, replaced, words=60):
    template = [f"t{i}" for i in range(words)]
    out = []
    for _ in range(n):
        text = list(template)
        for at in rng.sample(range(words), replaced):
            text[at] = f"w{rng.random()}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("width", "heads"), [(2, 1), (5, 0)])
def test_groups_equal_brute_force(spark, monkeypatch, width, heads):
    monkeypatch.setattr(near, "HEADS", heads)
    rng = random.Random(width)
    texts = [t for k in (1, 2, 3, 5) for t in from_template(rng, 40, k)]
    texts += ["a b", "A  b", "a", "", " \n", "a b c", "x " * 300, "x " * 200]
    # A chain: each text shares 9 of 10 words' shingles with the next one only.
    texts += [" ".join(f"c{j}" for j in range(i * 4, i * 4 + 60)) for i in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert groups(spark, rows, width) == plain_groups(rows, width)


def test_a_common_template_does_not_make_quadratic_pairs(spark, monkeypatch):
    measured = near.confirm
    counts = {}
    for n in (200, 400, 800):
        sizes = []
        monkeypatch.setattr(near, "confirm", lambda pairs, *a, s=sizes: s.append(pairs.count()) or measured(pairs, *a))
        rows = list(enumerate(from_template(random.Random(n), n, 5)))
        got = groups(spark, rows, 2)
        counts[n] = sum(sizes)
        if n == 200:
            assert got == plain_groups(rows, 2)
    # All pairs of 800 are 319,600.
    assert counts[800] < 6 * counts[200] and counts[800] < 30 * 800, counts
