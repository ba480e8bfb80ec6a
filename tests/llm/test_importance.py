"""Importance resampling against a plain reading of its definition."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tillwise.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ALPHABET = "ab Cd é日🤯 _-\n1"


def plain_features(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = WORD.findall(lower)
    return words, [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target):
    seen = [(key, *plain_features(text)) for key, text in docs]
    s, t = Counter(b for *_, f in seen for b in f), Counter(b for x in target for b in plain_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for key, words, found in seen:
        weight = sum(
            math.floor(1000 * math.log(float(t[b] + 1) * (all_s + 10_000) / (float(s[b] + 1) * (all_t + 10_000)))) for b in found
        )
        h = int(hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, len(words)])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): i for i, r in enumerate(fit[: 5 * len(fit) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("block", [5, 1 << 18])
def test_buckets_equal_zlib_whatever_the_block(monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK_WORDS", block)
    rng = random.Random(block)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 3, 30, 200]))) for _ in range(200)]
    texts += ["x" * 1000 + " y", "a", "", "É é", " ", "a" * 255 + " b" * 300]
    raw = [t.encode() for t in texts]
    found, n_features, n_words = importance.buckets_of(
        np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([len(r) for r in raw])
    )
    ends = np.cumsum(n_features)
    for text, end, n, words in zip(texts, ends, n_features, n_words, strict=True):
        expected = plain_features(text)
        assert sorted(found[end - n : end].tolist()) == sorted(expected[1]) and words == len(expected[0])


def test_crc_matrix_equals_zlib():
    rows = np.random.default_rng(3).integers(0, 256, (50, 37), dtype=np.uint8)
    assert importance.crc_rows(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]


def test_odd_rows_ties_and_repeats(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma", "δ", "x1"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs += [(None, None), (None, "a " * 30), (None, "a " * 30), (5, ""), (7, docs[7][1]), (500, "long " * 40_000), (501, " \n")]
    target = ["alpha gamma alpha gamma", None, ""]
    rows = [(k, t, 1, "n", "b") for k, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, n_features string, buckets string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, wanted)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(docs, target)
    assert importance.resample(df.limit(0), wanted).count() == 0
    nothing = sorted(map(tuple, importance.resample(df, wanted.limit(0)).collect()), key=repr)
    assert nothing == plain_resample(docs, [])
