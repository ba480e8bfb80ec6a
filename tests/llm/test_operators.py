"""The corpus operators against SQL, brute force and exact round trips."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tillwise.llm import exact, mixing, near, pieces, private, quality, sampling, sharding, substrings, tokens, toxicity
from tillwise.llm.oracle import ORACLE
from tillwise.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d e f g h i j k " * 40), (5, "a b c d e f g h i j k " * 40),
       (None, "null key"), (7, "x" * 30_000), (8, "日本 🤯 é\0"), (9, "a b c d e f g h i j k"), (10, "A B C D E F G H I J K")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    rows = [(k, t, "s", i, "x", "y", "z") for i, (k, t) in enumerate(ODD)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, kept int, key string, row string, digest string"
    )


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    answer = con.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in answer.fetchall()), key=repr)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == expected


def test_every_operator_takes_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(k, i % 2) for i, (k, _) in enumerate(ODD) if k], "doc_id long, toxic int")
    words = spark.createDataFrame([(i, ("scum trash " if i % 2 else "fine good ") * 50, i % 2) for i in range(40)],
                                  "doc_id long, text string, toxic int")
    model = toxicity.train(words, words.select("doc_id", "toxic"))
    del labels
    runs = {
        "tokens": lambda d: tokens.token_counts(d), "toxicity": lambda d: toxicity.toxicity(d, model),
        "ledger": lambda d: quality.apply_policy(quality.ledger(d)), "private": lambda d: private.pseudonymise(d),
        "near": lambda d: near.near_duplicates(d), "substrings": lambda d: substrings.remove_repeats(d),
        "exact": lambda d: exact.copies(d), "sharding": lambda d: sharding.shard(d),
    }
    for name, run in runs.items():
        assert run(odd).count() == len(ODD), name
        assert run(odd.limit(0)).count() == 0, name
    for name, keeps in {
        "rules": quality.filter_documents, "exact": exact.drop_copies, "near": near.drop_near_duplicates,
    }.items():
        assert keeps(odd).columns == odd.columns, name
        assert keeps(odd.limit(0)).count() == 0, name
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mix(odd).count() >= 0
    assert sampling.encode(odd).where("sample = 0").count() == len(ODD)
    assert sampling.encode(odd.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.tokenizer_path())
    rows = docs.select("doc_id", "text").collect()
    expected = {r.doc_id: len(model.encode(r.text or "")) for r in rows}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()} == expected
    rng = random.Random(5)
    odd = ["".join(rng.choice("aab the in  \n_*=-/01日é🤯▁<s>x") for _ in range(rng.randint(0, 150))) for _ in range(500)]
    assert tokens.counter(pieces.tokenizer_path())(odd) == [len(model.encode(t)) for t in odd]


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = QUERIES["op2_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id)
    rank = got.score.rank()
    n1, n0 = (got.toxic == 1).sum(), (got.toxic == 0).sum()
    assert (rank[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.85
    assert (got.predicted == got.toxic).mean() > 0.94


def test_ablations_count_bits(spark, docs):
    book = quality.ledger(docs).select("failed").toPandas().failed
    for r in quality.ablations(quality.ledger(docs)).collect():
        bit = 1 << next(x.bit for x in quality.RULES if x.name == r.rule)
        assert r.n_failed == ((book & bit) != 0).sum() and r.n_only == (book == bit).sum()


def test_pseudonyms_are_valid_reversible_and_linked(spark, docs):
    text = "+1 (743) 555-3824, 4650195898803591, 4650 1958 9880 3591, 227.5.221.1, 300.1.1.1, 123-45-6789, 1984-02-29, a.41@b.com"
    df = spark.createDataFrame([(1, text), (2, "x 4650195898803591"), (3, None)], "doc_id long, text string")
    out = private.pseudonymise(df)
    one, two, none = (r.text for r in out.orderBy("doc_id").collect())
    parts = one.split(", ")
    assert none is None and two.split()[1] == parts[1] == parts[2].replace(" ", "") and parts[4] == "300.1.1.1"
    digits = [int(d) for d in parts[1]][::-1]
    assert (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0
    assert private.pseudonymise(out, back=True).select("text").collect()[0].text == text
    whole = private.pseudonymise(private.pseudonymise(docs), back=True).select("doc_id", "text")
    assert whole.exceptAll(docs.select("doc_id", "text")).count() == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(189 * 7).select(
        private.permute("k", "date", F.floor(F.col("id") / 7), F.col("id") % 7, 189, 7).alias("p")
    )
    assert df.distinct().count() == 189 * 7 and df.where("p.a >= 189 OR p.b >= 7 OR p.a < 0 OR p.b < 0").count() == 0


def test_sampling_without_replacement():
    p = pieces.load(pieces.tokenizer_path())
    book = sampling.Lattices(p, sampling.SHARPNESS)

    def ways(word):
        if not word:
            yield ()
        for i in range(1, len(word) + 1):
            if word[:i] in p.ids:
                yield from ((p.ids[word[:i]], *rest) for rest in ways(word[i:]))

    weight = {w: sum(-sampling.SHARPNESS * math.log(i + sampling.OFFSET) for i in w) for w in ways("▁then▁on")}
    total = np.logaddexp.reduce(list(weight.values()))
    chance = {w: math.exp(x - total) for w, x in weight.items()}
    n, k = 8000, 3
    found = sampling.top_k(book, sampling.mix(np.arange(n).astype(np.uint64)), ["then on"] * n, k)
    ids = [[tuple(sampling.edge_ids(book, s["edges"][s["start"][d]:s["start"][d] + s["size"][d]])[0].tolist())
            for d in range(n)] for s in found]
    assert all(len({s[d] for s in ids}) == k for d in range(n))
    first, every = Counter(ids[0]), Counter(w for s in ids for w in s)
    rng = np.random.default_rng(0)
    names, logs = list(chance), np.log(list(chance.values()))
    drawn = Counter(names[i] for _ in range(n) for i in np.argsort(-(logs + rng.gumbel(size=len(logs))))[:k])
    for w in sorted(chance, key=chance.get)[-5:]:
        assert abs(first[w] / n - chance[w]) < 0.03 and abs(every[w] - drawn[w]) / n < 0.03
    assert abs(sum(np.exp(s["log_prob"] - s["log_inclusion"]) for s in found).mean() - 1) < 0.02


def test_sampled_ids_decode_to_the_text(spark, docs):
    sampled = sampling.encode(docs)
    assert sampled.where("NOT exact").count() == 0
    back = sampling.decode(sampled.where("sample = 1").select("doc_id", "ids"))
    plain = docs.select("doc_id", F.replace("text", F.lit("▁"), F.lit(" ")).alias("text"))
    assert back.exceptAll(plain).count() == 0


def _brute(docs):
    seen = {}
    order = lambda k: substrings.NO_KEY if k is None else k
    for k, t in sorted(docs, key=lambda r: order(r[0])):
        b = (t or "").encode()
        for j in range(len(b) - 49):
            seen.setdefault(b[j : j + 50], order(k))
    out = {}
    for k, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if seen[b[j : j + 50]] < order(k):
                gone[j : j + 50] = b"\1" * 50
        left = bytes(x for x, c in zip(b, gone, strict=True) if not c)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def test_repeated_substrings_against_brute_force(spark, docs):
    rng = random.Random(3)
    base = "".join(rng.choice("ab \né") for _ in range(3000))
    made = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 2000), (None, base[:500])]
    for i in range(6, 120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(0, 2900)
            parts.append(base[a : a + rng.randint(1, 200)] + "".join(rng.choice("abcdefgh\0") for _ in range(rng.randint(0, 60))))
        made.append((i * 3 % 1000, "".join(parts)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert {r[0]: tuple(r)[1:5] for r in substrings.remove_repeats(df).collect()} == _brute(made)
    whole = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r[0]: tuple(r)[1:5] for r in QUERIES["op7_substring_dedup"](spark, FOLDER).collect()} == _brute(whole)


def test_shards(spark, docs):
    got = QUERIES["op10_sharding"](spark, FOLDER).toPandas()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    assert len(got) == len(texts) and set(got.doc_id) == set(texts)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r["size"] == len(texts[r.doc_id]) + 1 for _, r in got.iterrows())
    for _, one in got.groupby("shard"):
        assert sorted(one.slot) == list(range(len(one)))
        assert abs(np.corrcoef(one.slot, one.doc_id)[0, 1]) < 0.35
    assert set(got.grown_shard[got.shard != got.grown_shard]) == {8} and set(got.shard) == set(range(8))
    many = sharding.shard(docs.select("doc_id", "text"), size=F.octet_length("text"), bucket_bytes=20_000).toPandas()
    assert all(sorted(one.slot) == list(range(len(one))) for _, one in many.groupby("shard"))


def test_sharding_passes_whole_rows(spark, docs, monkeypatch, tmp_path):
    dealt = []
    whole = sharding.shard
    monkeypatch.setattr(sharding, "shard", lambda df, *a, **k: dealt.append(df.columns) or whole(df, *a, **k))
    QUERIES["op10_sharding"](spark, FOLDER)
    assert dealt == [docs.columns]
    sharding.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.select(*docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count()
    got = {r.doc_id: (r.shard, r.slot) for r in QUERIES["op10_sharding"](spark, FOLDER).collect()}
    assert {r.doc_id: (r._shard, r._slot) for r in back.select("doc_id", "_shard", "_slot").collect()} == got


def test_rows_of_one_key_spread_over_buckets(spark, monkeypatch):
    rows = [(None if i % 3 else i, f"text {i} " * 20) for i in range(600)] + [(7, "same " * 30)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scratch, buckets = sharding.scratch_path, []
    monkeypatch.setattr(sharding, "scratch_path", lambda s, label: buckets.append(scratch(s, label)) or buckets[-1])
    got = sharding.shard(df, bucket_bytes=8_000).toPandas()
    assert len(got) == len(rows)
    assert all(sorted(one.slot) == list(range(len(one))) for _, one in got.groupby("shard"))
    assert got.groupby("key", dropna=False).shard.nunique().max() == 1
    written = spark.read.parquet(buckets[0]).groupBy("shard", "bucket").count()
    assert written.agg(F.max("count")).first()[0] < 120


def test_near_duplicates_keep_texts_without_a_key_of_their_own_apart(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    one, two, three = words(80), words(80), words(80)
    near_one, near_two = [*one[:-1], "end"], [*two[:-1], "end"]
    texts = [(1, one), (None, near_one), (None, words(80)), (None, words(80)), (5, words(80)), (5, two), (6, near_two),
             (None, three), (None, [*three[:-1], "end"]), (2**63 - 1, words(80)), (-3, words(80)), (5, two)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts], "doc_id long, text string")
    rows = near.near_duplicates(df, width=5).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter({
        (1, 1, True): 1, (None, 1, False): 1, (None, None, True): 3, (None, None, False): 1, (5, 5, True): 3,
        (6, 5, False): 1, (2**63 - 1, 2**63 - 1, True): 1, (-3, -3, True): 1,
    })
    left = Counter(tuple(r) for r in near.drop_near_duplicates(df).collect())
    gone = Counter(tuple(r) for r in df.collect()) - left
    assert {(None, " ".join(near_one)), (6, " ".join(near_two))} <= set(gone) and sum(gone.values()) == 3


def test_poisson_mean_and_targets(spark):
    df = spark.range(20_000).select(mixing.poisson(F.lit(40.5), F.col("id")).alias("n"))
    mean, var = df.agg(F.avg("n"), F.variance("n")).first()
    assert abs(mean - 40.5) < 0.3 and abs(var - 40.5) < 2


def test_pipeline_keeps_columns(spark, docs):
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == docs.columns
    assert 700 < kept.count() < 900


def test_toxicity_without_much_to_learn_from(spark):
    """Defined scores without labels of both kinds, and one text for each sampled key."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)] + [(None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, value in ((none, 0.0), (docs.select("doc_id", F.lit(0).alias("toxic")), 0.0),
                          (docs.select("doc_id", F.lit(1).alias("toxic")), 1.0)):
        got = toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == 10 and {r.score for r in got} == {value} and {r.predicted for r in got} == {int(value)}
        assert toxicity.toxicity(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
    words = [(i, ("scum trash " if i % 2 else "fine good ") * 50) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    once = spark.createDataFrame(words, "doc_id long, text string")
    often = once.union(once.where("doc_id = 1").crossJoin(spark.range(500)).select("doc_id", "text"))
    assert toxicity.train(often, labels) == toxicity.train(once, labels)


def test_lattices_are_built_in_portions(monkeypatch):
    """No build is larger than its bound, but for a single word that is; the lattices are those of one build."""
    words = {f"{a}{b}" for a in ("ab", "token", "é", "\U0001f600", "x" * 90) for b in range(60)}
    path = pieces.tokenizer_path()
    whole, parts = sampling.Lattices(pieces.load(path), 0.5), sampling.Lattices(pieces.load(path), 0.5)
    whole.admit(words)
    sizes, build = [], parts._build
    monkeypatch.setattr(sampling, "BUILT", 64)
    monkeypatch.setattr(parts, "_build", lambda some: (sizes.append((sum(map(len, some)), len(some))), build(some))[1])
    parts.admit(words)
    parts.admit(set())
    assert len(sizes) > 10 and all(size <= 128 or n == 1 for size, n in sizes)
    assert whole.n_nodes == parts.n_nodes and whole.n_edges == parts.n_edges
    keys, texts = np.arange(len(words)).astype(np.uint64), sorted(words)
    for a, b in zip(sampling.top_k(whole, keys, texts), sampling.top_k(parts, keys, texts), strict=True):
        assert sampling.edge_ids(whole, a["edges"])[0].tolist() == sampling.edge_ids(parts, b["edges"])[0].tolist()
        assert np.allclose(a["log_prob"], b["log_prob"]) and np.allclose(a["value"], b["value"])
