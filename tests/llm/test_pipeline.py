"""The corpus pipeline, each stage at its own parameters against SQL or plain Python, and the whole run."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_keys import plain_poisson, squeezed
from tests.llm.test_near import plain_groups
from tillwise.llm import mixing, sampling
from tillwise.llm.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"


def plain_run(rows):
    """What is left of ``(doc_id, text, source)`` after each of the first four stages; doc_ids are distinct."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE['op3_quality_rules']}) WHERE kept").fetchall()}
    kept = [r for r in rows if r[0] in good]
    yield Counter(r[0] for r in kept)
    groups = defaultdict(list)
    for row in kept:
        groups[squeezed(row[1])].append(row)
    kept = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    yield Counter(r[0] for r in kept)
    stays = {k for k, _, top in plain_groups([r[:2] for r in kept], 5) if k == top}
    kept = [r for r in kept if r[0] in stays]
    yield Counter(r[0] for r in kept)
    size = Counter()
    for _, text, source in kept:
        size[source] += len(text.encode()) + 1
    weight = {s: math.pow(n, mixing.TEMPERATURE) for s, n in size.items()}
    rate = {s: round(w / sum(weight.values()) * (sum(size.values()) / size[s]), 6) for s, w in weight.items()}
    yield Counter({r[0]: n for r in kept if (n := plain_poisson(str(r[0]), rate[r[2]]))})


def test_every_stage_and_the_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    expected = list(plain_run([(r.doc_id, r.text, r.source) for r in docs.collect()]))
    for (name, stage), left in zip(corpus_pipeline.STAGES, expected, strict=False):
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == columns, name
        assert Counter(r.doc_id for r in docs.select("doc_id").collect()) == left, name
        assert all(r.text == texts[r.doc_id] for r in docs.collect()), name
    out = corpus_pipeline.run(spark, FOLDER)
    per_document = Counter()
    for r in out.groupBy("doc_id").count().collect():
        per_document[r.doc_id] = r["count"]
    samples = out.agg(F.countDistinct("sample")).first()[0]
    assert per_document == Counter({k: samples * n for k, n in expected[-1].items()})


def test_odd_rows_and_empty_tables_pass_every_stage(spark):
    rows = [(None, " ".join(f"word{i}x{j}" for j in range(14)), "s", "s", 1) for i in range(3)]
    rows += [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, "few words", "en", "s", 9), (3, "few words", "en", "s", 9)]
    rows += [(k, "one two three four five six seven eight nine ten eleven twelve", "en", "t", 62) for k in (4, 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kinds = docs.schema
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = table.count()
            table = corpus_pipeline.stored(stage(spark, table, FOLDER), "stage")
            assert table.schema == kinds, name
            if name != "mixing":
                assert table.count() <= before, name
            if name == "near dedup":
                # Of the twelve words one row stays; the keyless texts are all different.
                assert sorted((r.doc_id or 0 for r in table.collect())) in ([0, 0, 0, 4], [])
        assert sampling.encode(table).count() % 2 == 0
