"""The registered corpus queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from tillwise.llm import (
    exact, extraction, importance, mixing, near, private, quality, sampling, sharding, substrings, tokens, toxicity, trie,
)
from tillwise.llm.common import documents, text_or_empty

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_counts(spark, sf_dir):
    return tokens.token_counts(documents(spark, sf_dir))


@query
def op2_toxicity(spark, sf_dir):
    texts = documents(spark, sf_dir)
    return toxicity.toxicity(texts, toxicity.train(texts, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op3_quality_rules(spark, sf_dir):
    judged = quality.apply_policy(quality.ledger(documents(spark, sf_dir)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_capitals", "failed",
    )


@query
def op5_sentencepiece(spark, sf_dir):
    return sampling.encode(documents(spark, sf_dir))


@query
def op6_minhash(spark, sf_dir):
    return near.near_duplicates(documents(spark, sf_dir))


@query
def op7_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(documents(spark, sf_dir), with_bytes=False).drop("kept")


@query
def op8_exact_dedup(spark, sf_dir):
    return exact.copies(documents(spark, sf_dir))


@query
def op9_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "text", "source", "n_copies", "copy_no")


@query
def op10_sharding(spark, sf_dir):
    docs = documents(spark, sf_dir)
    # Whole documents go through both passes; the digests are of the texts that come out.
    out = {c: F.col(f"row.c{i}") for i, c in enumerate(docs.columns)}
    text = F.coalesce(out["text"], F.lit(""))
    return sharding.shard(docs, size=F.octet_length(text_or_empty()) + 1).select(
        out["doc_id"].alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.shard_of(F.col("key"), sharding.SHARDS + 1).alias("grown_shard"),
    )


@query
def op4_pii(spark, sf_dir):
    return private.pseudonymise(documents(spark, sf_dir))


@query
def op11_html_extraction(spark, sf_dir):
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op12_importance_resampling(spark, sf_dir):
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op13_prefix_trie(spark, sf_dir):
    talks = trie.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie.prefix_trie(trie.rebuilt(talks))


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
