"""Registered queries: each operator over its whole table, reduced to the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.llm import (
    byte_bpe, conversations, decontaminate, exact_dedup, licenses, packing, pii, quality, simhash, token_count, toxicity, warc, whitening,
)

TOKEN_LIMIT = 4096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_simhash")
def _(s, d):
    return simhash.near_duplicates(documents(s, d)).select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query("op2_license_scan")
def _(s, d):
    return licenses.scan(documents(s, d))


@query("op3_token_counts")
def _(s, d):
    found = token_count.count_tokens(documents(s, d), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op4_warc_revisits")
def _(s, d):
    found = warc.resolve(warc.archive(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html")))
    return found.withColumn("headers", warc.header_lines(F.col("headers")))


@query("op5_byte_bpe")
def _(s, d):
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.decode(byte_bpe.encode(documents(s, d), *files), *files).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_pii")
def _(s, d):
    docs = documents(s, d)
    return pii.scan(docs, pii.fit(docs)).select(
        "doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


@query("op7_packing")
def _(s, d):
    return packing.pack_documents(documents(s, d), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op8_exact_dedup")
def _(s, d):
    return exact_dedup.exact_duplicates(documents(s, d))


@query("op9_quality_rules")
def _(s, d):
    return quality.judge(documents(s, d), with_text=False).drop("lost")


@query("op10_toxicity")
def _(s, d):
    docs = documents(s, d)
    machine = toxicity.fit(docs, s.read.parquet(f"{d}/labels.parquet"))
    return toxicity.score(docs, machine).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


@query("op11_decontamination")
def _(s, d):
    found = decontaminate.contamination(documents(s, d), s.read.parquet(f"{d}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query("op12_conversation_repair")
def _(s, d):
    rows = s.read.parquet(f"{d}/conversations.parquet")
    return conversations.repair(conversations.damaged(rows)).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


@query("op13_whitening")
def _(s, d):
    return whitening.whiten(s.read.parquet(f"{d}/embeddings.parquet"))
