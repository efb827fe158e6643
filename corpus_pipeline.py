"""A training-text pipeline of five stages, each by one operator of ``pagemint.llm``, over the whole documents table.

Each stage takes (spark, docs, folder) and returns a DataFrame with the columns of documents, which is written as Parquet
and read again as the next stage's input; the last one adds tokens. Null and empty texts pass all stages but the second,
where they are copies of each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemint.llm import bpe, decontaminate, pii, simhash, toxicity
from pagemint.llm.common import stored, table
from pagemint.session import importable


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    model = toxicity.learn(docs, table(spark, folder, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model, score_as="__score", predicted_as="__predicted")
    return scored.where("__predicted = 0").drop("__score", "__predicted")


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def cut_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Benchmark passages of 8 words and more are cut out; documents that are mostly benchmark go."""
    return with_length(decontaminate.remove(docs, table(spark, folder, "benchmark").select("item_id", "text")))


def redact_personal(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return with_length(pii.redact(docs))


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids (packed, little-endian unsigned 32-bit), their number, and the text decoded from them."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = docs.drop("n_tokens", "ids")
    coded = bpe.round_trip(docs, ranks, pattern, decoded="__decoded")
    return coded.select(
        *(F.decode("__decoded", "UTF-8").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", cut_benchmark),
    ("pii", redact_personal),
    ("bpe", tokenize),
]

#: Learned scores, fingerprints and tokens are nothing SQL can state; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(importable(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
