"""The registered ``opN_`` queries: each calls its operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemint.llm import bpe, decontaminate, license_join, pii, quality, secret_scan, simhash, suffix_dedup, tiff, toxicity
from pagemint.llm import spans as S
from pagemint.llm.common import table
from pagemint.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, ranks, pattern)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document; owner is the source, repository the source and language."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repository")
    )
    found = secret_scan.scan(docs)
    return found.select(
        "doc_id",
        *(S.count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(secret_scan.KINDS[: secret_scan.BASE])),
        F.sha2(S.joined(F.col("base"), secret_scan.KINDS), 256).alias("base_sha256"),
        S.joined(F.col("spans"), secret_scan.KINDS).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        F.size("copied").cast("long").alias("n_copied"),
    )


def op3_pii_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    base = F.filter("pii", lambda s: s["kind"] < pii.BASE)
    return pii.scan(docs).select(
        "doc_id",
        *(S.count(F.col("pii"), i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[: pii.BASE])),
        F.sha2(S.joined(base, pii.KINDS), 256).alias("base_sha256"),
        S.joined(F.col("pii"), pii.KINDS).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside windows of 8 item words, and the items."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, folder, "benchmark").select("item_id", "text"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_items") >= 2).alias("contaminated"),
    )


def op5_tiff_media(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as a TIFF file, and what is read back from it."""
    media = tiff.store(
        table(spark, folder, "documents").select(
            "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
        )
    )
    sized = media.select(
        "doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"
    )
    return tiff.by_file(tiff.pages(sized)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document inside strings of 200 bytes that start elsewhere too."""
    found = suffix_dedup.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document and the least doc_id that links of 2 bits or less reach."""
    found = simhash.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    found = license_join.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def remainder(n: int):
    """crc32 of doc_id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of those not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    known = table(spark, folder, "labels").select("doc_id", "toxic").where(remainder(4) != 2)
    scored = toxicity.score(docs, toxicity.learn(docs, known))
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, voted by the labelled ones that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    known = table(spark, folder, "labels").select("doc_id", "quality").where(remainder(5) != 0)
    scored = quality.score(docs, quality.learn(docs, known))
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_bpe_round_trip, op2_secret_scan, op3_pii_scan, op4_decontaminate, op5_tiff_media, op6_suffix_dedup, op7_simhash_dedup, op8_license_scan, op9_toxicity, op10_quality)
}
