"""Verdicts rolled up: page counts, slices, headline, effective documents, twins, coverage.

A verdict row has page_id, document, suite, test_id, test_type, derivation, tags, arg_kinds and passed (boolean). Everything
is one explode of the slice keys of a verdict and grouped sums, first by page, then by document, then by key, so each
shuffle carries counts, not verdicts.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemint import vocab

WRAP = "cast(18446744073709551616 as decimal(38,0))"


@F.pandas_udf(T.DecimalType(20, 0))
def id_digest(ids: pd.Series) -> pd.Series:
    """A stable 64-bit number for a test id."""
    from decimal import Decimal

    one = lambda i: Decimal(int.from_bytes(hashlib.blake2b(i.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big"))
    return ids.map(one, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def one_decimal(values: pd.Series) -> pd.Series:
    """Rounded to one decimal, ties to even on the binary value (which Spark's own rounding does not do)."""
    return values.map(lambda x: round(x, 1), na_action="ignore")


def _lookup(column: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)


def family(test_type: Column) -> Column:
    return _lookup(test_type, {k: v[0] for k, v in vocab.TEST_TYPES.items()})


def slice_keys(verdicts: DataFrame) -> DataFrame:
    """Each verdict once for each slice and key it counts under (columns slice, key)."""
    headline = family(F.col("test_type")).isin(*vocab.HEADLINE_FAMILIES)
    pair = lambda s, k: F.struct(F.lit(s).alias("slice"), k.alias("key"))
    many = lambda s, ks: F.transform(F.array_distinct(F.when(headline, ks)), lambda k: pair(s, k))
    none = F.expr("cast(array() as array<struct<slice:string,key:string>>)")
    own = F.array(pair("families", family(F.col("test_type"))), pair("per_suite", F.col("suite")), pair("per_test_type", F.col("test_type")))
    derived = F.when(headline & (F.col("derivation") != ""), F.array(pair("per_derivation", F.col("derivation"))))
    parts = [F.coalesce(x, none) for x in (own, many("per_tag", F.col("tags")), many("per_arg_kind", F.col("arg_kinds")), derived)]
    return verdicts.withColumn("slice_key", F.explode(F.concat(*parts))).select("*", "slice_key.slice", "slice_key.key").where("key is not null")


def page_counts(verdicts: DataFrame) -> DataFrame:
    """(page_id, document, slice, key, tests, passed, ids): ids is the digest of the key's test ids, mod 2^64."""
    keyed = slice_keys(verdicts.withColumn("digest", id_digest("test_id")))
    return keyed.groupBy("page_id", "document", "slice", "key").agg(
        F.count("*").alias("tests"),
        F.count_if("passed").alias("passed"),
        F.expr(f"case when count(digest) = count(*) then cast(sum(digest) % {WRAP} as decimal(20,0)) end").alias("ids"),
    )


def document_counts(counts: DataFrame) -> DataFrame:
    """(slice, key, document, tests, passed, ids) over a document's pages."""
    return counts.groupBy("slice", "key", "document").agg(
        F.sum("tests").alias("tests"),
        F.sum("passed").alias("passed"),
        F.expr(f"case when count(ids) = count(*) then cast(sum(ids) % {WRAP} as decimal(20,0)) end").alias("ids"),
    )


def effective(tests: str = "tests") -> Column:
    """Documents' worth as equal-sized ones: the sum of their tests squared, over the sum of squares."""
    n = F.col(tests).cast("double")
    return F.sum(n) * F.sum(n) / F.sum(n * n)


def entries(documents: DataFrame) -> DataFrame:
    """(slice, key, score, tests, documents, effective_documents, ids) of every key with tests."""
    return (
        documents.where("tests > 0")
        .groupBy("slice", "key")
        .agg(
            (F.sum("passed") / F.sum("tests")).alias("score"),
            F.sum("tests").alias("tests"),
            F.count("*").alias("documents"),
            effective().alias("worth"),
            F.expr(f"case when count(ids) = count(*) then cast(sum(ids) % {WRAP} as decimal(20,0)) end").alias("ids"),
        )
        .select("slice", "key", "score", "tests", "documents", one_decimal("worth").alias("effective_documents"), "ids")
    )


def twins(rows: DataFrame) -> DataFrame:
    """Add same_tests_as: the other keys of a tag or arg-kind slice with the same number of tests and digest, sorted."""
    may = F.col("slice").isin("per_tag", "per_arg_kind") & F.col("ids").isNotNull()
    groups = rows.where(may).groupBy("slice", "tests", "ids").agg(F.sort_array(F.collect_list("key")).alias("same")).where(F.size("same") > 1)
    joined = rows.join(groups, ["slice", "tests", "ids"], "left")
    others = F.when(F.col("same").isNotNull(), F.array_remove(F.col("same"), F.col("key")))
    return joined.select("slice", "key", "score", "tests", "documents", "effective_documents", others.alias("same_tests_as"))


def summary(verdicts: DataFrame) -> DataFrame:
    """Every slice's entries, in report order by ``position``."""
    rows = twins(entries(document_counts(page_counts(verdicts))))
    return rows.withColumn("position", position(F.col("slice"), F.col("key")))


def position(slice_name: Column, key: Column) -> Column:
    """Place of a key in its slice's fixed order; keys outside it share the last place and sort by name."""
    fixed = [F.when((slice_name == s) & (key == k), F.lit(i)) for s, ks in vocab.KEY_ORDER.items() for i, k in enumerate(ks)]
    return F.coalesce(*fixed, F.lit(99))


def headline(rows: DataFrame) -> DataFrame:
    """One row, ``score``: the mean score of the headline families present, else of all families, null without any."""
    families = rows.where("slice = 'families'")
    chosen = F.avg(F.when(F.col("key").isin(*vocab.HEADLINE_FAMILIES), F.col("score")))
    return families.agg(F.coalesce(chosen, F.avg("score")).alias("score"))


def coverage(pages: DataFrame, predictions: DataFrame) -> DataFrame:
    """(pages, scored, coverage) and failed pages by cause: predictions have page_id and error (null when usable)."""
    joined = pages.select("page_id").join(predictions.select("page_id", "error", F.lit(True).alias("answered")), "page_id", "left")
    cause = F.when(F.col("answered").isNull(), "no_answer").when(F.col("error").isNotNull(), F.col("error"))
    counted = joined.withColumn("cause", cause).agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("cause").isNull()).alias("scored"),
        *(F.count_if(F.col("cause") == c).alias(f"failed_{c}") for c in ("system", "unusable", "no_answer", "not_scored")),
    )
    return counted.withColumn("coverage", F.try_divide("scored", "pages"))


def as_json(rows: DataFrame) -> dict:
    """The summary as one nested object; a report has a few hundred entries at most, whatever the number of verdicts."""
    score = headline(rows).first()["score"]
    out: dict = {"score": score, **{s: {} for s in vocab.SLICES}}
    for r in rows.orderBy("slice", "position", "key").collect():
        entry = {k: r[k] for k in ("score", "tests", "documents", "effective_documents")}
        if r["same_tests_as"]:
            entry["same_tests_as"] = list(r["same_tests_as"])
        out[r["slice"]][r["key"]] = entry
    return out
